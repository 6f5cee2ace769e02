"""Names of log spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical and display name of each log space.
SPACES = (
    ("F-Log", "FUJIFILM F-Log"),
    ("F-Log2", "FUJIFILM F-Log2"),
    ("F-Log2C", "FUJIFILM F-Log2 C"),
    ("V-Log", "Panasonic V-Log"),
    ("N-Log", "Nikon N-Log"),
    ("L-Log", "Leica L-Log"),
    ("Canon Log 2", "Canon Log 2"),
    ("Canon Log 3", "Canon Log 3"),
    ("S-Log3", "Sony S-Log3"),
    ("S-Log3.Cine", "Sony S-Log3.Cine"),
    ("Arri LogC3", "ARRI LogC3"),
    ("Arri LogC4", "ARRI LogC4"),
    ("Log3G10", "RED Log3G10"),
    ("D-Log", "DJI D-Log"),
)


def _lookup(pairs: list[tuple[str, object]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def place(display: str) -> Column:
    """Place of a display name in the menu, from 1; null for other names."""
    return _lookup([(n, k + 1) for k, n in enumerate(sorted(n for _, n in SPACES))])[F.col(display)]


def resolve(name: str) -> Column:
    """Canonical name for a display name, else for a canonical name; null where it is neither."""
    return F.coalesce(_lookup([(n, c) for c, n in SPACES])[F.col(name)], _lookup([(c, c) for c, _ in SPACES])[F.col(name)])
