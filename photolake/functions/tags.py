"""Typed reading of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest unsigned 32-bit number.
MOST = (1 << 32) - 1


def number(kind: str, raw: str) -> Column:
    """A tag's first number as an unsigned 32-bit one.

    Lists of BYTE, SHORT or LONG give their first element, of SSHORT or SLONG also, wrapped where it is negative. I64 counts
    within the range only; F64 is cut to whole numbers and to the range, and is 0 where it is no number. Else null.
    """
    first = F.split(F.trim(raw), r"[\s,]+")[0].try_cast("long")
    whole = F.col(raw).try_cast("long")
    real = F.col(raw).try_cast("double")
    cut = F.when(F.isnan(real), 0).otherwise(F.least(F.greatest(real, F.lit(0.0)), F.lit(float(MOST)))).cast("long")
    k = F.col(kind)
    return (
        F.when(k.isin("BYTE", "SHORT", "LONG"), first).when(k.isin("SSHORT", "SLONG"), F.pmod(first, F.lit(MOST + 1)))
        .when(k == "I64", F.when(whole.between(0, MOST), whole)).when(k == "F64", cut)
    )
