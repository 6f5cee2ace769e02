"""Numpy kernels for tiles. They import nothing of the plans, so that a worker can load them alone.

Rows and columns are the last two axes; those before them, if any, count tiles that do not see each other. What lies beyond
the edges counts as missing, like NaN.
"""

from __future__ import annotations

import numpy as np


def mean_of_three(tile: np.ndarray) -> np.ndarray:
    """Mean of the 3×3 window's values in the image."""
    wide = np.pad(tile, 1, constant_values=np.nan)
    views = np.stack([wide[a : a + tile.shape[0], b : b + tile.shape[1]] for a in range(3) for b in range(3)])
    seen = ~np.isnan(views)
    return np.where(seen, views, 0).sum(axis=0) / np.maximum(seen.sum(axis=0), 1)


def around(plane: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """The plane as seen at each offset (dy, dx), stacked; NaN beyond its edges."""
    r = max(abs(o) for pair in offsets for o in pair)
    wide = np.pad(plane, [(0, 0)] * (plane.ndim - 2) + [(r, r)] * 2, constant_values=np.nan)
    h, w = plane.shape[-2:]
    return np.stack([wide[..., r + dy : r + dy + h, r + dx : r + dx + w] for dy, dx in offsets])


def spread(near: np.ndarray) -> dict[str, np.ndarray]:
    """Minimum, maximum, median and number of the values that are not NaN along the first axis; NaN where there is none."""
    ranked = np.sort(near, axis=0)  # NaN last
    count = (~np.isnan(near)).sum(axis=0)
    at = lambda k: np.take_along_axis(ranked, np.maximum(k, 0)[None], axis=0)[0]
    return {"lo": ranked[0], "hi": at(count - 1), "median": (at((count - 1) // 2) + at(count // 2)) / 2, "count": count.astype(float)}


EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def fill_colours(v: np.ndarray, colour: np.ndarray, diagonal: float = 1.0, alone: bool = False) -> dict[str, np.ndarray]:
    """r, g, b: the own colour kept, the others the mean of the eight neighbours of that colour, those at corners counted by ``diagonal``.

    A colour that no neighbour has is NaN, or with ``alone`` the own value.
    """
    weights = np.array([1.0 if dy == 0 or dx == 0 else diagonal for dy, dx in EIGHT]).reshape(-1, *[1] * v.ndim)
    out = {}
    for k, name in enumerate(("r", "g", "b")):
        own = np.where(colour == k, v, np.nan)
        near = around(own, EIGHT)
        seen = np.where(np.isnan(near), 0.0, weights)
        total = seen.sum(axis=0)
        mean = np.divide((np.nan_to_num(near) * seen).sum(axis=0), total, out=np.full_like(v, np.nan), where=total > 0)
        filled = np.where(np.isnan(own), mean, own)
        out[name] = np.where(np.isnan(filled), v, filled) if alone else filled
    return out


def bright_edge(v: np.ndarray, colour: np.ndarray) -> dict[str, np.ndarray]:
    """What the repair of a fringe asks of a site: means of red and blue beside it, and its four diagonals."""
    corners = dict(zip(("mm", "mp", "pm", "pp"), around(v, [(-1, -1), (-1, 1), (1, -1), (1, 1)]), strict=True))
    out = {"v": v, "colour": colour} | corners
    for k, name in ((0, "red"), (2, "blue")):
        near = around(np.where(colour == k, v, np.nan), [(-1, 0), (0, -1), (0, 1), (1, 0)])
        count = (~np.isnan(near)).sum(axis=0)
        out[name] = np.divide(np.nansum(near, axis=0), count, out=np.full_like(v, np.nan), where=count > 0)
    return out


def _strided(v: np.ndarray, step: int, of) -> np.ndarray:
    """``of`` on each of the step² grids that the plane's rows and columns make."""
    out = np.empty_like(v)
    for a in range(step):
        for b in range(step):
            out[..., a::step, b::step] = of(v[..., a::step, b::step])
    return out


def box_mean(v: np.ndarray, r: int, step: int = 1) -> np.ndarray:
    """Mean of the values in (2r+1)² windows of places that are ``step`` apart; NaN where the place itself has none."""

    def of(grid: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(grid)
        parts = []
        for plane in (np.where(seen, grid, 0.0), seen.astype(float)):
            for axis in (-2, -1):
                n = plane.shape[axis]
                total = np.concatenate([np.zeros_like(plane.take([0], axis)), np.cumsum(plane, axis=axis)], axis=axis) if n else plane
                at = np.arange(n)
                plane = total.take(np.minimum(at + r + 1, n), axis) - total.take(np.maximum(at - r, 0), axis) if n else plane
            parts.append(plane)
        return np.where(seen, parts[0] / np.maximum(np.rint(parts[1]), 1), np.nan)

    return _strided(v, step, of)


def box_min(v: np.ndarray, r: int, step: int = 1) -> np.ndarray:
    """Least value in such windows; NaN where the place itself has none."""

    def of(grid: np.ndarray) -> np.ndarray:
        seen, plane = ~np.isnan(grid), np.where(np.isnan(grid), np.inf, grid)
        for axis in (-2, -1):
            wide = np.pad(plane, [(r, r) if k == axis + plane.ndim else (0, 0) for k in range(plane.ndim)], constant_values=np.inf)
            plane = np.minimum.reduce([wide.take(np.arange(k, k + grid.shape[axis]), axis) for k in range(2 * r + 1)])
        return np.where(seen, plane, np.nan)

    return _strided(v, step, of)


def calm(v: np.ndarray, inside: np.ndarray, offsets: list[tuple[int, int]], tolerance: float) -> np.ndarray:
    """Values beyond those of their neighbours by more than the tolerance drawn to the median with a soft knee; others stay."""
    near = spread(around(v, offsets))
    away = v - near["median"]
    with np.errstate(invalid="ignore"):
        odd = (inside > 0) & (near["count"] >= 4) & ((v > near["hi"] + tolerance) | (v < near["lo"] - tolerance))
        return np.where(odd, near["median"] + away * tolerance / (tolerance + np.abs(away)), v)


def merged_cells(field: np.ndarray, ry: np.ndarray, rx: np.ndarray, colour: np.ndarray, mode: str) -> np.ndarray:
    """One value for the four places of a 2×2 cell: least, mean or the blue one's, 0 without any; or each one's own."""
    if mode == "each":
        return field
    values = np.where(colour == 2, field, np.nan) if mode == "blue" else field
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    inside = np.stack([((dy == 0) | (dy == 1 - 2 * ry)) & ((dx == 0) | (dx == 1 - 2 * rx)) for dy, dx in steps])
    near = np.where(inside, around(values, steps), np.nan)
    seen = ~np.isnan(near)
    count = seen.sum(axis=0)
    if mode == "avg":
        return np.where(seen, near, 0.0).sum(axis=0) / np.maximum(count, 1)
    best = np.where(seen, near, np.inf).min(axis=0) if mode == "min" else np.where(seen, near, -np.inf).max(axis=0)
    return np.where(count > 0, best, 0.0)


def clear(v: np.ndarray, ry: np.ndarray, rx: np.ndarray, colour: np.ndarray, strength: float, cap: float, mode: str, radius: int, eps: float, light: float) -> np.ndarray:
    """A Bayer mosaic without haze: dark channel and guided filter of each plane, merged by cells, applied."""
    dark = box_min(v, radius, 2)
    mean = lambda x: box_mean(x, radius, 2)
    guide, source = mean(v), mean(dark)
    a = (mean(v * dark) - guide * source) / (mean(v * v) - guide * guide + eps)
    haze = np.clip(mean(a) * v + mean(source - a * guide), 0.0, min(max(cap, 0.0), 1.0))
    through = np.maximum(1 - min(max(strength, 0.0), 1.0) * merged_cells(haze, ry, rx, colour, mode), 1e-3)
    return np.maximum((v - light) / through + light, 0.0)


def _ramp(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((x - low) / (high - low), 0.0, 1.0)


def mend_fringes(v: np.ndarray, colour: np.ndarray, purple: float, green: float, least: float, edge_ramp: tuple[float, float], full: float, tint: float, parts: tuple[float, float]) -> np.ndarray:
    """Green sites of bright edges raised against purple and lowered against green fringes; other sites stay."""
    near = bright_edge(v, colour)
    red, blue = near["red"], near["blue"]
    with np.errstate(invalid="ignore", divide="ignore"):
        t = _ramp(0.25 * (np.abs(near["pp"] - near["mm"]) + np.abs(near["pm"] - near["mp"])), *edge_ramp)
        edge = t * t * (3 - 2 * t)
        brightest = np.maximum(np.maximum(red, v), blue)
        t = _ramp(brightest, least, full)
        weight = edge * t**3 * (t * (t * 6 - 15) + 10)
        low, high, mean = np.minimum(red, blue), np.maximum(red, blue), (red + blue) * 0.5
        change = 0.0
        for sign, bound, strength in ((1, low, purple), (-1, high, green)):
            over = sign * (bound - v)
            t = _ramp(np.maximum(over, 0.0) / brightest, 0.0, tint)
            part = np.maximum(sign * (bound * parts[0] + mean * parts[1] - v), 0.0) * weight * t * t * (3 - 2 * t)
            change = change + np.where(over > 0, sign * strength * (part + np.maximum(over - part, 0.0) * weight), 0.0)
        # NaN where a neighbour is missing: comparisons with it are false
        hit = (colour == 1) & (edge > 0) & (brightest > least) & ~np.isnan(red + blue + near["pp"] + near["mm"] + near["pm"] + near["mp"])
        return np.where(hit, v + change, v)
