"""Pixel arithmetic as SQL expressions that Spark fuses to one pass. Names of columns in, expression text out.

A parameter that is None switches its stage off: the expression is the column itself.
"""

from __future__ import annotations

import numpy as np

# Published values: luma weights of ProPhoto and Rec. 709, Oklab matrices (Ottosson), Krystek and CIE daylight, McCamy.
PROPHOTO_LUMA = (0.2880402, 0.7118741, 0.0000857)
REC709_LUMA = (0.2126, 0.7152, 0.0722)
OKLAB_LMS = ((0.8189330101, 0.3618667424, -0.1288597137), (0.0329845436, 0.9293118715, 0.0361456387), (0.0482003018, 0.2643662691, 0.6338517070))
OKLAB_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def dot(weights: tuple[float, ...], names: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST({w!r} AS DOUBLE) * {n}" for w, n in zip(weights, names, strict=True)) + ")"


def clamp(x: str, low: str = "CAST(0 AS DOUBLE)", high: str = "CAST(1 AS DOUBLE)") -> str:
    return f"least(greatest({x}, {low}), {high})"


def exposure(v: str, ev: float | None, low: float = 0.0, high: float = 1.0) -> str:
    """Clamp to the bounds, in either order, then times 2^ev; no change without ev."""
    if ev is None:
        return v
    a, b = sorted((low, high))
    return f"({clamp(v, f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)')} * CAST({2.0**ev!r} AS DOUBLE))"


def oklab(names: tuple[str, str, str]) -> tuple[str, str, str]:
    """Oklab L, a, b of XYZ; the cube root keeps its argument's sign."""
    root = lambda e: f"(sign({e}) * power(abs({e}), CAST(1 AS DOUBLE) / 3))"
    lms = tuple(root(dot(w, names)) for w in OKLAB_LMS)
    return tuple(dot(w, lms) for w in OKLAB_LAB)


def srgb(v: str) -> str:
    c = clamp(v)
    return f"CASE WHEN {c} <= 0.0031308e0 THEN 12.92e0 * {c} ELSE 1.055e0 * power({c}, 1 / 2.4e0) - 0.055e0 END"


def boost(names: tuple[str, str, str], saturation: float | None = 1.25, contrast: float | None = 1.10, pivot: float = 0.18) -> tuple[str, ...]:
    """Saturation around the ProPhoto luma, then contrast around the pivot, not under 0; one unset side counts as 1, both as off."""
    if saturation is None and contrast is None:
        return names
    s, k = (1.0 if x is None else x for x in (saturation, contrast))
    luma = dot(PROPHOTO_LUMA, names)
    return tuple(f"greatest(({luma} + ({n} - {luma}) * CAST({s} AS DOUBLE) - CAST({pivot} AS DOUBLE)) * CAST({k} AS DOUBLE) + CAST({pivot} AS DOUBLE), CAST(0 AS DOUBLE))" for n in names)


# Published log curves: cut, slope and offset of the linear part, then a · log10(b · v + c) + d.
LOG_CURVES = {
    "V-Log": (0.01, 5.6, 0.125, 0.241514, 1.0, 0.00873, 0.598206),
    "LogC3": (0.010591, 5.367655, 0.092809, 0.247190, 5.555556, 0.052272, 0.385537),
    "F-Log2": (0.000889, 8.799461, 0.092864, 0.245281, 5.555556, 0.064829, 0.384316),
    "S-Log3": (0.01125, (171.2102946929 - 95) / 0.01125 / 1023, 95 / 1023, 261.5 / 1023, 1 / 0.19, 0.01 / 0.19, 420 / 1023),
}


def log_encode(v: str, curve: str) -> str:
    cut, m, n, a, b, c, d = LOG_CURVES[curve]
    x = f"greatest({v}, CAST(1e-6 AS DOUBLE))"
    num = lambda k: f"CAST({k!r} AS DOUBLE)"
    return f"CASE WHEN {x} < {num(cut)} THEN {num(m)} * {x} + {num(n)} ELSE {num(a)} * log10({num(b)} * {x} + {num(c)}) + {num(d)} END"


def vignette(v: str, y: str, x: str, k: tuple[float, float, float, float] = (0.3, 0.1, 0.05, 0.02), centre: float = 3.5, focal: float = 8.0) -> str:
    r2 = f"((({x} - CAST({centre} AS DOUBLE)) * ({x} - CAST({centre} AS DOUBLE)) + ({y} - CAST({centre} AS DOUBLE)) * ({y} - CAST({centre} AS DOUBLE))) / CAST({focal * focal} AS DOUBLE))"
    k0, k1, k2, k3 = (f"CAST({x} AS DOUBLE)" for x in k)
    return f"({v} * (1 + {r2} * ({k0} + {r2} * ({k1} - {k2} * {r2} + {k3} * {r2} * {r2}))))"


def kelvin_to_xy(t: str) -> tuple[str, str]:
    """Chromaticity of a temperature from 2000 to 25000 K: Krystek's formula under 4000 K, CIE daylight above."""
    t = f"least(greatest({t}, CAST(2000 AS DOUBLE)), CAST(25000 AS DOUBLE))"
    u = f"((0.860117757 + 1.54118254e-4 * {t} + 1.28641212e-7 * {t} * {t}) / (1 + 8.42420235e-4 * {t} + 7.08145163e-7 * {t} * {t}))"
    v = f"((0.317398726 + 4.22806245e-5 * {t} + 4.20481691e-8 * {t} * {t}) / (1 - 2.89741816e-5 * {t} + 1.61456053e-7 * {t} * {t}))"
    xk, yk = f"(3 * {u} / (2 * {u} - 8 * {v} + 4))", f"(2 * {v} / (2 * {u} - 8 * {v} + 4))"
    m = f"(1000 / {t})"
    xd = f"CASE WHEN {t} <= 7000 THEN 0.244063 + 0.09911 * {m} + 2.9678 * {m} * {m} - 4.6070 * {m} * {m} * {m} ELSE 0.237040 + 0.24748 * {m} + 1.9018 * {m} * {m} - 2.0064 * {m} * {m} * {m} END"
    x = f"(CASE WHEN {t} < 4000 THEN {xk} ELSE {xd} END)"
    return x, f"(CASE WHEN {t} < 4000 THEN {yk} ELSE -3.000 * {x} * {x} + 2.870 * {x} - 0.275 END)"


def xy_to_kelvin(x: str, y: str) -> str:
    n = f"(({x} - 0.3320) / (0.1858 - {y}))"
    k = f"(449.0 * {n} * {n} * {n} + 3525.0 * {n} * {n} + 6823.3 * {n} + 5520.33)"
    return f"CASE WHEN {y} > 0 AND {k} > 0 THEN {k} ELSE 0 END"


def _number(k: float) -> str:
    return f"CAST({float(k)!r} AS DOUBLE)"


def _rows(m: np.ndarray) -> list[tuple[float, ...]]:
    return [tuple(row) for row in m.tolist()]


def xyz_from_oklab(names: tuple[str, str, str]) -> tuple[str, ...]:
    """The inverse of ``oklab``."""
    roots = [dot(w, names) for w in _rows(np.linalg.inv(np.array(OKLAB_LAB)))]
    cubes = tuple(f"({e} * {e} * {e})" for e in roots)
    return tuple(dot(w, cubes) for w in _rows(np.linalg.inv(np.array(OKLAB_LMS))))


def white_xyz(x: str, y: str) -> tuple[str, str, str]:
    return f"({x} / {y})", "CAST(1 AS DOUBLE)", f"((1 - {x} - {y}) / {y})"


def multipliers(neutral: tuple[str, str, str]) -> tuple[str, str, str]:
    """White-balance gains of a camera neutral, green at 1: reciprocals from a floor on, within 1/16 and 16; ones if any part is not finite."""
    low = f"greatest(greatest({', '.join(neutral)}, {_number(0)}) * {_number(1e-3)}, {_number(1e-6)})"
    finite = " AND ".join(f"abs({n}) < {_number(1e308)}" for n in neutral)
    gain = lambda n: f"CASE WHEN {finite} THEN least(greatest(greatest({neutral[1]}, {low}) / greatest({n}, {low}), {_number(1 / 16)}), {_number(16)}) ELSE {_number(1)} END"
    return gain(neutral[0]), _number(1), gain(neutral[2])


def inverse3(names: list[str]) -> list[str]:
    """The inverse of a 3×3 matrix whose nine entries are named row by row; null where it has none."""
    at = lambda i, j: names[(i % 3) * 3 + j % 3]
    minor = lambda i, j: f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})"
    det = "(" + " + ".join(f"{at(0, j)} * {minor(0, j)}" for j in range(3)) + ")"
    return [f"({minor(j, i)} / nullif({det}, 0))" for i in range(3) for j in range(3)]


# Published cone responses (Bradford) and XYZ of the standard whites.
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
WHITES = {"A": (1.09850, 1.0, 0.35585), "D50": (0.96422, 1.0, 0.82521), "D55": (0.95682, 1.0, 0.92149), "D65": (0.95047, 1.0, 1.08883), "D75": (0.94972, 1.0, 1.22638)}


def bradford(source: str, target: str) -> np.ndarray:
    """XYZ under one standard white to XYZ under another."""
    cone = np.array(BRADFORD)
    return np.linalg.solve(cone, np.diag(cone @ WHITES[target] / (cone @ WHITES[source])) @ cone)


def smooth(x: str, low: float, high: float) -> str:
    """The cubic ramp from 0 at ``low`` to 1 at ``high``."""
    t = clamp(f"(({x} - {_number(low)}) / {_number(high - low)})")
    return f"({t} * {t} * (3 - 2 * {t}))"


def smoother(x: str, low: float, high: float) -> str:
    """The quintic ramp from 0 at ``low`` to 1 at ``high``."""
    t = clamp(f"(({x} - {_number(low)}) / {_number(high - low)})")
    return f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"


# The ramp of an edge, the brightness of a full repair, the ramp of the tint and the parts of the target.
LOCA_EDGE, LOCA_FULL, LOCA_TINT, LOCA_MIX = (0.01, 0.08), 1.5, 0.25, (0.8, 0.2)


def loca_steps(purple: float, green: float, least: float = 0.5) -> list[dict[str, str]]:
    """Steps that give ``repaired`` from v, colour, red, blue (means of a green site's neighbours) and its diagonals pp, mm, pm, mp."""
    keep, mix = (_number(w) for w in LOCA_MIX)
    return [
        {
            "edge": smooth("(0.25e0 * (abs(pp - mm) + abs(pm - mp)))", *LOCA_EDGE), "lum": "greatest(red, v, blue)",
            "low_rb": "least(red, blue)", "high_rb": "greatest(red, blue)", "mean_rb": "((red + blue) * 0.5e0)",
        },
        {"near_full": f"edge * {smoother('lum', least, LOCA_FULL)}", "purple_over": "greatest(low_rb - v, 0e0) / nullif(lum, 0e0)", "green_over": "greatest(v - high_rb, 0e0) / nullif(lum, 0e0)"},
        {
            "raised": f"greatest(low_rb * {keep} + mean_rb * {mix} - v, 0e0) * near_full * {smooth('purple_over', 0.0, LOCA_TINT)}",
            "lowered": f"greatest(v - (high_rb * {keep} + mean_rb * {mix}), 0e0) * near_full * {smooth('green_over', 0.0, LOCA_TINT)}",
        },
        {
            "all_raised": "CASE WHEN low_rb > v THEN raised + greatest(low_rb - (v + raised), 0e0) * near_full ELSE 0e0 END",
            "all_lowered": "CASE WHEN v > high_rb THEN lowered + greatest(v - lowered - high_rb, 0e0) * near_full ELSE 0e0 END",
        },
        {"repaired": f"CASE WHEN colour = 1 AND edge > 0 AND lum > {_number(least)} THEN v + {_number(purple)} * all_raised - {_number(green)} * all_lowered ELSE v END"},
    ]
