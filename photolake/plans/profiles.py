"""Queries of profiles, tags and colour matrices, and the composed develop and render chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.functions import color as K
from photolake.operators import develop as D
from photolake.operators import presets

from .pixels import RGB, point, rounded, shown
from .registry import query


def staged(name: str, source: str, keep: list[str], steps: list[dict[str, str]], out: dict[str, str]):
    """Registers a projection in steps; both engines get the same arithmetic, and no step repeats the text of another."""
    text = source
    for k, step in enumerate(steps):
        text = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {text}) t{k}"

    def run(spark, d):
        rows = view(spark, d, source)
        for step in steps:
            rows = rows.withColumns({n: F.expr(e) for n, e in step.items()})
        return rows.select(*keep, *[F.expr(e).alias(n) for n, e in out.items()])

    run.__name__ = name
    query(f"SELECT {', '.join(keep)}, {', '.join(f'{e} AS {n}' for n, e in out.items())} FROM {text}")(run)


point("oklab_to_xyz", rounded(**dict(zip(("cx", "cy", "cz"), K.xyz_from_oklab(RGB), strict=True))))

#: XYZ to the colours of an example camera.
CAMERA = ((0.80, 0.15, -0.05), (-0.20, 1.10, 0.10), (0.02, 0.10, 0.75))
_x, _y = K.kelvin_to_xy("kelvin")
_NEUTRAL = [
    {"wx": _x, "wy": _y},
    dict(zip(("sx", "sy", "sz"), K.white_xyz("wx", "wy"), strict=True)),
    {f"n{k}": K.dot(w, ("sx", "sy", "sz")) for k, w in enumerate(CAMERA)},
]
_GAINS = [*_NEUTRAL, {f"g{k}": e for k, e in enumerate(K.multipliers(("n0", "n1", "n2")))}]
staged("neutral_to_multipliers", "fx_kelvin", ["event_id", "kelvin"], _GAINS, rounded(g0="g0", g1="g1", g2="g2"))
_BACK = K.np.linalg.inv(K.np.array(CAMERA)).tolist()
_SHOT = [
    *_GAINS,
    {f"a{k}": f"CASE WHEN event_id % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE 1 / g{k} END" for k in range(3)},
    {f"q{k}": K.dot(tuple(w), ("a0", "a1", "a2")) for k, w in enumerate(_BACK)},
    {"total": "nullif(q0 + q1 + q2, 0)"},
    {"cx": "q0 / total", "cy": "q1 / total"},
]
# an image without multipliers (one in fifty here) has no temperature: 0
staged("as_shot_kelvin", "fx_kelvin", ["event_id"], _SHOT, {"cct": f"round(1.23e-8 + CASE WHEN total > 0 THEN {K.xy_to_kelvin('cx', 'cy')} ELSE 0 END, 2)"})

_SPACE = K.np.linalg.inv(D.gamut_matrix(D.PROPHOTO, D.D65, D.GAMUTS["V-Gamut"], D.D65)).tolist()
_NINE = [f"m{k}" for k in range(9)]
_WORKING = [
    {f"p{3 * i + j}": " + ".join(f"m{3 * i + k} * CAST({_SPACE[k][j]!r} AS DOUBLE)" for k in range(3)) for i in range(3) for j in range(3)},
    {f"q{3 * i + j}": f"p{3 * i + j} / nullif(p{3 * i} + p{3 * i + 1} + p{3 * i + 2}, 0)" for i in range(3) for j in range(3)},
]
_INVERSE = rounded(**{f"w{k}": e for k, e in enumerate(K.inverse3([f"q{k}" for k in range(9)]))})


def _layers(source: str) -> str:
    for k, step in enumerate(_WORKING):
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source}) t{k}"
    return source


@query(f"""WITH s AS (SELECT event_id, cct, {', '.join(f'm[{k + 1}] AS m{k}' for k in range(9))} FROM fx_kelvin e JOIN fx_matrix x ON x.camera_id = e.event_id % 4)
SELECT event_id, cct, {', '.join(f'{e} AS {n}' for n, e in _INVERSE.items())} FROM {_layers('s')}""")
def camera_to_working_matrix(spark, d):
    """Camera to working colours: the camera's matrix times the space's, rows to sum 1, inverted in closed form."""
    events = view(spark, d, "fx_kelvin").select("event_id", (F.col("event_id") % 4).cast("int").alias("camera_id"))
    rows = events.join(view(spark, d, "fx_matrix"), "camera_id").select("event_id", "cct", *[F.col("m")[k].alias(n) for k, n in enumerate(_NINE)])
    for step in _WORKING:
        rows = rows.withColumns({n: F.expr(e) for n, e in step.items()})
    return rows.select("event_id", "cct", *[F.expr(e).alias(n) for n, e in _INVERSE.items()])


_NAMES = ", ".join(f"'{n}'" for n in D.PREFERENCE)


@query(f"""WITH s AS (SELECT CAST(floor(event_id / 3) AS BIGINT) AS camera_id, event_id * 4 % 9 + 1 AS rank, ([{_NAMES}])[CAST(event_id * 4 % 9 + 1 AS INT)] AS illuminant, value FROM fx_event)
SELECT camera_id, arg_min(illuminant, rank) AS illuminant, round(1.23e-8 + arg_min(value, rank), 6) AS first_entry FROM s GROUP BY 1""")
def illuminant_preference(spark, d):
    """Of every camera's three matrices the one of the most preferred illuminant."""
    names = F.array(*[F.lit(n) for n in D.PREFERENCE])
    matrices = view(spark, d, "fx_event").select(F.floor(F.col("event_id") / 3).alias("camera_id"), F.get(names, (F.col("event_id") * 4 % 9).cast("int")).alias("illuminant"), F.array("value").alias("m"))
    return D.preferred_matrix(matrices).select("camera_id", "illuminant", shown(F.col("m")[0], 6).alias("first_entry"))


def _adapted(i: int, j: int) -> str:
    parts = []
    for target, source in (("D50", "D65"), ("D65", "D50")):
        move = K.bradford(target, source)
        parts.append(f"WHEN target = '{target}' AND illuminant = '{source}' AND camera_id <> 1 THEN " + " + ".join(f"m[{3 * i + k + 1}] * {float(move[k, j])!r}::DOUBLE" for k in range(3)))
    return f"CASE WHEN illuminant IS NULL THEN {int(i == j)} WHEN illuminant = target THEN m[{3 * i + j + 1}] {' '.join(parts)} END"


_ADAPT_STATUS = "CASE WHEN illuminant IS NULL THEN 'identity' WHEN illuminant = target THEN 'kept' WHEN camera_id = 1 THEN 'unexpected' ELSE 'adapted' END"


@query(f"""WITH k AS (SELECT camera_id, m, CASE cct WHEN 6504 THEN 'D65' WHEN 5003 THEN 'D50' END AS illuminant FROM fx_matrix WHERE cct > 2856),
s AS (SELECT event_id, e.event_id % 4 AS camera_id, CASE WHEN floor(event_id / 4) % 2 = 0 THEN 'D65' ELSE 'D50' END AS target, illuminant, m FROM fx_kelvin e LEFT JOIN k ON k.camera_id = e.event_id % 4)
SELECT event_id, {_ADAPT_STATUS} AS status, {', '.join(f"round(1.23e-8 + {_adapted(i, j)}, 6) AS m{3 * i + j}" for i in range(3) for j in range(3))} FROM s""")
def chromatic_adapt(spark, d):
    """Each image's matrix for its white; camera 1 has matrices of twelve entries, camera 3 has none."""
    twelve = F.when(F.col("camera_id") == 1, F.concat("m", F.array_repeat(F.lit(0.0), 3))).otherwise(F.col("m"))
    illuminant = F.when(F.col("cct") == 6504, "D65").when(F.col("cct") == 5003, "D50").otherwise("A")
    matrices = view(spark, d, "fx_matrix").select("camera_id", illuminant.alias("illuminant"), twelve.alias("m"))
    target = F.when(F.floor(F.col("event_id") / 4) % 2 == 0, "D65").otherwise("D50")
    targets = view(spark, d, "fx_kelvin").select("event_id", (F.col("event_id") % 4).cast("int").alias("camera_id"), target.alias("target"))
    out = D.chromatic_adapt(targets, matrices)
    return out.select("event_id", "status", *[shown(F.col("m")[k], 6).alias(f"m{k}") for k in range(9)])


_TAGS = {("iso", "height"): "iso_h", ("iso", "width"): "iso_w", ("private", "height"): "priv_h", ("private", "width"): "priv_w", ("upstream", "height"): "up_h", ("upstream", "width"): "up_w"}


@query(" UNION ALL ".join(f"SELECT image_id, '{space}' AS namespace, '{tag}' AS tag, CAST({c} AS BIGINT) AS value FROM fx_tags WHERE {c} IS NOT NULL" for (space, tag), c in _TAGS.items()))
def tag_explode(spark, d):
    """The tags of the three namespaces as rows; one scan, absent tags give none."""
    entry = lambda space, tag, c: F.struct(F.lit(space).alias("namespace"), F.lit(tag).alias("tag"), F.col(c).cast("bigint").alias("value"))
    rows = view(spark, d, "fx_tags").select("image_id", F.explode(F.array(*[entry(*k, c) for k, c in _TAGS.items()])).alias("t"))
    return rows.select("image_id", "t.*").where("value IS NOT NULL")


_MAKER, _MODEL = "trim(coalesce(make, ''))", "trim(coalesce(model, ''))"


@query(f"""WITH t AS (SELECT image_id, {_MAKER} AS make, {_MODEL} AS model, seconds FROM fx_tags), p AS (SELECT make, model, avg(seconds) AS focal FROM t WHERE make <> '' AND model BETWEEN 'M0' AND 'M5' GROUP BY 1, 2)
SELECT image_id, t.make, t.model, round(1.23e-8 + focal, 6) AS focal FROM t LEFT JOIN p ON p.make = t.make AND p.model = t.model""")
def profile_dim(spark, d):
    """Images with their camera's profile, a small table that Spark broadcasts by its measured size; null without one."""
    tags = view(spark, d, "fx_tags").select("image_id", F.expr(_MAKER).alias("make"), F.expr(_MODEL).alias("model"), "seconds")
    profiles = tags.where("make <> '' AND model BETWEEN 'M0' AND 'M5'").groupBy("make", "model").agg(shown(F.avg("seconds"), 6).alias("focal"))
    return tags.drop("seconds").join(profiles, ["make", "model"], "left").select("image_id", "make", "model", "focal")


_PRESET = {"ev": "(event_id % 5) * 0.25e0", "dehaze": "CASE WHEN event_id % 3 > 0 THEN (event_id % 3) * 0.5e0 END", "gain_r": "kelvin / 5000", "graded": "event_id % 2 = 0"}
_KEY = "sha256('ev=' || CAST(ev AS VARCHAR) || '|impulse=none|dehaze=' || coalesce(CAST(dehaze AS VARCHAR), 'none') || '|purple=none|green=none|gain_r=' || CAST(gain_r AS VARCHAR) || '|gain_b=none')"


@query(f"""WITH s AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _PRESET.items())} FROM fx_kelvin), k AS (SELECT *, {_KEY} AS key FROM s)
SELECT event_id, key, min(event_id) OVER (PARTITION BY ev, dehaze, gain_r) AS developed_as FROM k""")
def stage_cache_key(spark, d):
    """The key of each render's developed frames, and the first render that has it. What acts after the projection is no part of it."""
    renders = view(spark, d, "fx_kelvin").select("event_id", *[F.expr(e).alias(n) for n, e in _PRESET.items()])
    for name in presets.DEVELOP:
        if name not in _PRESET:
            renders = renders.withColumn(name, F.lit(None))
    keyed = renders.select("event_id", presets.develop_key().alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("event_id").alias("developed_as")), "key").select("event_id", "key", "developed_as")


_BESIDE = "avg(CASE WHEN (a.y = b.y OR a.x = b.x) AND b.colour = {} THEN b.v END)"
_CORNER = "max(CASE WHEN b.y = a.y + {} AND b.x = a.x + {} THEN b.v END)"
_CORNERS = {"pp": (1, 1), "mm": (-1, -1), "pm": (1, -1), "mp": (-1, 1)}


def _loca_query(name: str, **strength: float):
    text = "near"
    for k, step in enumerate(K.loca_steps(strength.get("purple", 0.0), strength.get("green", 0.0))):
        text = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {text}) t{k}"

    def run(spark, d):
        return D.loca(view(spark, d, "fx_px40"), view(spark, d, "fx_cfa"), **strength).withColumn("v", shown("v", 6))

    run.__name__ = name
    query(f"""WITH m AS (SELECT image_id, y, x, v, colour FROM fx_px40 JOIN fx_cfa ON y % 2 = ry AND x % 2 = rx),
near AS (SELECT a.image_id, a.y, a.x, a.v, a.colour, {_BESIDE.format(0)} AS red, {_BESIDE.format(2)} AS blue, {', '.join(f'{_CORNER.format(*o)} AS {n}' for n, o in _CORNERS.items())}
 FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT image_id, y, x, round(1.23e-8 + CASE WHEN pp + mm + pm + mp IS NOT NULL AND red + blue IS NOT NULL THEN repaired ELSE v END, 6) AS v FROM {text}""")(run)


_loca_query("loca_purple", purple=0.8)
_loca_query("loca_green", green=1.0)

#: Asked for and sensors it suits, by the name of what then runs; anything else gets the sensor's default.
_SENSOR = "CASE image_id % 4 WHEN 0 THEN 'xtrans' WHEN 1 THEN 'bayer4' ELSE 'bayer3' END"
_ASKED = "CASE CAST(floor(image_id / 4) AS BIGINT) % 5 WHEN 0 THEN 'superpixel' WHEN 1 THEN 'bilinear' WHEN 2 THEN 'xtrans_fast' WHEN 3 THEN 'unknown' END"
staged(
    "demosaic_resolve", "fx_meta", ["image_id"], [{"sensor": _SENSOR, "asked": _ASKED}],
    {
        "sensor": "sensor",
        "used": "CASE WHEN asked = 'superpixel' AND sensor = 'bayer3' THEN 'superpixel' WHEN sensor = 'xtrans' THEN 'xtrans_fast' ELSE 'bilinear' END",
        "as_asked": "coalesce(asked IN ('superpixel', 'bilinear') AND sensor = 'bayer3' OR asked = 'bilinear' AND sensor = 'bayer4' OR asked = 'xtrans_fast' AND sensor = 'xtrans', FALSE)",
    },
)
