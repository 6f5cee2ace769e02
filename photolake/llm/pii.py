"""Personal data by patterns and by bootstrapped context, in DataFrame functions only.

Seeds are what the four fixed patterns find. The words before a seed are a lexical pattern. Patterns and instances form
a graph whose edges Spark aggregates once; then, in a few rounds, a pattern is scored by the share and number of known
instances it precedes and an instance by its patterns. Identifiers that no fixed pattern knows, but that stand in a
high-confidence pattern, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import listed
from .shared import key_bitmap, marked, written

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. Possessive repeats match the same and need no stack. An e-mail starts at the start of a run or where
# the last one ended; any later start in the run would give way to that one.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an at sign, and the words of digits, dots, dashes and brackets that follow it after single
#: blanks: what context may turn out to be an identifier.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20(?=[().-]*+[0-9])[0-9().-]++(?!\S))*+"
#: Letters and digits that a candidate has at least.
LEAST_CANDIDATE = 4
MARK, STAND_IN = "\x01", "\x02"
_RUN = 256


def scanned(rows: DataFrame, name: str, zero: int, op) -> DataFrame:
    """``rows`` with the array of longs ``name`` replaced by its running sums (or maxima: ``op`` is associative, ``zero`` its start).

    An array is copied at each append. So pieces of _RUN values are run through first, then the pieces' ends, and these
    are added to the pieces: the work grows in proportion to the array, up to arrays of millions.
    """
    run = lambda values: F.aggregate(values, F.array(F.lit(zero).cast("bigint")), lambda done, x: F.array_append(done, op(F.element_at(done, -1), x)))
    starts = F.sequence(F.lit(0), F.greatest(F.size(name) - 1, F.lit(0)), F.lit(_RUN))
    rows = rows.withColumn("pieces_", F.transform(starts, lambda b: run(F.slice(name, b + 1, F.lit(_RUN)))))
    rows = rows.withColumn("before_", run(F.transform("pieces_", lambda p: F.element_at(p, -1))))
    added = F.transform("pieces_", lambda p, i: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: op(x, F.element_at(F.col("before_"), i + 1))))
    # naming before_ twice keeps it a column of its own, computed once a row
    return rows.withColumn(name, F.when(F.size("before_") > 0, F.flatten(added))).drop("pieces_", "before_")


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _parts(text: Column, pattern: str) -> Column:
    """The text cut so that every second part, from the second on, is a match."""
    return F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        n = F.length(digits)
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _held(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _holds(kind, s["value"]))


def with_spans(rows: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds for each name an array of (start, kind, end, value, patterns) of its pattern's matches where its condition holds.

    Code points, end exclusive. ``patterns`` are the words right before the match, as far back as the match before it.
    The parts and their ends are columns of their own: within a lambda function they would be computed anew for each element.
    """
    whole = F.array(F.lit(""))

    def spans(kind: str) -> Column:
        parts, end = F.col(f"parts_{kind}"), F.col(f"ends_{kind}")
        places = F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            places,
            lambda i: F.struct(
                F.element_at(end, i - 1).alias("start"), F.lit(kind).alias("kind"), F.element_at(end, i).alias("end"),
                F.element_at(parts, i).alias("value"), _patterns(F.element_at(parts, i - 1)).alias("patterns"),
            ),
        )

    kept = rows.columns
    rows = rows.withColumns({f"parts_{k}": F.when(needed, _parts(F.col(text), p)).otherwise(whole) for k, (p, needed) in patterns.items()})
    rows = rows.withColumns({f"ends_{k}": F.transform(f"parts_{k}", lambda p: F.length(p).cast("bigint")) for k in patterns})
    for k in patterns:
        rows = scanned(rows, f"ends_{k}", 0, _plus)
    return rows.select(*kept, *[spans(k).alias(k) for k in patterns])


def apart(rows: DataFrame, base: str, other: str) -> DataFrame:
    """``rows`` with the spans of ``other`` that overlap none of ``base``: base spans and others are sorted together by their
    starts; a running maximum of base ends tells what reaches into a span from before, one of base starts from behind what
    begins inside it."""
    none, last = -1, (1 << 62)
    mark = lambda c, k: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), s.alias("span")))
    rows = rows.withColumn("all_", F.array_sort(F.concat(mark(base, 0), mark(other, 1))))
    rows = rows.withColumn("reach_", F.transform("all_", lambda s: F.when(s["k"] == 0, s["end"]).otherwise(none).cast("bigint")))
    rows = rows.withColumn("next_", F.reverse(F.transform("all_", lambda s: F.when(s["k"] == 0, -s["start"]).otherwise(-last).cast("bigint"))))
    rows = scanned(scanned(rows, "reach_", none, F.greatest), "next_", -last, F.greatest).withColumn("next_", F.reverse("next_"))
    free = F.filter("all_", lambda s, i: (s["k"] == 1) & (F.element_at("reach_", i + 1) <= s["start"]) & (-F.element_at("next_", i + 1) >= s["end"]))
    # each running column is named twice, or the optimiser would put its computation into the lambda function
    both = F.size("reach_") + F.size("next_") >= 0
    return rows.withColumn(other, F.when(both, F.transform(free, lambda s: s["span"]))).drop("all_", "reach_", "next_")


def extract(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key_, text_key, base (spans of the fixed patterns), other (candidates that overlap none of them)."""
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    rows = rows.withColumns({"digit_": F.col("text_").rlike("[0-9]"), "at_": F.contains("text_", F.lit("@"))})
    needs = {"email": F.col("at_"), "ip": F.col("digit_"), "card": F.col("digit_"), "phone": F.col("digit_") & F.contains("text_", F.lit("+"))}
    asked = {k: (PATTERNS[k], needs[k]) for k in KINDS} | {"other": (CANDIDATE, F.col("digit_") | F.col("at_"))}
    rows = with_spans(rows.withColumn("text_key", F.md5("text_")), "text_", asked)
    rows = rows.select("key_", "text_key", F.concat(*[_held(F.col(k), k) for k in KINDS]).alias("base"), F.transform("other", _trimmed).alias("other"))
    rows = rows.withColumn("other", F.filter("other", lambda c: F.length(F.regexp_replace(c["value"], r"[^\p{L}0-9]", "")) >= LEAST_CANDIDATE))
    return apart(rows, "base", "other")


def _trimmed(c: Column) -> Column:
    """A candidate without the punctuation around it."""
    value = F.regexp_replace(c["value"], r"^[^\p{L}0-9]+", "")
    start = c["start"] + F.length(c["value"]) - F.length(value)
    value = F.regexp_replace(value, r"[^\p{L}0-9]++$", "")
    return F.struct(start.alias("start"), F.lit("").alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"), c["patterns"].alias("patterns"))


def _patterns(before: Column) -> Column:
    """The last two words before a place, and the last one."""
    last = F.regexp_extract(F.lower(before), r"(?<!\p{L})((?:\p{L}++[^\p{L}]++)?)(\p{L}++)[^\p{L}]*+$", 0)
    words = F.filter(F.split(last, r"[^\p{L}]+"), lambda w: w != "")
    return F.when(F.size(words) == 2, F.array(F.array_join(words, " "), F.element_at(words, 2))).when(F.size(words) == 1, words).otherwise(F.array().cast("array<string>"))


def graph(found: DataFrame) -> DataFrame:
    """Distinct edges (pattern, instance, kind) of seeds and candidates; kind is empty for a candidate."""
    spans = found.select(F.explode(F.concat("base", "other")).alias("s"))
    edges = spans.select(F.explode("s.patterns").alias("pattern"), F.lower("s.value").alias("instance"), F.col("s.kind").alias("kind"))
    return edges.distinct()


def score_patterns(edges: DataFrame, least_score: float, least_support: int) -> DataFrame:
    """(pattern, kind, score, support) of the patterns that hold in the end.

    A pattern's score for a kind is the mean score of its distinct instances; it counts from ``least_support``
    instances known for certain or by other patterns. An instance's score is the best of its counting patterns; seeds
    have 1. Sums are aggregated by key before they are joined; a frequent pattern is one row of the pattern table. Scores
    only grow from round to round and are cut to thousandths, so the rounds end: when the pattern table stays the same.
    """
    seeds = edges.where("kind <> ''").select("pattern", "instance", "kind", F.lit(1.0).alias("score"))
    totals = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    open_edges = edges.where("kind = ''").select("pattern", "instance")
    known, before = seeds, None
    while True:
        sums = known.groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
        best = sums.join(totals, "pattern").withColumn("score", F.floor(F.col("support") / F.col("n") * 1000 + 1e-6) / 1000)
        best = best.where((F.col("score") >= least_score) & (F.col("support") >= least_support))
        best = written(best.select("pattern", "kind", "score", "support"), "patterns")
        state = tuple(best.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern", "kind", F.col("score").cast("decimal(9,3)")).cast("decimal(38,0)"))).first())
        if state == before:
            return best
        before = state
        instances = open_edges.join(best, "pattern").groupBy("instance", "kind").agg(F.max("score").alias("score"))
        known = seeds.unionByName(open_edges.join(instances, "instance").select("pattern", "instance", "kind", "score"))


def find_pii(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_score: float = 0.6, least_support: int = 3,
) -> DataFrame:
    """One row for each row of ``docs``: key, text_key, base and added (arrays of start, kind, end).

    ``base``: spans of the fixed patterns, leftmost and non-overlapping in each kind; IP parts at most 255, cards of 14
    to 19 digits that pass Luhn, phones of 10 to 15 digits; failing matches are dropped. ``added``: words with a digit
    or at sign, with the groups of digits that follow them, of LEAST_CANDIDATE letters and digits at least and overlapping
    no base span, whose context is a pattern that held (``least_score`` is the least share of a pattern's distinct
    instances that is known, ``least_support`` their least number). The work grows in proportion to a text's length. Positions are code points, end
    exclusive. A null or empty text gives empty arrays; repeated rows give a row each, and an instance or text that
    occurs often counts once. Other columns are not read. An empty table gives an empty result.
    """
    found = written(extract(docs, key, text), "pii")
    patterns = score_patterns(written(graph(found), "graph"), least_score, least_support)
    texts = found.where(F.size("other") > 0).select("text_key", "other").distinct()
    places = texts.select("text_key", F.explode("other").alias("s"))
    places = places.select("text_key", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    told = places.join(patterns, "pattern").groupBy("text_key", "start", "end").agg(F.max_by("kind", F.struct("score", "support", "kind")).alias("kind"))
    added = told.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = found.select("key_", "text_key", plain.alias("base")).join(added, "text_key", "left")
    empty = F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")
    return out.select(F.col("key_").alias(key), "text_key", "base", F.coalesce("added", empty).alias("added"))


def digest(spans: Column) -> Column:
    """Lowercase hex SHA-256 of the listed spans."""
    return F.sha2(listed(spans, KINDS), 256)


def mask_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle brackets; columns and rows stay.

    Of overlapping spans the one that starts first (then the longer) names the whole stretch they cover. Rows without
    a find pass unchanged, null texts stay null, repeated rows are masked alike. Other columns stay as they are, whatever
    their names; none of them gets the unmasked text. An empty table gives an empty result.
    """
    found = find_pii(docs, key, text, **options).select("text_key", F.concat("base", "added").alias("spans"))
    found = found.where(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias("spans"))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    # stretches: heads are spans that start where all before them have ended
    found = found.withColumn("spans", order).withColumn("reach", F.transform("spans", lambda s: -s["back"]))
    found = scanned(found, "reach", 0, F.greatest)
    heads = F.filter(F.sequence(F.lit(1), F.size("spans")), lambda i: (i == 1) | (F.element_at("spans", i)["start"] >= F.element_at("reach", F.greatest(i - 1, F.lit(1)))))
    found = found.withColumn("heads", heads)
    end = lambda k: F.element_at("reach", F.coalesce(F.get("heads", k + 1) - 1, F.size("reach")))
    stretch = F.transform("heads", lambda i, k: F.struct(F.element_at("spans", i)["start"].alias("start"), end(k).alias("end"), F.element_at("spans", i)["kind"].alias("kind")))
    found = written(found.select("text_key", stretch.alias("stretches")), "stretches")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # texts without a find, told by a bitmap of bounded size, are not moved
    rows = rows.withColumn("text_key", F.md5("text")).withColumn("key", F.xxhash64("text_key"))
    rows = marked(rows, "key", key_bitmap(found.select(F.xxhash64("text_key").alias("key")).distinct()))
    clear = rows.where("not hit_").select("row.*")
    rows = rows.where("hit_").join(found, "text_key", "left")
    rows = rows.withColumn("chars", F.when(F.col("stretches").isNotNull(), F.regexp_extract_all("text", F.lit(r"(?s)."), F.lit(0))))
    cut = lambda a, b: F.array_join(F.slice("chars", (a + 1).cast("int"), (b - a).cast("int")), "")
    before = lambda k: F.coalesce(F.get("stretches", k - 1)["end"], F.lit(0).cast("bigint"))
    pieces = F.transform("stretches", lambda s, k: F.concat(cut(before(k), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    rest = cut(F.element_at("stretches", -1)["end"], F.size("chars").cast("bigint"))
    # an array of characters is made once a row, in a column of its own
    masked = F.when(F.col("chars").isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("row")[text])
    return clear.unionByName(rows.select(*[(masked.alias(c) if c == text else F.col("row")[c].alias(c)) for c in docs.columns]))
