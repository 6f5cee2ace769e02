"""URL allow and block lists: a trie over reversed host labels and path segments, longest match wins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freeing

#: A rule list up to this size is broadcast as a trie; a longer one is joined on host suffixes.
MAX_BROADCAST_RULES = 200_000


class Trie:
    """Host labels from the right, then whole path segments; a rule's last, open segment is kept as a prefix."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            *whole, rest = path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            kept = node.setdefault("", {})
            # of two equal rules the blocking one holds
            if kept.get(rest, ("", ""))[1] != "block":
                kept[rest] = (host + path, verdict)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule and verdict with the longest host, and of those the longest path."""
        node, tops = self.root, []
        if "/" in node:
            tops.append(node["/"])
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                tops.append(node["/"])
        segments = path.split("/")
        for node in reversed(tops):
            best = None
            for k, segment in enumerate(segments):
                here = node.get("", ())
                for rest in sorted(here, key=len, reverse=True):
                    if (segment if k == len(segments) - 1 else segment + "/").startswith(rest):
                        best = here[rest]
                        break
                node = node.get("/" + segment) if k < len(segments) - 1 else None
                if node is None:
                    break
            if best:
                return best
        return None


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return urls.withColumns(
        {"host": F.coalesce(F.translate(host, upper, lower), F.lit("")), "path": F.coalesce(path, F.lit(""))}
    )


def judge_urls(
    urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
    max_broadcast_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``urls``.

    ``rules`` has columns verdict (allow or block), host, path. A rule fits its host and all subdomains if the URL's
    path starts with the rule's. The longest host wins, then the longest path; of equal rules block wins. Where no
    rule fits, rule is null and verdict is ``default``. A null URL, or one without ``://``, has empty host and path.
    Repeated rows and keys are judged each. The rule count is checked: at most ``max_broadcast_rules`` rules are
    broadcast as a trie, more are met by an equi-join on host suffixes.
    """
    parts = split_url(urls.select(F.col(key).alias("key_"), F.col(url).alias("url_")), "url_").drop("url_")
    rules = rules.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    some = rules.limit(max_broadcast_rules + 1).collect()
    if len(some) <= max_broadcast_rules:
        out = _by_trie(parts, [tuple(r) for r in some])
    else:
        out = _by_join(parts, rules)
    return out.select(F.col("key_").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _by_trie(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    shared = parts.sparkSession.sparkContext.broadcast(rules)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for rows in batches:
            found = [trie.longest(h, p) or (None, None) for h, p in zip(rows.host, rows.path, strict=True)]
            yield rows.assign(rule=[x[0] for x in found], verdict=[x[1] for x in found])

    kind = parts.schema["key_"].dataType.simpleString()
    return parts.mapInPandas(freeing(look_up), f"key_ {kind}, host string, path string, rule string, verdict string")


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each distinct (host, path) meets the rules of its host suffixes; the best one is a map-side combined maximum."""
    urls = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.array_append(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")), F.lit(""))
    tried = urls.withColumn("suffix", F.explode(F.array_distinct(suffixes)))
    listed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("said"))
    met = tried.join(listed, "suffix").where(F.startswith("path", "start"))
    rank = F.struct(F.length("suffix").alias("h"), F.length("start").alias("p"), (F.col("said") == "block").cast("int").alias("b"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "start").alias("rule"), F.col("said").alias("verdict")), rank).alias("x"))
    best = best.select("host", "path", "x.rule", "x.verdict")
    return parts.join(best, ["host", "path"], "left").select("key_", "host", "path", "rule", "verdict")
