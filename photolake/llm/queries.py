"""Queries opN_<name> over the given tables, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, fill_middle, licenses, main_text, minhash, pii, quality, resample, secrets, toxicity, url_filter
from .shared import table

#: Rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def tokenizer_file(path: str | None = None) -> str:
    """Content of the tokenizer's JSON; ``path`` defaults to the published file that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base counts, digest of the base spans, all spans, decoded layers opened."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed(F.concat("base", "added")).alias("spans"), "layers",
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base counts, digest of the base spans, all spans."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in pii.KINDS], pii.digest(F.col("base")).alias("base_sha256"),
        secrets.listed(F.concat("base", "added"), pii.KINDS).alias("spans"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its licence sentences and the licences that the ordered rules find in them."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("matches").cast("bigint").alias("n_matches"), F.array_join("matches", ",").alias("matches"),
    )


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its class of near-duplicates, and if it is the one kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fold, quality score and decision."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token count, digests of the ids and of the decoded text."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fold, toxicity score and decision."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: links at cosine 0.9, component and if it is the one kept."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, the longest rule that fits and its verdict; allow where none fits."""
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, with the best passage's figures."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: features, weight, perturbed score, and its rank if it is drawn."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, form, lengths of prefix and middle, digests of the output and of the text restored from it."""
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: url, main text and its length."""
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
b AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b ON p.page_id = b.page_id AND k = 1"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_pii, op3_license_scan, op4_minhash_dedup, op5_quality, op6_bpe, op7_toxicity, op8_embedding_dedup, op9_url_filter, op10_decontamination, op11_importance_resampling, op12_fill_in_middle, op13_main_text)
}
ORACLES: dict[str, str] = {"op3_license_scan": licenses.oracle_sql(), "op9_url_filter": OP9_SQL, "op11_importance_resampling": resample.SQL, "op12_fill_in_middle": fill_middle.SQL, "op13_main_text": main_text.SQL}
