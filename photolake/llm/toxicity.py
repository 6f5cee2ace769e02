"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The labelled texts are dealt to three parts by a hash of their keys: one teaches the lexicon (words and stems that
toxic texts have and others have not), one the trees, one the calibration, so that none is fooled by what another
learned by heart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import STEMS, Lexicon, Texts, labelled_sample
from .shared import crc_mod, freeing, written
from .words import pieces

#: Most labelled texts that are learned from, and most learned entries of the lexicon.
MAX_LABELLED, MAX_LEXICON = 20_000, 20_000
TREES, DEPTH, STEP, SEED = 20, 3, 0.3, 3
REJECT_FROM = 0.5
# Insults that are known before anything is learned.
SEED_WORDS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "trash", "scum", "clown", "pathetic", "worthless", "disgusting", "imbecile", "jerk", "fool", "filth", "garbage", "vermin", "creep", "freak", "liar", "pig", "shut")


def learn_lexicon(sample: DataFrame, most: int = MAX_LEXICON, least_docs: int = 4, least_odds: float = 1.5) -> dict[int, float]:
    """Hash to log odds of the words and stems that stand in ``least_docs`` toxic texts at least, each text counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, labels = [], []
        for batch in batches:
            for part in pieces(batch, "text_"):
                t = Texts(part.column(1))
                label = part.column(2).to_numpy(zero_copy_only=False)
                by_stem = [t.tokens(s) for s in STEMS]
                for i in range(part.num_rows):
                    own = np.unique(np.concatenate([x[t.to[i] : t.to[i + 1]] for x in by_stem]))
                    tokens.append(own[own > 0])
                    labels.append(np.full(len(tokens[-1]), label[i], np.int64))
        if tokens:
            token, at = np.unique(np.concatenate(tokens), return_inverse=True)
            label = np.concatenate(labels)
            bad, all_ = np.bincount(at, label == 1, len(token)), np.bincount(at, minlength=len(token))
            for a in range(0, len(token), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(token[s].view(np.int64)), pa.array(bad[s].astype(np.int64)), pa.array(all_[s].astype(np.int64))], ["token", "bad", "n"])

    sizes = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    total, toxic = sizes[0], sizes[1] or 0
    if not toxic or toxic == total:
        return {}
    counts = sample.mapInArrow(freeing(count), "token long, bad long, n long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    bad, good = F.col("bad"), F.col("n") - F.col("bad")
    odds = F.log((bad + 0.5) / (toxic + 1.0)) - F.log((good + 0.5) / (total - toxic + 1.0))
    best = counts.where(bad >= min(least_docs, max(2, toxic // 8))).withColumn("odds", odds).where(F.col("odds") >= least_odds)
    rows = best.orderBy(F.desc("odds"), F.desc("bad"), "token").limit(most).collect()
    return {int(np.int64(r.token).view(np.uint64)): float(r.odds) for r in rows}


def with_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` (text_ and others) with ``x``, an array of the features, in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    rest = [c for c in rows.columns if c != "text_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text_"):
                names = part.schema.names
                x = shared.value.features(part.column(names.index("text_")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in rest], lists], [*rest, "x"])

    kind = T.StructType([*[rows.schema[c] for c in rest], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(freeing(run), kind)


class Model:
    """The lexicon, the trees and the calibration; ``trees`` is None where all labels are the same."""

    def __init__(self, sample: DataFrame, max_lexicon: int = MAX_LEXICON, seed: int = SEED):
        sample = written(sample, "labelled")
        part = F.pmod(F.xxhash64("key_", F.lit(seed)), F.lit(20))
        self.lexicon = Lexicon(SEED_WORDS, learn_lexicon(sample.where(part < 9), max_lexicon))
        rows = written(with_features(sample.where(part >= 9).withColumn("part", part), self.lexicon), "features")
        rows = rows.select("part", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features")).coalesce(4).cache()
        sizes = rows.where("part < 16").agg(F.count(F.lit(1)), F.sum("label")).first()
        self.rate = (sizes[1] or 0) / max(sizes[0], 1)
        self.trees = self.calibration = None
        if 0 < self.rate < 1:
            trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=seed, minInstancesPerNode=5)
            self.trees = trees.fit(rows.where("part < 16"))
            tried = self.trees.transform(rows.where("part >= 16")).select("label", self._chance().alias("chance"))
            self.calibration = IsotonicRegression(labelCol="label", featuresCol="chance").fit(tried)
        rows.unpersist()

    @staticmethod
    def _chance():
        return vector_to_array("probability")[1]

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score`` in place of the text."""
        keep = [c for c in rows.columns if c != "text_"]
        if not self.trees:
            return rows.select(*keep, F.lit(float(self.rate)).alias("score"))
        x = with_features(rows, self.lexicon).select(*keep, array_to_vector("x").alias("features"))
        scored = self.trees.transform(x).select(*keep, self._chance().alias("chance"))
        scored = self.calibration.transform(scored)
        # steps of the calibration keep their order by a small share of the uncalibrated chance
        score = 0.98 * F.col("prediction") + 0.02 * F.col("chance")
        return scored.select(*keep, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    return Model(labelled_sample(docs, labels, label, key, text, lambda k: crc_mod(k, 5) != 0, max_labelled))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    Learned from at most about ``max_labelled`` labelled texts whose key's fold (crc32 of its text modulo 5) is not 0;
    ``held_out`` tells the rows of fold 0. Only the text is scored. ``score`` is from 0 to 1, ``predicted`` 1 from
    REJECT_FROM on. A null text counts as empty; empty texts are scored like any other; equal texts score equally. A
    row without a key is scored, with held_out false. Null labels and labels without a key are passed over. Where the
    labels are all alike, or there is none, every text scores their rate (0 for none). Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    scored = learn(docs, labels, key, text, label, max_labelled).score(rows)
    held = F.coalesce(crc_mod("key_", 5) == 0, F.lit(False))
    return scored.select(F.col("key_").alias(key), held.alias("held_out"), "score", (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> DataFrame:
    """``docs`` without the rows that the model rejects; rows without a text are judged as empty ones, each by its text alone.

    Columns stay as they are, whatever their names; repeated rows stay or go together. An empty table gives an empty result.
    """
    model = learn(docs, labels, key, text, label, **options)
    scored = model.score(docs.select(F.struct("*").alias("row_"), F.coalesce(F.col(text), F.lit("")).alias("text_")))
    return scored.where(F.col("score") < REJECT_FROM).select("row_.*")
