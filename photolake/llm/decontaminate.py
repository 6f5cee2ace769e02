"""Benchmark decontamination: an inverted index of test items under BM25, asked by every passage of the training texts.

Passages are overlapping windows of words, long enough that every item lies whole within one. An item's score is
divided by the score that the item itself would get, so 1 means that all its words are there. Block-max WAND prunes: the
frequent terms of an item whose weights together stay under the threshold cannot bring it in alone, so only the other
(essential) terms are looked for; items are grouped to blocks, and a passage opens a block only if the block's largest
weights of the passage's essential terms, with the most that the frequent ones could add, reach the threshold. The items
of opened blocks are scored from the posting lists of the passage's terms in these blocks. The bounds of all passages of a
batch are computed at once. What is retrieved is verified by the overlap of word shingles with the item's question part
and with its answer part; of an answer under SHORT_ANSWER words, in which one edit would spoil most shingles, the words
count. Document frequencies, mean and largest length are those of all items, however many indexes hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import freeing, key_bitmap, marked, written
from .words import bounds, hashes, lowered, pieces, shingles, words

THRESHOLD, OVERLAP, SHINGLE, LEAST_WINDOW = 0.6, 0.5, 5, 128
#: Items, and bytes of their texts, of one index; a longer list is cut to several indexes, each asked by all passages.
MAX_ITEMS, MAX_BYTES = 20_000, 32 << 20
#: Answers of fewer words are compared word by word.
SHORT_ANSWER = 10
K1, B = 1.2, 0.75
#: Share of the threshold that the frequent terms of an item may bring in unseen. More makes fewer terms essential, less
#: makes tighter bounds; any share under 1 gives the same results.
FREE = 0.6
MOST_BLOCKS = 64
_FILTER_BITS = 20


@dataclass
class Item:
    key: int
    terms: np.ndarray
    weights: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    by_words: bool


@dataclass
class Counts:
    """Of all items: their number, mean and largest number of words, and the document frequencies of some terms (sorted hashes)."""

    items: int
    mean: float
    largest: int
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Counts:
        hashed, to = words(pa.array(texts, pa.large_string()))
        sizes = np.diff(to)
        own = [np.unique(hashed[to[i] : to[i + 1]]) for i in range(len(texts))]
        terms, df = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]).astype(np.uint64), return_counts=True)
        return cls(len(texts), float(sizes.mean()) if len(sizes) else 0.0, int(sizes.max(initial=0)), terms, df)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer; an item of one sentence is cut after two thirds of its words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if len(spans) < 2:
        return text, text
    at = spans[max(1, (2 * len(spans) + 2) // 3) - 1][1]
    return text[:at], text[at:]


def _shingle_set(text: str) -> np.ndarray:
    return np.unique(shingles(*words(pa.array([text])), SHINGLE)[0])


class Index:
    """Inverted index of a bounded list of (key, text); picklable, built anew by each worker from the texts."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, counts: Counts | None = None):
        self.threshold = threshold
        counts = counts or Counts.of([t for _, t in items])
        data, at = lowered(pa.array([t for _, t in items], pa.large_string()))
        starts, ends = bounds(data, at)
        hashed, to = hashes(data, starts, ends), np.searchsorted(starts, at)
        self.vocabulary, term = np.unique(hashed, return_inverse=True)
        length = np.zeros(len(self.vocabulary))
        np.maximum.at(length, term, ends - starts)
        sizes = np.diff(to)
        self.window = max(LEAST_WINDOW, 2 * counts.largest)
        own = [np.unique(term[to[i] : to[i + 1]], return_counts=True) for i in range(len(items))]
        df = counts.df[np.searchsorted(counts.terms, self.vocabulary)] if len(self.vocabulary) else np.zeros(0)
        idf = np.log(1 + (counts.items - df + 0.5) / (df + 0.5))
        mean = max(counts.mean, 1)
        blocks = min(MOST_BLOCKS, max(1, len(items) // 8))
        self.block_of = np.arange(len(items)) * blocks // max(len(items), 1)
        self.block_max = np.zeros((len(self.vocabulary), blocks), dtype=np.float32)
        self.rest_max = np.zeros(blocks, dtype=np.float32)
        essential = np.zeros(len(self.vocabulary), dtype=bool)
        self.items: list[Item] = []
        for k, (key, text) in enumerate(items):
            t, count = own[k]
            w = idf[t] * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[k] / mean))
            w = w / w.sum() if len(w) else w
            # from the lightest term on (of equal ones short words first): as many as stay under the threshold
            order = np.lexsort([length[t], w])
            rest = np.cumsum(w[order]) < FREE * threshold
            needed, free = order[~rest], order[rest]
            essential[t[needed]] = True
            b = self.block_of[k]
            np.maximum.at(self.block_max[:, b], t[needed], w[needed].astype(np.float32))
            self.rest_max[b] = max(self.rest_max[b], w[free].sum())
            question, answer = question_and_answer(text)
            by_words = 0 < len(answer_words := words(pa.array([answer]))[0]) < SHORT_ANSWER
            self.items.append(Item(key, t, w, _shingle_set(question), np.unique(answer_words) if by_words else _shingle_set(answer), by_words))
        self.essential = essential
        # posting lists: for each block and term the items and weights
        block = np.repeat(self.block_of, [len(i.terms) for i in self.items]) if items else np.zeros(0, np.int64)
        place = block * max(len(self.vocabulary), 1) + np.concatenate([*[i.terms for i in self.items], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(place, kind="stable")
        self.lists, starts = np.unique(place[order], return_index=True)
        self.list_at = np.append(starts, len(order))
        self.list_item = np.repeat(np.arange(len(items)), [len(i.terms) for i in self.items])[order] if items else np.zeros(0, np.int64)
        self.list_weight = np.concatenate([*[i.weights for i in self.items], np.zeros(0)])[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[self._low(self.vocabulary[essential])] = True

    @staticmethod
    def _low(hashed: np.ndarray) -> np.ndarray:
        return (hashed & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def _terms(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and term numbers of the hashes that the vocabulary has."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        found = np.flatnonzero(self.vocabulary[at] == hashed)
        return found, at[found]

    def opened(self, hashed: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, window, block) that the bounds do not rule out."""
        none = np.zeros(0, np.int64)
        if not len(self.vocabulary) or not len(hashed):
            return none, none, none
        stride = self.window // 2
        near = np.flatnonzero(self.maybe[self._low(hashed)])
        found, term = self._terms(hashed[near])
        held = self.essential[term]
        place, term = near[found[held]], term[held]
        row = np.searchsorted(to, place, "right") - 1
        last = (place - to[row]) // stride
        windows = -(-np.diff(to) // stride)  # windows start at each stride
        first_window = np.concatenate([[0], np.cumsum(windows)])
        number = first_window[row] + last
        number = np.concatenate([number, number[last > 0] - 1])
        term = np.concatenate([term, term[last > 0]])
        pairs = np.unique(number * len(self.vocabulary) + term)
        number, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        rows, wins, blocks = [none], [none], [none]
        heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else none
        for a in range(0, len(heads), 20_000):
            some = heads[a : a + 20_000]
            end = heads[a + 20_000] if a + 20_000 < len(heads) else len(number)
            bound = np.add.reduceat(self.block_max[term[some[0] : end]], some - some[0], axis=0) + self.rest_max
            i, b = np.nonzero(bound >= self.threshold - 1e-4)
            n = number[some[i]]
            r = np.searchsorted(first_window, n, "right") - 1
            rows.append(r), wins.append(n - first_window[r]), blocks.append(b)
        return np.concatenate(rows), np.concatenate(wins), np.concatenate(blocks)

    def scores(self, terms: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of ``blocks`` that share a term with the passage, and their scores, from the posting lists."""
        asked = (blocks[:, None] * len(self.vocabulary) + terms[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.lists, asked), len(self.lists) - 1)
        at = at[self.lists[at] == asked]
        first, sizes = self.list_at[at], self.list_at[at + 1] - self.list_at[at]
        one = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(at) else at
        items, which = np.unique(self.list_item[one], return_inverse=True)
        return items, np.bincount(which, self.list_weight[one], len(items))

    def query(self, column: pa.Array, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item number, score, question overlap, answer overlap) of the best verified passage of each row and item."""
        hashed, to = words(column)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        rows, windows, blocks = self.opened(hashed, to)
        if not len(rows):
            return
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (windows[1:] != windows[:-1])]))
        for first, end in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            row = int(rows[first])
            a = to[row] + int(windows[first]) * (self.window // 2)
            part, own = hashed[a : min(a + self.window, to[row + 1])], None
            items, scores = self.scores(np.unique(self._terms(part)[1]), blocks[first:end])
            for k, score in zip(items[scores >= self.threshold].tolist(), scores[scores >= self.threshold].tolist(), strict=True):
                if best.get((row, k), (0.0,))[0] >= score:
                    continue
                item, own = self.items[k], part_shingles(part) if own is None else own
                q = np.isin(item.question, own).mean() if len(item.question) else 0.0
                ans = np.isin(item.answer, part if item.by_words else own).mean() if len(item.answer) else 0.0
                if q >= overlap and ans >= overlap:
                    best[row, k] = (score, float(q), float(ans))
        for (row, k), found in best.items():
            yield row, int(k), *found


def part_shingles(hashed: np.ndarray) -> np.ndarray:
    """Shingles of a passage of every size that a question or an answer can have."""
    sizes = [shingles(hashed, np.array([0, len(hashed)]), SHINGLE)[0]]
    for n in range(1, SHINGLE):
        if len(hashed) >= n:
            at = np.arange(0, len(hashed) - n + 1)
            flat = np.concatenate([hashed[i : i + n] for i in at])
            sizes.append(shingles(flat, np.arange(0, len(flat) + 1, n), SHINGLE)[0])
    return np.concatenate(sizes)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap): one row for each text and item that a passage of it holds.

    ``score`` is the passage's BM25 score as a share of the item's own; it and both overlaps (share of five-word
    shingles; a part of fewer words is one shingle; of a short answer the share of its words) are of the best passage that has at least ``threshold`` and twice
    ``overlap``. Null and empty texts and items match nothing. Repeated rows of ``docs`` are judged each, repeated
    items once. Other columns are not read. Empty tables give an empty result. The item list is broadcast in parts of
    about ``max_items`` items and ``max_bytes`` bytes at most, which changes no figure; texts are not shuffled.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-count // max_items), -(-size // max_bytes))
    # hashing deals evenly enough that the bound is taken with room
    numbered = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    tokens = written(numbered.mapInArrow(freeing(_tokens), "part long, term long, words long"), "item-terms")
    df = tokens.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    mean, largest = tokens.where("term is null").agg(F.coalesce(F.avg("words"), F.lit(0.0)), F.coalesce(F.max("words"), F.lit(0))).first()
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    out = None
    for k in range(parts):
        listed = [tuple(r) for r in numbered.where(F.col("part") == k).select("item", "text").orderBy("item", "text").collect()]
        # the terms of a part's items, of bounded number like these
        own = tokens.where((F.col("part") == k) & F.col("term").isNotNull()).select("term").distinct().join(df, "term").toPandas()
        terms = own["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(terms)
        found = _ask(rows, listed, Counts(count, mean, largest, terms[order], own["df"].to_numpy(np.int64)[order]), threshold, overlap)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("key_").alias(key), F.col("item").alias(item), "score", "question_overlap", "answer_overlap")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term, null) for each distinct term of an item and (part, null, words) for each item."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            hashed, to = words(piece.column(1))
            own = [np.unique(hashed[to[i] : to[i + 1]]).view(np.int64) for i in range(piece.num_rows)]
            part = piece.column(2).to_numpy(zero_copy_only=False)
            term = np.concatenate([*own, np.zeros(piece.num_rows, np.int64)])
            none = np.arange(len(term)) >= len(term) - piece.num_rows
            sizes = np.concatenate([np.zeros(len(term) - piece.num_rows, np.int64), np.diff(to)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.repeat(part, [len(o) for o in own]), part]), pa.int64()), pa.array(term, pa.int64(), mask=none), pa.array(sizes, pa.int64(), mask=~none)], ["part", "term", "words"])


def _ask(rows: DataFrame, items: list[tuple[int, str]], counts: Counts, threshold: float, overlap: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((items, counts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value[0], threshold, shared.value[1])
        for batch in batches:
            for part in pieces(batch, "text_"):
                found = list(index.query(part.column(1), overlap))
                if found:
                    row, item, *figures = zip(*found, strict=True)
                    keys = part.column(0).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([index.items[i].key for i in item], pa.int64()), *[pa.array(f, pa.float64()) for f in figures]], ["key_", "item", "score", "question_overlap", "answer_overlap"])

    kind = T.StructType([rows.schema["key_"], *[T.StructField(n, t) for n, t in (("item", T.LongType()), ("score", T.DoubleType()), ("question_overlap", T.DoubleType()), ("answer_overlap", T.DoubleType()))]])
    return rows.mapInArrow(freeing(ask), kind)


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item; a row without a key is judged by its text like any other.

    Columns stay as they are, whatever their names; repeated rows stay or go together. Null and empty texts stay. An empty
    table gives an empty result. Only rows that a bitmap of bounded size does not clear are moved, to be told by their
    texts' MD5; all others pass.
    """
    rows = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    texts = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    found = find_leaks(texts.select(F.struct("text_key", "key").alias("k"), "text"), benchmark, "k", "text", **options)
    leaks = written(found.select("k.*").distinct(), "leaks")
    rows = marked(rows, "key", key_bitmap(leaks.select("key").distinct()))
    clear = rows.where("not hit_").select("row")
    return clear.unionByName(rows.where("hit_").join(leaks.select("text_key"), "text_key", "left_anti").select("row")).select("row.*")
