"""Byte-pair encoding of whole texts with a published vocabulary, merged in batched numpy rounds.

The distinct words of a batch lie in one flat array of symbols. In each round the rank of every neighbouring pair is
looked up by binary search over the sorted pair keys, every word merges its lowest-rank pair, all places at once, and
the array is compacted, until no pair of any word is known.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freeing

#: Encoded chunks kept by a worker between batches; the table is emptied when it is full.
MAX_KEPT_CHUNKS = 100_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class WordBpe:
    """A tokenizer of the kind "normalise, split to words, bytes, merges, word-end suffix" from its JSON description."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in [*vocab.items(), *specials.items()]}
        self.names = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.digits = [str(i) for i in range(len(self.names))]
        self.specials = specials
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True))) if specials else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in self.letters])
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in self.letters])
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def normalised(self, text: str) -> str:
        """NFC and lower case, each character by itself (no final sigma). White space only parts words, so it stays."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str | int]:
        """The parts of a text between blanks, in order; special tokens, found in the text as written, as their ids."""
        if not self.special or "<" not in text or not self.special.search(text):
            return self.normalised(text).replace("\n", " ").split(" ")
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.chunks(text[at : m.start()])
            out.append(self.specials[m.group()])
            at = m.end()
        return out + self.chunks(text[at:])

    def words(self, chunk: str) -> list[str]:
        """The words of a normalised chunk. Characters that Unicode has not assigned yet count as symbols."""
        if not chunk.isascii() and any(unicodedata.category(c) == "Cn" for c in chunk):
            shown = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in chunk)
            return [chunk[m.start() : m.end()] for m in self.pattern.finditer(shown)]
        return self.pattern.findall(chunk)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the offsets of each word in them, by merge rounds over all words at once."""
        data = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        word = np.repeat(np.arange(len(data)), sizes)
        symbols = self.inner[raw]
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbols[last] = self.final[raw[last]]
        known = symbols >= 0
        symbols, word = symbols[known], word[known]
        done_symbols, done_word = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            if len(symbols) > 1:
                key = symbols[:-1] * self.width + symbols[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                rank[:-1][hit] = self.ranks[at[hit]]
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.append(heads, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, heads), counts)
            over = best == _NONE
            if over.any():  # words with no pair left leave the array
                done_symbols.append(symbols[over])
                done_word.append(word[over])
                live = ~over
                symbols, word, rank, best = symbols[live], word[live], rank[live], best[live]
                if not len(symbols):
                    break
            here = rank == best
            # of overlapping equal pairs (a a a) every second place merges, from the left
            follows = np.concatenate([[False], here[1:] & here[:-1]])
            if follows.any():
                place = np.arange(len(here))
                run_start = np.maximum.accumulate(np.where(here & ~follows, place, 0))
                here &= (place - run_start) % 2 == 0
            symbols[here] = self.merged[rank[here]]
            keep = np.concatenate([[True], ~here[:-1]])
            symbols, word = symbols[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbols)[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def decode(self, ids: list[int]) -> str:
        """The tokens' names joined by a space, as a description without a decoder says."""
        return " ".join([self.names[i] for i in ids])


@functools.lru_cache(maxsize=1)
def loaded(description: str) -> WordBpe:
    """One tokenizer for all tasks of a Python worker."""
    return WordBpe(description)


def encode(docs: DataFrame, description: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, ids (array of int), decoded (string).

    ``description`` is the content of a tokenizer's JSON file, which the caller reads: its size does not depend on the
    data, and executors need no file. A null or empty text gives no ids and an empty decoded text. Repeated rows are
    encoded each; other columns are not read. No shuffle.
    """
    return _run(docs, description, key, text, "ids array<int>, decoded string", _whole)


def encode_digests(docs: DataFrame, description: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode``, with n_tokens and the SHA-256 of the ids (decimal, one space between) and of the decoded text."""
    return _run(docs, description, key, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)


def _whole(parts: list[tuple[int, str, str]]) -> dict:
    """parts: for each chunk of a text the number of ids, the ids and their names."""
    ids = " ".join([p[1] for p in parts if p[0]])
    return {"ids": np.array(ids.split(" ") if ids else [], dtype=np.int32), "decoded": " ".join([p[2] for p in parts if p[0]])}


def _digests(parts: list[tuple[int, str, str]]) -> dict:
    counts, ids, names = zip(*parts, strict=True) if parts else ((), (), ())
    sha = lambda texts: hashlib.sha256(" ".join(filter(None, texts)).encode("utf-8", "replace")).hexdigest()
    return {"n_tokens": sum(counts), "ids_sha256": sha(ids), "decoded_sha256": sha(names)}


def encode_chunks(bpe: WordBpe, chunks: list[str | int], kept: dict) -> None:
    """Puts what ``_whole`` needs of each chunk into ``kept``; all their distinct words are merged together."""
    split = [bpe.words(c) if isinstance(c, str) else [] for c in chunks]
    words = list({w for ws in split for w in ws})
    ids, at = bpe.encode_words(words)
    ids, at = ids.tolist(), at.tolist()
    names, digits = [bpe.names[i] for i in ids], [bpe.digits[i] for i in ids]
    ends = dict(zip(words, zip(at, at[1:], strict=False), strict=True))
    for c, ws in zip(chunks, split, strict=True):
        if len(ws) == 1:
            a, b = ends[ws[0]]
            kept[c] = (b - a, " ".join(digits[a:b]), " ".join(names[a:b]))
        elif ws:
            places = [i for w in ws for i in range(*ends[w])]
            kept[c] = (len(places), " ".join([digits[i] for i in places]), " ".join([names[i] for i in places]))
        else:
            kept[c] = (1, bpe.digits[c], bpe.names[c]) if isinstance(c, int) else (0, "", "")


def _run(docs: DataFrame, description: str, key: str, text: str, columns: str, shape) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(description)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, kept = loaded(shared.value), {}
        for rows in batches:
            start = 0
            sizes = rows.text_.str.len().cumsum().to_numpy()
            while start < len(rows):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + (1 << 20), "right")))
                part = rows.iloc[start:end]
                start = end
                texts = [bpe.chunks(t) for t in part.text_]
                if len(kept) > MAX_KEPT_CHUNKS:
                    kept.clear()
                new = list({c for chunks in texts for c in chunks if c not in kept})
                for a in range(0, len(new), 50_000):
                    encode_chunks(bpe, new[a : a + 50_000], kept)
                yield pd.DataFrame([{"key_": k, **shape([kept[c] for c in chunks])} for k, chunks in zip(part.key_, texts, strict=True)])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    return out.mapInPandas(freeing(run), f"key_ {kind}, {columns}").withColumnRenamed("key_", key)
