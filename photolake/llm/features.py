"""Dense features of whole texts, from the flat word arrays of ``words``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import bounds, hashes, lowered, mix, raw, word_hash

#: Bytes of a word that count as its stem, besides the whole word (0).
STEMS = (0, 4, 5, 7)
#: Words of address to a second person in four languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "vous", "votre", "ton", "ta", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tú", "ti", "usted", "ustedes", "vosotros", "tus", "su")
NEAR = 5

_lut = lambda chars: np.isin(np.arange(256), np.frombuffer(chars.encode("latin-1"), np.uint8))
_UPPER, _DIGIT = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("0123456789")
_LETTER = _UPPER | _lut("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_BLANK, _PLAIN = _lut(" \t\r\n"), _lut(".,;:'\"?-()")
_ODD = ~(_LETTER | _DIGIT | _BLANK | _PLAIN | _lut("!|_"))
_MASKING = _lut("*@$#!0123456789")


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1.0)


class Texts:
    """A column's bytes, words and counts, computed once for all features."""

    def __init__(self, column: pa.Array):
        self.data, self.at = lowered(column)
        self.starts, self.ends = bounds(self.data, self.at)
        self.to = np.searchsorted(self.starts, self.at)
        self.hashed = hashes(self.data, self.starts, self.ends)
        self.n = np.diff(self.to).astype(np.float64)
        self.plain, self.plain_at = raw(column)

    def share(self, lut: np.ndarray) -> np.ndarray:
        return _per_row(lut[self.plain], self.plain_at)

    def tokens(self, stem: int) -> np.ndarray:
        """A hash of each word or stem; those of different stem lengths differ. Words that are no longer than it have none (0)."""
        if not stem:
            return self.hashed
        out = mix(hashes(self.data, self.starts, np.minimum(self.ends, self.starts + stem)), 100 + stem)
        return np.where(self.ends - self.starts > stem, out, np.uint64(0))

    def first_of_row(self) -> np.ndarray:
        mask = np.zeros(len(self.starts) + 1, dtype=bool)
        mask[self.to] = True
        return mask[:-1]


QUALITY = ("odd", "bang", "bar", "upper", "digit", "plain", "repeated", "distinct", "line_repeat", "word_length", "log_words", "log_line")


def quality_features(column: pa.Array) -> np.ndarray:
    """Columns QUALITY; all 0 for an empty text but for the shares of what is there."""
    t = Texts(column)
    chars = np.diff(t.plain_at).astype(np.float64)
    letters = t.share(_LETTER)
    again = np.zeros(len(t.hashed), dtype=bool)
    again[1:] = t.hashed[1:] == t.hashed[:-1]
    again &= ~t.first_of_row()
    distinct, lines = np.zeros(len(chars)), np.zeros(len(chars))
    breaks = np.flatnonzero(t.plain == 10)
    lo = np.searchsorted(breaks, t.plain_at)
    for i in range(len(chars)):
        own = t.hashed[t.to[i] : t.to[i + 1]]
        # of every run of 50 words the share that is new in it: does not fall with the length of a text
        whole = len(own) // 50 * 50
        if whole:
            runs = np.sort(own[:whole].reshape(-1, 50), axis=1)
            distinct[i] = 1 - (runs[:, 1:] == runs[:, :-1]).mean()
        elif len(own):
            distinct[i] = len(np.unique(own)) / len(own)
        if lo[i + 1] > lo[i]:
            cut = [*(breaks[lo[i] : lo[i + 1]] - t.plain_at[i]).tolist()]
            text = t.plain[t.plain_at[i] : t.plain_at[i + 1]].tobytes()
            split = [x for x in (text[a:b].strip() for a, b in zip([0, *cut], [*cut, len(text)], strict=True)) if x]
            lines[i] = 1 - len(set(split)) / max(1, len(split))
    word_chars = _per_row(np.concatenate([t.ends - t.starts]), t.to)
    n_lines = np.diff(lo) + 1.0
    return np.stack([
        np.log1p(20 * _over(t.share(_ODD), chars)), np.log1p(20 * _over(t.share(_lut("!")), t.n)), np.log1p(20 * _over(t.share(_lut("|")), t.n)),
        _over(t.share(_UPPER), letters), _over(t.share(_DIGIT), chars), _over(t.share(_PLAIN), chars),
        np.log1p(20 * _over(_per_row(again, t.to), t.n)), distinct, lines, np.minimum(_over(word_chars, t.n), 30.0) / 10,
        np.log1p(t.n) / 10, np.log1p(_over(t.n, n_lines)) / 5,
    ], axis=1)


TOXICITY = ("seeds", "seed_density", "learned", "learned_density", "learned_weight", "distinct", "second_person", "near_second_person", "upper", "upper_words", "bang", "question", "punctuation", "obfuscated", "stretched", "log_words")


class Lexicon:
    """Seed words, and learned words and stems with their weights (log odds), as sorted hashes."""

    def __init__(self, seeds: tuple[str, ...], learned: dict[int, float]):
        self.seeds = np.sort(np.array([word_hash(w) for w in seeds], dtype=np.uint64))
        keys = np.array(sorted(learned), dtype=np.uint64)
        self.keys, self.weights = keys, np.array([learned[int(k)] for k in keys])
        self.you = np.sort(np.array([word_hash(w) for w in SECOND_PERSON], dtype=np.uint64))

    @staticmethod
    def _place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(x), np.int64), np.zeros(len(x), dtype=bool)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return at, table[at] == x

    def features(self, column: pa.Array) -> np.ndarray:
        """Columns TOXICITY; all 0 for an empty text."""
        t = Texts(column)
        seed = self._place(self.seeds, t.hashed)[1]
        weight = np.zeros(len(t.hashed))
        for stem in STEMS:
            at, hit = self._place(self.keys, t.tokens(stem))
            if len(self.keys):
                weight = np.maximum(weight, np.where(hit, self.weights[at], 0.0))
        hit = seed | (weight > 0)
        you = self._place(self.you, t.hashed)[1]
        row = np.repeat(np.arange(len(t.n)), t.n.astype(np.int64))
        reach = np.zeros(len(you) + 1, dtype=np.int64)
        np.cumsum(you, out=reach[1:])
        place = np.arange(len(you))
        near = hit & (reach[np.minimum(place + NEAR + 1, t.to[1:][row])] > reach[np.maximum(place - NEAR, t.to[:-1][row])])
        pairs = np.unique(np.stack([row[hit].astype(np.uint64), t.hashed[hit]]), axis=1)[0].astype(np.int64) if hit.any() else np.zeros(0, np.int64)
        p = t.plain
        masked = np.zeros(len(p), dtype=bool)
        stretched = np.zeros(len(p), dtype=bool)
        if len(p) > 2:
            masked[1:-1] = _MASKING[p[1:-1]] & _LETTER[p[:-2]] & _LETTER[p[2:]]
            stretched[2:] = _LETTER[p[2:]] & (p[2:] == p[1:-1]) & (p[1:-1] == p[:-2]) & (p[2:] < 128)
        letters, chars = t.share(_LETTER), np.diff(t.plain_at).astype(np.float64)
        # of the words as written: lower case may change the length of a text
        start, end = bounds(p, t.plain_at)
        up = np.concatenate([[0], np.cumsum(_UPPER[p])])
        caps = (up[end] - up[start] == end - start) & (end - start > 1)
        written_at = np.searchsorted(start, t.plain_at)
        per_word = lambda m: _over(_per_row(m, t.to), t.n)
        count = lambda m: _per_row(m, t.to)
        return np.stack([
            count(seed), 100 * per_word(seed), count(weight > 0), 100 * per_word(weight > 0), np.add.reduceat(np.append(weight, 0.0), np.minimum(t.to[:-1], len(weight))) * (t.n > 0),
            np.bincount(pairs, minlength=len(t.n)).astype(np.float64), 100 * per_word(you), count(near), _over(t.share(_UPPER), letters), _over(_per_row(caps, written_at), np.diff(written_at).astype(np.float64)),
            _over(t.share(_lut("!")), t.n), _over(t.share(_lut("?")), t.n), _over(t.share(_PLAIN | _ODD), chars), _over(_per_row(masked, t.plain_at), t.n), _over(_per_row(stretched, t.plain_at), t.n), np.log1p(t.n),
        ], axis=1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, keep, most: int) -> DataFrame:
    """(key_, text_, label): labelled texts whose key ``keep`` admits, about ``most`` at the most, chosen by a hash of the key.

    A key that is labelled several times counts once, with its highest label; of several texts of a key the smallest
    counts. The sample's keys are few enough to be broadcast.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & keep(key))
    known = known.groupBy(F.col(key).alias("key_")).agg(F.max(label).cast("int").alias("label"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("key_"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1))))
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    return rows.join(F.broadcast(chosen), "key_").groupBy("key_").agg(F.min("text_").alias("text_"), F.max("label").alias("label"))
