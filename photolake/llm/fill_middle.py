"""Fill-in-the-middle: documents as piece tables over an immutable text buffer and an immutable buffer of sentinels.

A document is a sequence of descriptors (buffer, first byte, end). Cutting splits descriptors, an arrangement permutes
them, its inverse restores them, and hashes stream over them: no text is copied until it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freeing
from .words import pieces, raw

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Pieces 0 to 2 are prefix, middle and suffix, 3 to 5 the sentinels of prefix, suffix and middle.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
_LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_SLICE = 1 << 20


class PieceTable:
    """Descriptors (buffer, first, end) over ``buffers``, which are never changed; every step makes new descriptors only."""

    def __init__(self, buffers: Sequence, descriptors: Sequence[tuple[int, int, int]]):
        self.buffers, self.descriptors = buffers, list(descriptors)

    def cut(self, places: Sequence[int]) -> PieceTable:
        """The table with a descriptor's end at each place (ascending bytes of the whole, repeats allowed); an empty piece stays one."""
        out, at, left = [], 0, list(places)
        for buffer, first, end in self.descriptors:
            while left and left[0] - at <= end - first:
                here = first + left.pop(0) - at
                out.append((buffer, first, here))
                at, first = at + out[-1][2] - out[-1][1], here
            out.append((buffer, first, end))
            at += end - first
        return PieceTable(self.buffers, out)

    def permuted(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, [self.descriptors[k] for k in order])

    def restored(self, order: Sequence[int]) -> PieceTable:
        """Undoes ``permuted(order)``."""
        inverse = [0] * len(order)
        for place, k in enumerate(order):
            inverse[k] = place
        return self.permuted(inverse)

    def parts(self) -> Iterator[memoryview]:
        for buffer, first, end in self.descriptors:
            yield memoryview(self.buffers[buffer])[first:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.parts():
            digest.update(part)
        return digest.hexdigest()

    def read(self) -> bytes:
        return b"".join(self.parts())


def _starts(data: np.ndarray, first: int, end: int) -> np.ndarray:
    """Of the bytes [first, end) of a text, those where a token begins: a letter after none, or any other character."""
    part = data[first:end]
    letter = _LETTER[part]
    begins = ~_CONTINUES[part]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    if first and len(part) and letter[0] and _LETTER[data[first - 1]]:
        begins[0] = False
    return begins


def cut_places(data: np.ndarray, choose) -> tuple[int, tuple[int, int]]:
    """Number n of tokens, and the bytes after the first a and b of them, (a, b) = choose(n). Goes by slices of bounded size."""
    edges = [(i, min(i + _SLICE, len(data))) for i in range(0, len(data), _SLICE)]
    masks = [_starts(data, *edges[0])] if len(edges) == 1 else None  # of a short text it is kept
    counts = [int(np.count_nonzero(m)) for m in (masks or (_starts(data, *e) for e in edges))]
    n = sum(counts)
    out = []
    for k in choose(n):
        at = len(data)
        if k < n:
            upto = 0
            for j, c in enumerate(counts):
                if k < upto + c:
                    mask = masks[j] if masks else _starts(data, *edges[j])
                    at = edges[j][0] + int(np.flatnonzero(mask)[k - upto])
                    break
                upto += c
        out.append(at)
    return n, (out[0], out[1])


def characters(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero(~_CONTINUES[data[i : i + _SLICE]])) for i in range(0, len(data), _SLICE))


class Arranger:
    """Chooses form and cuts of a document by its key, and builds its piece tables."""

    def __init__(self, percent: int, spm_percent: int, seed: int, sentinels: Sequence[str]):
        self.percent, self.spm_percent, self.seed = percent, spm_percent, seed
        self.marks = [s.encode() for s in sentinels]
        self.buffer = b"".join(self.marks)
        ends = np.cumsum([len(m) for m in self.marks]).tolist()
        self.mark_pieces = [(1, e - len(m), e) for m, e in zip(self.marks, ends, strict=True)]

    def apply(self, key: str, text: bytes) -> dict:
        """n, form, prefix_chars, middle_chars and the table of the output."""
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        data = np.frombuffer(text, np.uint8)
        n, (a, b) = cut_places(data, lambda n: sorted((h[0] % (n + 1), h[1] % (n + 1))))
        whole = PieceTable((text, self.buffer), [(0, 0, len(text))])
        if not text or h[2] % 100 >= self.percent or any(m in text for m in self.marks):
            return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "table": whole}
        form = "spm" if h[3] % 100 < self.spm_percent else "psm"
        cut = whole.cut([a, b])
        table = PieceTable(cut.buffers, [*cut.descriptors, *self.mark_pieces]).permuted(ARRANGEMENTS[form])
        return {"n": n, "form": form, "prefix_chars": characters(data[:a]), "middle_chars": characters(data[a:b]), "table": table}

    def restore(self, output: bytes, form: str) -> PieceTable:
        """The text, from output and form alone: the sentinels' places cut the output, the inverse permutation orders the pieces."""
        whole = PieceTable((output,), [(0, 0, len(output))])
        if form == "plain":
            return whole
        order, places = ARRANGEMENTS[form], [0]
        for k in (order[2], order[4]):
            mark = self.marks[k - 3]
            at = output.index(mark, places[-1] + len(self.marks[order[0] - 3]) if len(places) == 1 else places[-1])
            places += [at, at + len(mark)]
        cut = whole.cut([len(self.marks[order[0] - 3]), *places[1:]])
        return PieceTable(cut.buffers, cut.restored(order).descriptors[:3])


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 90, spm_percent: int = 20, seed: int = 1,
    sentinels: Sequence[str] = SENTINELS, texts: bool = True,
) -> DataFrame:
    """One row for each row of ``docs``: key, n (tokens), form, prefix_chars, middle_chars, output_sha256, restored_sha256, with ``texts`` also output.

    Tokens are runs of A-Z and a-z, and every other character alone. Of ``percent`` in a hundred documents prefix, middle and
    suffix are arranged behind their sentinels: psm, or of ``spm_percent`` in a hundred of these spm. A null text counts as
    empty; an empty text, and one that holds a sentinel, stays plain, with null lengths. Choices depend on seed and key
    alone, so repeated rows come out alike; a null key counts as an empty one. Other columns are not read; an empty table
    gives none. Works row by row without a shuffle; beside a text and its output a task holds arrays of bounded size.
    """
    arranger = Arranger(percent, spm_percent, seed, sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text_"):
                data, at = raw(piece.column(1))
                rows = []
                for k, (name, i, j) in enumerate(zip(piece.column(2).to_pylist(), at, at[1:], strict=False)):
                    row = arranger.apply(name, data[i:j].tobytes())
                    table = row.pop("table")
                    row["output_sha256"] = table.sha256()
                    output = table.read()
                    row["restored_sha256"] = arranger.restore(output, row["form"]).sha256()
                    if texts:
                        row["output"] = output.decode()
                    rows.append(row)
                columns = {f.name: pa.array([r[f.name] for r in rows], f.type) for f in schema}
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns.values()], ["key_", *columns])

    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())] + ([("output", pa.large_string())] if texts else []))
    kind = docs.schema[key].dataType.simpleString()
    named = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name_")
    out = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"), named)
    columns = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + (", output string" if texts else "")
    return out.mapInArrow(freeing(run), f"key_ {kind}, {columns}").withColumnRenamed("key_", key)


#: DuckDB SQL of the same rows for documents (doc_id, text), with the defaults above.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
  CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
v AS (SELECT *, CAST(len(w) AS BIGINT) AS n FROM u),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM v),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a+1:b], ''), '') AS middle, coalesce(array_to_string(w[b+1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
