"""Fill-in-the-middle: piece tables against plain strings, exact round trips, odd rows."""

import hashlib
import re

import numpy as np
import pytest

from photolake.llm import fill_middle as M

COLUMNS = "doc_id long, text string, key_ string, text_ string, n int, form string, output string"
ODD = [None, "", " ", "a", "word", "two words", "<P>", "has <M> inside", "<S", "<", "S>P>", "é😀漢字 mixed ASCII ñ", "\x00\n\r\n\t", "x" * 5000, "1 " * 3000, "a<P b<S c<M>"[:-1], "same", "same"]


def plain(key, text, seed=1, percent=90, spm=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(s in text for s in M.SENTINELS) or h[2] % 100 >= percent:
        return (n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@pytest.mark.parametrize(("percent", "spm"), [(90, 20), (100, 0), (100, 100), (0, 20)])
def test_equals_plain_strings(spark, percent, spm):
    rows = [(i, t) for i, t in enumerate(ODD * 4)] + [(None, "no key at all")] * 2
    df = spark.createDataFrame([(*r, "k", "t", 1, "f", "o") for r in rows], COLUMNS)
    got = M.fill_in_middle(df, percent=percent, spm_percent=spm)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in rows:
        *head, output = plain(i, t, percent=percent, spm=spm)
        want.append((i, *head, sha(output), sha(t or ""), output))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_slices_change_nothing(monkeypatch):
    arranger = M.Arranger(100, 50, 3, M.SENTINELS)
    texts = [("ab é1 cd😀" * 7).encode(), b"abc" * 20, "漢".encode() * 9]
    whole = [[arranger.apply(str(k), t)["table"].read() for k in range(20)] for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(M, "_SLICE", size)
        assert [[arranger.apply(str(k), t)["table"].read() for k in range(20)] for t in texts] == whole
    for k in range(20):
        row = arranger.apply(str(k), texts[0])
        assert arranger.restore(row["table"].read(), row["form"]).read() == texts[0]


def test_cuts_and_permutations_of_descriptors():
    rng = np.random.default_rng(2)
    table = M.PieceTable((b"immutable text", b"marks"), [(0, 0, 9), (1, 0, 5), (0, 9, 14)])
    whole = table.read()
    for _ in range(50):
        places = sorted(rng.integers(0, len(whole) + 1, 4).tolist())
        cut = table.cut(places)
        assert cut.read() == whole and len(cut.descriptors) == 7
        order = rng.permutation(7).tolist()
        assert cut.permuted(order).restored(order).descriptors == cut.descriptors
        assert cut.permuted(order).sha256() == hashlib.sha256(cut.permuted(order).read()).hexdigest()
    assert all(type(b) is bytes for b in table.buffers) and table.cut([3]).buffers is table.buffers


def test_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], COLUMNS)).count() == 0
