"""Further wrappings of the secret scan, its base spans over the table against a plain search, extra columns."""

import base64
import bz2
import gzip
import hashlib
import re
import zlib

import pytest

from photolake.llm import queries, secrets

INNER = "password = hunter2hunter2"
b64 = lambda x: base64.b64encode(x).decode()
raw = lambda x: zlib.compress(x, wbits=-15)

WRAPPED = {
    "glued to a letter": "x" + b64(INNER.encode()),
    "glued to three": "abc" + b64(INNER.encode()),
    "gzip glued to a word": "attachment" + b64(gzip.compress(INNER.encode())),
    "bzip2 glued": "ab" + b64(bz2.compress(INNER.encode())),
    "raw deflate": b64(raw(INNER.encode() * 2)),
    "UTF-16": b64(INNER.encode("utf-16")),
    "UTF-16LE": b64(INNER.encode("utf-16-le")),
    "UTF-16BE": b64(INNER.encode("utf-16-be")),
    "Latin-1": b64(f"{INNER} straße über".encode("latin-1")),
    "braces": "".join(f"\\u{{{ord(c):x}}}" for c in INNER),
    "form encoding": "password+%3D+hunter2hunter2",
    "gzip of UTF-16": b64(gzip.compress(INNER.encode("utf-16"))),
    "form inside base64": b64(b"q=1&body=password+%3D+hunter2hunter2"),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapping_is_opened(name):
    text = f"some words {WRAPPED[name]} and more"
    base, added, layers, _ = secrets.scan(text)
    assert layers and any(k == 0 for _, k, _ in added), name
    a, _, b = next(s for s in added if s[1] == 0)
    assert 11 <= a < b <= 11 + len(WRAPPED[name])


def test_plain_words_open_nothing_that_finds():
    for text in ("internationalization of characteristics and counterrevolutionaries", "a+b %20 c+d", "0123456789abcdef" * 8, "x" * 1000):
        base, added, _, _ = secrets.scan(text)
        assert added == [] and base == secrets.find(text)


def plain(text):
    """The contract's base spans by a search of its own: keyword first, then what follows it."""
    out = []
    for kind, pattern, group, least in ((0, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8), (1, "(AKIA[A-Z0-9]+)", 1, 16), (2, "([0-9a-f]+)", 1, 32)):
        at = 0
        while m := re.compile(pattern).search(text, at):
            if len(m.group(group)) >= least:
                out.append((m.start(), kind, m.end()))
            at = m.end()
    return sorted(out)


def test_base_spans_of_the_table_equal_a_plain_search(spark):
    rows = {r.doc_id: r for r in queries.op1_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = plain(d.text or "")
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]


def test_extra_columns_and_odd_rows(spark):
    rows = [(1, f"x {WRAPPED['raw deflate']}", "k", [1]), (1, None, "k", None), (None, "", "k", [])]
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, key_ string, base array<int>"))
    assert sorted((len(r.base), len(r.added)) for r in out.collect()) == [(0, 0), (0, 0), (0, 1)]
