"""Licences in comments, expressions of tags, titles above bodies, further wordings; Spark and SQL alike."""

import duckdb
import pandas as pd
import pytest

from photolake.llm import licenses

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MIT = """MIT License

Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def commented(text, mark):
    return "\n".join(mark + line for line in text.split("\n"))


CASES = [
    *[(commented(GPL, m), ["GPL-3.0-or-later"]) for m in ("", "# ", "// ", " * ", "-- ", ";; ", "#")],
    *[(commented(MIT, m), ["MIT"]) for m in ("", "# ", "/// ", " * ")],
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode();", ["MIT", "Apache-2.0"]),
    ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT)", ["GPL-2.0-or-later", "MIT"]),
    ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: LGPL-2.1", ["LGPL-2.1-only"]),
    ("SPDX-License-Identifier: MIT and more words", ["MIT"]),
    ("SPDX-License-Identifier: Unheard-1.0", []),
    ("This is licensed under GPLv3.", ["GPL-3.0-only"]),
    ("The tool is released under GPL v2.", ["GPL-2.0-only"]),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ('The software is provided "as is", without warranty of any kind, express or implied.', []),
    ("# a heading\n\n* a point about licensing\n", []),
    ("", []), (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x", "y") for i, (t, _) in enumerate(CASES)]
    return {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, known string, licenses string")).collect()}


@pytest.mark.parametrize("at", range(len(CASES)))
def test_case(found, at):
    assert found[at].matches == CASES[at][1]


def test_sql_gives_the_same(found):
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": range(len(CASES)), "text": [t for t, _ in CASES]}))
    got = {r[0]: (r[2], r[4]) for r in c.sql(licenses.oracle_sql()).fetchall()}
    assert got == {i: (",".join(r.sentence_ids), ",".join(r.matches)) for i, r in found.items()}


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
