"""Licence recognition: normalised sentences become identifiers, and sequences of these meet ordered licence rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licences, normalised (lower case, letters and digits, single blanks).
SENTENCES = {
    "mit_ref": "released under the mit license",
    "mit_lic": "licensed under the mit license",
    "apache2_ref": "licensed under the apache license version 2 0",
    "apache2_full": "licensed under the apache license version 2 0 the license",
    "apache2_use": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl2_later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3_later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "lgpl_hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl3_later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl_see": "see the gnu lesser general public license for more details",
    "agpl3_later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_see": "see the gnu affero general public license for more details",
    "gpl2_only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_notice": "this notice may not be removed or altered from any source distribution",
    "bync4_ref": "licensed under cc by nc 4 0",
    "by4_ref": "licensed under cc by 4 0",
    "bysa4_ref": "licensed under cc by sa 4 0",
    "mpl2_ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# Further wordings of these sentences, and parts of them where a colon or semicolon ends one.
VARIANTS = {
    "isc_grant": ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "mit_warranty": ("the software is provided as is without warranty of any kind express or implied",),
    "mit_liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "bsd_warranty": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "gpl_hope": ("this program is distributed in the hope that it will be useful but without any warranty",),
    "lgpl_hope": ("this library is distributed in the hope that it will be useful but without any warranty",),
}
#: What stands before the colon in "This program is free software: you can redistribute it ..."; the rest tells the licence alone.
OPENING = ("this program is free software ", "this library is free software ")
#: (licence, sentence identifiers that follow each other among a text's licence sentences). Earlier rules go first.
RULES = [
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_name", "bsd_warranty")),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_warranty")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2_full", "apache2_use", "apache2_copy", "apache2_law", "apache2_see")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("GPL-3.0-or-later", ("gpl3_later", "gpl_hope", "gpl_see")),
    ("GPL-2.0-or-later", ("gpl2_later", "gpl_hope", "gpl_see")),
    ("GPL-3.0-or-later", ("gpl3_later",)),
    ("GPL-2.0-or-later", ("gpl2_later",)),
    ("MIT", ("mit_grant", "mit_notice")),
    ("ISC", ("isc_grant",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_lic",)),
    ("Apache-2.0", ("apache2_ref",)),
    ("GPL-3.0-only", ("gpl3_ref",)),
    ("CC-BY-NC-4.0", ("bync4_ref",)),
    ("CC-BY-SA-4.0", ("bysa4_ref",)),
    ("CC-BY-4.0", ("by4_ref",)),
    ("MPL-2.0", ("mpl2_ref",)),
]
# Names of licences as notices write them, normalised.
NAMES = {
    "MIT": ("mit license", "mit license mit", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "ISC": ("isc license",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3 license", "gplv3", "gpl v3", "gnu gplv3"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2 license", "gplv2", "gpl v2", "gnu gplv2"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense", "unlicense license"),
    "CC0-1.0": ("cc0 1 0 universal license", "creative commons zero v1 0 universal license"),
    "CC-BY-4.0": ("creative commons attribution 4 0 international license",),
    "CC-BY-SA-4.0": ("creative commons attribution sharealike 4 0 international license",),
    "CC-BY-NC-4.0": ("creative commons attribution noncommercial 4 0 international license",),
}
#: How a notice names a licence; a subject before it ("this project is") is taken off first.
NOTICES = ("{}", "the {}", "licensed under {}", "released under {}", "distributed under {}", "licensed under the {}", "released under the {}", "distributed under the {}", "licensed under the terms of the {}", "available under the {}")
SUBJECT = "^(?:this|the|all) (?:[a-z0-9]+ ){0,4}?(?:is|are) "
#: A tag of one line that names licences by their published short identifiers, joined by operators; what may part them; the
#: identifiers of former versions of the list. A plus says "or later".
TAG = r"[Ss][Pp][Dd][Xx]-[Ll]icense-[Ii]dentifier:[ \t]*([(]*[A-Za-z0-9.+-]+[)]*(?:[ \t]+(?:OR|AND|WITH)[ \t]+[(]*[A-Za-z0-9.+-]+[)]*)*)"
TAGGED, OPERATOR = "spdx license identifier", r"[ \t]+(?:OR|AND|WITH)[ \t]+"
FORMER = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: Marks of comments at the beginning of a line.
COMMENT = r"(?m)^[ \t]*(?://+|#+|/?[*]+/?|--+|;+|%+)[ \t]?"
_SHORT = [*NAMES, "GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later"]
_plain = lambda name: re.sub("[^a-z0-9]+", " ", name.lower()).strip()
#: Sentence to identifier: the sentences above, then the notices and tags by rule. A listed sentence keeps its identifier.
KNOWN = {f"{TAGGED} {_plain(n)}": f"tag_{n}" for n in _SHORT} | {notice.format(form): f"notice_{n}" for n, forms in NAMES.items() for form in forms for notice in NOTICES} | {s: i for i, s in SENTENCES.items()}
KNOWN |= {f"{TAGGED} {_plain(n)}": f"tag_{n}-only" for n in FORMER} | {s: i for i, forms in VARIANTS.items() for s in forms}
KNOWN |= {s[len(o) :]: i for i, s in SENTENCES.items() for o in OPENING if s.startswith(o)}
# a title and the body below it are one licence
RULES = [(n, (f"notice_{n}", *ids)) for n, ids in RULES if n in NAMES and len(ids) > 1] + RULES
RULES += [
    ("LGPL-3.0-or-later", ("lgpl3_later",)), ("LGPL-2.1-or-later", ("lgpl21_later",)), ("AGPL-3.0-or-later", ("agpl3_later",)), ("GPL-2.0-only", ("gpl2_only",)),
    ("Unlicense", ("unlicense_free",)), ("Zlib", ("zlib_grant", "zlib_notice")), ("Zlib", ("zlib_grant",)),
    *[(n, (f"tag_{n}",)) for n in _SHORT], *[(n, (f"notice_{n}",)) for n in NAMES],
]
#: Sentences end at one of . ! ? ; : and white space ("2.0" stays together) and at empty lines. One that is not known so
#: is cut at its line ends as well: the identifiers of wrapped and of one-line sentences come in the order of the text.
SENTENCE_END, LINE_END = r"\n[ \t\r]*\n|[.!?;:]+[ \t\r\n]+", r"[\n\r]+"


def _stems(known: dict[str, str]) -> list[str]:
    """A few stems so that each sentence holds one: texts without any are passed over."""
    stems = ["licen", "permission", "redistribut", "warrant", "copyright", "free software", "gpl", "unencumbered", "removed or altered"]
    return stems + [s for s in known if not any(x in s for x in stems)]


def recognise(text: Column, known: dict[str, str] = KNOWN) -> Column:
    """The identifiers of a text's licence sentences in order."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    none = F.array().cast("array<string>")
    stems = _stems(known)
    holds = lambda c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(s)) for s in stems])
    normal = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    named = lambda s: F.coalesce(F.try_element_at(table, normal(s)), F.try_element_at(table, F.regexp_replace(normal(s), SUBJECT, "")))
    # a stem of two words may be parted by any white space in the raw text, so the raw text is asked for first words
    first = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(s.split(" ")[0])) for s in stems])
    marked = F.regexp_replace(F.regexp_replace(text, COMMENT, ""), TAG, f"\n\n{TAGGED} $1\n\n")
    pieces = F.filter(F.split(marked, SENTENCE_END), lambda p: holds(normal(p)))
    listed = lambda p: F.split(F.substring(p, F.instr(p, TAGGED) + len(TAGGED), F.length(p)), OPERATOR)
    tags = lambda p: F.transform(listed(p), lambda x: F.try_element_at(table, F.concat(F.lit(f"{TAGGED} "), normal(F.replace(x, F.lit("+"), F.lit(" or later"))))))
    whole = lambda p: F.when(named(p).isNotNull(), F.array(named(p))).otherwise(F.transform(F.split(p, LINE_END), named))
    ids = F.flatten(F.transform(pieces, lambda p: F.when(F.instr(p, TAGGED) > 0, tags(p)).otherwise(whole(p))))
    return F.when(first, F.filter(ids, lambda i: i.isNotNull())).otherwise(none)


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", known: dict[str, str] = KNOWN, rules: list[tuple[str, tuple[str, ...]]] = RULES,
) -> DataFrame:
    """One row for each row of ``docs``: key, sentence_ids, matches and licenses.

    ``sentence_ids`` lists the licence sentences of the text in order. Rules are tried at each of them from the left,
    in their order, and the first that fits takes its sentences; ``matches`` lists the licences found so, ``licenses``
    each of them once, in the order of first appearance. Marks of comments at the beginning of lines count for nothing; a tag that joins
    licences by OR, AND or WITH names each of them. A sentence that no rule takes gives no match. A null or empty
    text gives empty arrays. Repeated rows are scanned each; other columns are not read. One projection, no shuffle.
    """
    taken = lambda ids: "".join(f"<{i}>" for i in ids)
    pattern = "(" + "|".join(taken(ids) for _, ids in rules).replace(".", "\\.").replace("+", "\\+") + ")"
    by_ids = F.create_map(*[F.lit(x) for ids, name in {taken(ids): name for name, ids in reversed(rules)}.items() for x in (ids, name)])
    rows = docs.select(F.col(key), recognise(F.coalesce(F.col(text), F.lit("")), known).alias("sentence_ids"))
    line = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    rows = rows.withColumn("matches", F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda m: by_ids[m]))
    return rows.withColumn("licenses", F.array_distinct("matches"))


def oracle_sql(known: dict[str, str] = KNOWN, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> str:
    """DuckDB SQL for the rows of ``op3_license_scan``."""
    table = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in known.items()) + "}"
    taken = lambda ids: "".join(f"<{i}>" for i in ids)
    names = "MAP {" + ", ".join(f"'{ids}': '{name}'" for ids, name in {taken(ids): name for name, ids in reversed(rules)}.items()) + "}"
    pattern = "|".join(taken(ids) for _, ids in rules).replace(".", "\\.")
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    named = lambda x: f"coalesce({table}[{normal(x)}], {table}[regexp_replace({normal(x)}, '{SUBJECT}', '')])"
    tag = lambda x: f"{table}['{TAGGED} ' || " + normal(f"replace({x}, '+', ' or later')") + "]"
    marked = f"regexp_replace(regexp_replace(coalesce(text, ''), '{COMMENT}', '', 'g'), '{TAG}', chr(10) || chr(10) || '{TAGGED} \\1' || chr(10) || chr(10), 'g')"
    return f"""
WITH p AS (SELECT doc_id, string_split_regex({marked}, '{SENTENCE_END}') AS pieces FROM documents),
s AS (
  SELECT doc_id, list_filter(flatten(list_transform(pieces, lambda p: CASE WHEN instr(p, '{TAGGED}') > 0 THEN list_transform(string_split_regex(substr(p, instr(p, '{TAGGED}') + {len(TAGGED)}), '{OPERATOR}'), lambda x: {tag('x')}) WHEN {named('p')} IS NOT NULL THEN [{named('p')}] ELSE list_transform(string_split_regex(p, '{LINE_END}'), lambda x: {named('x')}) END)), lambda i: i IS NOT NULL) AS ids FROM p),
m AS (
  SELECT doc_id, ids, list_transform(regexp_extract_all(list_reduce(list_prepend('', list_transform(ids, lambda i: '<' || i || '>')), lambda a, b: a || b), '{pattern}'), lambda x: {names}[x]) AS matches
  FROM s)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, CAST(len(matches) AS BIGINT) AS n_matches,
  array_to_string(matches, ',') AS matches
FROM m"""
