"""License scans by sentence rules.

A text is cut into sentences (at line ends, and after . ! ? ; : before white space). Normalised sentences (lower case, runs
of other characters than letters and digits as one space) are mapped to identifiers of known licence sentences, everything
else is left out, and the sequence of identifiers is matched against ordered rules. A sentence may run over several lines, but
not over a blank one, nor over one of marks alone. A rule is a run of identifiers; the first rule that fits takes its
identifiers out of the sequence, so longer texts go before notices and references.

DataFrame functions only, one pass, no shuffle; the tables of sentences and rules are literals of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import columns, spare, table

# fixed values: known sentences of public licences, normalised
SENTENCES = {
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",  # the text has "v. 2.0", which ends a sentence
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "cc0-waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "reserved": "all rights reserved",
}
# fixed values: other wordings of known sentences
VARIANTS = [
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("bsd-names", "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache2-ref", "licensed under the apache license version 2 0 the license"),
]
# fixed values: licences that a sentence names, as (identifier, licence, names in such a sentence)
NAMED = [
    ("apache2-ref", "Apache-2.0", ["apache license version 2 0", "apache license 2 0"]),
    ("mit-ref", "MIT", ["mit license"]),
    ("bsd-ref", "BSD-2-Clause", ["bsd license", "bsd 2 clause license", "simplified bsd license"]),
    ("bsd3-ref", "BSD-3-Clause", ["bsd 3 clause license", "new bsd license"]),
    ("isc-ref", "ISC", ["isc license"]),
    ("mpl2-ref", "MPL-2.0", ["mozilla public license 2 0", "mozilla public license version 2 0"]),
    ("zlib-ref", "Zlib", ["zlib license"]),
    ("boost-ref", "BSL-1.0", ["boost software license version 1 0"]),
    ("unlicense-ref", "Unlicense", ["unlicense"]),
]
# fixed values: notices of the GNU licences, as (identifier, licence, work, name, version)
GNU = [
    ("gpl-free", "GPL-3.0-or-later", "program", "general", "3"),
    ("gpl2-free", "GPL-2.0-or-later", "program", "general", "2"),
    ("agpl-free", "AGPL-3.0-or-later", "program", "affero general", "3"),
    ("lgpl3-program", "LGPL-3.0-or-later", "program", "lesser general", "3"),
    ("lgpl21-free", "LGPL-2.1-or-later", "library", "lesser general", "2 1"),
    ("lgpl3-free", "LGPL-3.0-or-later", "library", "lesser general", "3"),
]
# fixed values: the Creative Commons licences, as (short name, long name)
COMMONS = [
    ("by nc nd", "attribution noncommercial noderivatives"),
    ("by nc sa", "attribution noncommercial sharealike"),
    ("by nc", "attribution noncommercial"),
    ("by nd", "attribution noderivatives"),
    ("by sa", "attribution sharealike"),
    ("by", "attribution"),
]
VERBS = ["licensed under the", "released under the", "distributed under the", "this project is licensed under the", "this software is licensed under the", "this work is licensed under the"]
# ordered: the first that fits takes its identifiers
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-ref", "apache2-use", "apache2-copy", "apache2-as-is"]),
    ("Apache-2.0", ["apache2-ref", "apache2-use", "apache2-copy"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-free"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("CC0-1.0", ["cc0"]),
    ("CC0-1.0", ["cc0-waived"]),
]
for _id, _license, _work, _name, _version in GNU:
    SENTENCES[_id] = f"this {_work} is free software you can redistribute it and or modify it under the terms of the gnu {_name} public license as published by the free software foundation either version {_version} of the license or at your option any later version"
    RULES += [(_license, [_id, "lgpl-hope" if _work == "library" else "gpl-hope"]), (_license, [_id])]
for _id, _license, _names in NAMED:
    SENTENCES[_id] = f"{VERBS[0]} {_names[0]}"
    VARIANTS += [(_id, f"{v} {n}") for n in _names for v in VERBS if f"{v} {n}" != SENTENCES[_id]]
    RULES.append((_license, [_id]))
for _short, _long in COMMONS:
    _id = "cc-" + _short.replace(" ", "-")
    SENTENCES[_id] = f"licensed under cc {_short} 4 0"
    VARIANTS += [(_id, f"this work is licensed under {_the} creative commons {_long} 4 0 international license") for _the in ("a", "the")]
    RULES.append((f"CC-{_short.replace(' ', '-').upper()}-4.0", [_id]))
RULES.append(("Proprietary", ["reserved"]))
#: Stands between two sentences of the Apache notice, also on one line.
APACHE_URL = r"https?://www\.apache\.org/licenses/license-2\.0[^\x20\x09-\x0D]*"
#: Words of known sentences after which a colon or semicolon may stand.
STOPS = dict.fromkeys(["gpl2-only", *[g[0] for g in GNU]], ("software", "foundation")) | {"gpl-hope": ("warranty",), "lgpl-hope": ("warranty",), "boost-grant": ("following",)}
#: Every known sentence holds one of these within a word, however its words are parted, so texts without them are not cut.
HINTS = "(?i)licen|permission|permitted|warrant|copyright|distribut|dedicated|reserved|unencumbered"


def _pattern() -> str:
    """All known sentences in a text marked by identifiers(), from the start of a line or piece to the end of one."""
    gap, stop = "(?: N? ?|N ?)", "(?:[ C]{1,3}(?:N ?)?|N ?)"
    found = []
    for name, sentence in [*VARIANTS, *SENTENCES.items()]:
        words = sentence.split(" ")
        ends = [stop if w in STOPS.get(name, ()) else gap for w in words[:-1]]
        found.append("".join(w + e for w, e in zip(words, [*ends, ""], strict=True)))
    return f"(?<=^ ?|[ENC] ?)(?:{'|'.join(found)})(?= ?(?:[ENC]|$))"


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    by_text = F.create_map(*[F.lit(x) for name, sentence in [*VARIANTS, *SENTENCES.items()] for x in (sentence, name)])
    # a lower-case text has no capitals, so these mark ends (E), colons and semicolons (C) and new lines (N)
    marked = F.lower(text)
    for there, mark in ((APACHE_URL, "E"), (r"[.!?](?=[\x20\x09-\x0D])", "E"), (r"[;:](?=[\x20\x09-\x0D])", "C"), (r"\n", "N"), ("[^a-z0-9ENC]+", " ")):
        marked = F.regexp_replace(marked, there, mark)
    known = F.transform(F.regexp_extract_all(marked, F.lit(_pattern()), F.lit(0)), lambda s: F.element_at(by_text, F.regexp_replace(s, "[ NC]+", " ")))
    return F.when(text.rlike(HINTS), known).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with a struct `license`: sentence_ids (array), licenses (array, distinct, in the order of
    the rules) and unmatched (identifiers that no rule took).

    A null or empty text has none. Repeated rows, null ids, empty tables and other columns pass through, whatever their names;
    a column named `license` is replaced. Whole texts are read, whatever their length.
    """
    ids_col = spare(docs, "ids")[0]
    step = docs.select("*", identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias(ids_col))
    # a comma ends each identifier and a bar marks where a rule took some, so that no rule fits across the gap
    rest, names = F.concat(F.lit(","), F.array_join(ids_col, ",,"), F.lit(",")), []
    for name, ids in RULES:
        run = F.lit("," + ",,".join(ids) + ",")
        names.append(F.when(F.contains(rest, run), F.lit(name)))
        rest = F.replace(rest, run, F.lit("|"))
    got = F.filter(F.array(*names), lambda x: x.isNotNull())
    some = F.size(ids_col) > 0
    none = F.array().cast("array<string>")
    left = F.filter(F.split(rest, "[,|]+"), lambda x: x != "")
    found = F.struct(F.col(ids_col).alias("sentence_ids"), F.when(some, F.array_distinct(got)).otherwise(none).alias("licenses"), F.when(some, left).otherwise(none).alias("unmatched"))
    return step.select(*columns(docs, "license"), found.alias("license"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licences of all documents; see scan()."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("license.sentence_ids").cast("long").alias("n_known"),
        F.array_join("license.sentence_ids", ",").alias("sentence_ids"),
        F.array_join("license.licenses", ",").alias("licenses"),
    )


def _sql() -> str:
    """The same definition for DuckDB: RE2 looks neither ahead nor behind, so marks get a character 2 on both sides to be taken as bounds."""
    bound = r"\x02"
    line, colon = f"{bound}N{bound}", f"{bound}C{bound}"
    gap, stop = f"(?: (?:{line})? ?|{line} ?)", f"(?:(?: |{colon}){{1,3}}(?:{line} ?)?|{line} ?)"
    sentences = []
    for name, sentence in [*VARIANTS, *SENTENCES.items()]:
        words = sentence.split(" ")
        sentences.append("".join(w + (stop if w in STOPS.get(name, ()) else gap) for w in words[:-1]) + words[-1])
    # rules of one identifier in SQL take each sentence alone; longer runs are replaced first, in the same order
    steps = []
    for k, (name, ids) in enumerate(RULES):
        run = "," + ",,".join(ids) + ","
        steps.append(f"s{k + 1} AS (SELECT doc_id, ids, CASE WHEN contains(rest, '{run}') THEN list_append(got, '{name}') ELSE got END AS got, replace(rest, '{run}', '|') AS rest FROM s{k})")
    known = ", ".join(f"('{v}', '{k}')" for k, v in [*VARIANTS, *SENTENCES.items()])
    marked = "lower(coalesce(text, ''))"
    for there, mark in ((APACHE_URL, "E"), (r"[.!?]([\x20\x09-\x0D])", r"E\1"), (r"[;:]([\x20\x09-\x0D])", r"C\1"), (r"\n", "N"), ("[^a-z0-9ENC]+", " ")):
        marked = f"regexp_replace({marked}, '{there}', '{mark}', 'g')"
    marked = f"chr(2) || regexp_replace({marked}, '([ENC])', chr(2) || '\\1' || chr(2), 'g') || chr(2)"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
found AS (SELECT doc_id, regexp_extract_all({marked}, '{bound} ?({"|".join(sentences)}) ?{bound}', 1) AS xs FROM documents),
cut AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM found),
hits AS (SELECT doc_id, i, id FROM cut JOIN known ON sentence = regexp_replace(x, '[\\x02 NC]+', ' ', 'g')),
s0 AS (SELECT doc_id, coalesce(list(id ORDER BY i) FILTER (id IS NOT NULL), []) AS ids, []::VARCHAR[] AS got,
              ',' || coalesce(string_agg(id, ',,' ORDER BY i), '') || ',' AS rest FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_transform(list_filter(list_zip(got, range(len(got))), lambda p: list_position(got, p[1]) = p[2] + 1), lambda p: p[1]), ',') AS licenses
FROM s{len(RULES)}
"""


OP2_SQL = _sql()
