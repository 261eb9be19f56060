"""Operator 3: licence scans by sentence rules.

A text is cut at stops before white space and at blank lines. Known licence
sentences are found from line start to line end in between, over as many lines
as they are wrapped to, with or without comment leaders; the other lines up to
the next cut or known sentence are one sentence. Each is normalised to
lower-case letters and digits, and known ones are mapped to identifiers. A
document is then the ordered sequence of its known sentences; a break stands
where more than MAX_GAP other sentences lie between two of them. Licence rules are sequences of identifiers: they match where theirs
stand in that order without a break. Longer rules go first and use up what they
match, so the notice inside a full text is not counted again.

Everything happens inside the row: no shuffle. A test for words that every
known sentence contains one of skips texts without any; it can skip no match.

Defined results: null, empty and blank texts have no sentences; repeated rows
are scanned alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import let

MAX_GAP = 2

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-short": "This project is licensed under the MIT License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software",
    "gpl2-modify": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3-modify": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "cc0-short": "This work is released under CC0 1.0",
    "rights": "All rights reserved",
}
# Notices of the Creative Commons family follow one form.
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = ("3.0", "4.0")
CC_FORMS = ("Licensed under CC {kind} {version}", "This work is licensed under CC {kind} {version}")
SENTENCES |= {
    f"cc-{kind.lower()}-{version}-{n}": form.format(kind=kind, version=version)
    for kind in CC_KINDS for version in CC_VERSIONS for n, form in enumerate(CC_FORMS)
}

# Licence, what was found, and its sentences in order.
RULES = [
    ("mit", "text", ("mit-grant", "mit-keep", "mit-warranty", "mit-liability")),
    ("mit", "notice", ("mit-released",)),
    ("mit", "notice", ("mit-licensed",)),
    ("mit", "notice", ("mit-short",)),
    ("isc", "text", ("isc-grant", "isc-warranty")),
    ("bsd-3-clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("bsd-2-clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("bsd", "notice", ("bsd-style",)),
    ("apache-2.0", "header", ("apache-header", "apache-comply", "apache-obtain", "apache-url", "apache-unless", "apache-see")),
    ("apache-2.0", "notice", ("apache-short",)),
    ("apache-2.0", "notice", ("apache-header",)),
    ("gpl-3.0", "header", ("gpl-free", "gpl3-modify", "gpl-hope", "gpl-merchant", "gpl-details")),
    ("gpl-2.0", "header", ("gpl-free", "gpl2-modify", "gpl-hope", "gpl-merchant", "gpl-details")),
    ("gpl-3.0", "notice", ("gpl3-short",)),
    ("gpl-2.0", "notice", ("gpl2-short",)),
    ("mpl-2.0", "header", ("mpl-form", "mpl-copy")),
    ("unlicense", "text", ("unlicense-free", "unlicense-anyone")),
    ("zlib", "text", ("zlib-warranty", "zlib-grant")),
    ("cc0-1.0", "notice", ("cc0-short",)),
    ("all-rights-reserved", "notice", ("rights",)),
]
RULES += [
    (f"cc-{kind.lower()}-{version}", "notice", (f"cc-{kind.lower()}-{version}-{n}",))
    for kind in CC_KINDS for version in CC_VERSIONS for n in range(len(CC_FORMS))
]
#: Longest first; the sort is stable, so the order above breaks ties.
RULES.sort(key=lambda rule: -len(rule[2]))

#: Every part of a known sentence that is looked up contains one of these.
MARKERS = ("licens", "permi", "warrant", "redistribut", "copyright", "rights", "liable", "software", "released under")

STOPS = r"[.!?;:]+([ \t\r\n]+|$)"
#: What stands before the text of a line: indents, comment marks, and the words that open comments in batch, m4 and Fortran.
LEADERS = r"(?md)^[^a-z0-9\n]+((rem|dnl|c)[ \t]+)?|^(rem|dnl|c)[ \t]+"
#: No text has it after the first step.
CUT = "\x01"


def normalised(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def known_parts() -> dict[str, list[str]]:
    """Each known sentence as texts are cut: one with a stop inside becomes several, parts without a marker are left out."""
    cut = {name: [normalised(part) for part in re.sub(STOPS, "\n", text).split("\n")] for name, text in SENTENCES.items()}
    return {name: [part for part in parts if any(m in part for m in MARKERS)] for name, parts in cut.items()}


def _tables() -> tuple[dict[str, int], list[tuple[str, str, str]]]:
    codes: dict[str, int] = {}
    parts = known_parts()
    for name in SENTENCES:
        for part in parts[name]:
            codes.setdefault(part, len(codes) + 1)
    rules = [(licence, kind, "".join(f"<{codes[p]}>" for name in names for p in parts[name])) for licence, kind, names in RULES]
    return codes, rules


def _known_pattern() -> str:
    """Whole known sentences, the longest first; between words may stand line breaks, but no cut."""
    parts = sorted({part for parts in known_parts().values() for part in parts}, key=lambda part: (-len(part.split()), part))
    either = "|".join("[^a-z0-9\\x01]+".join(part.split()) for part in parts)
    return rf"(?<![^\n\x01])[^a-z0-9\n\x01]*({either})[^a-z0-9\n\x01]*(?![^\n\x01])"


def sentences(text: Column) -> Column:
    """Normalised sentences in order; those between neighbouring cuts are empty."""
    lines = F.regexp_replace(F.translate(F.lower(text), CUT, "\x02"), LEADERS, "")
    cut = F.regexp_replace(lines, rf"{STOPS}|\n{{2,}}", CUT)
    found = F.split(F.regexp_replace(cut, _known_pattern(), f"{CUT}$1{CUT}"), CUT, -1)
    return F.transform(found, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def scan(docs: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """doc_id, n_known, known (position and code of each known sentence) and licences (licence, kind, n) per document."""
    codes, rules = _tables()
    lookup = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    text = F.coalesce(F.col("text"), F.lit(""))
    # only sentences that hold a word count for the gaps; a marker of two words may be wrapped, so its first is looked for
    found = let(F.filter(sentences(text), lambda s: s != ""), lambda all_s: F.filter(
        F.transform(all_s, lambda s, i: F.struct(i.alias("position"), F.try_element_at(lookup, s).alias("code"))),
        lambda x: x["code"].isNotNull()))
    none = F.array().cast("array<struct<position:int,code:int>>")
    marked = docs.select("doc_id", F.when(F.lower(text).rlike("|".join(m.split()[0] for m in MARKERS)), found).otherwise(none).alias("known"))
    start = F.struct(F.lit(-1).alias("last"), F.lit("").alias("seq"))
    seq = F.aggregate("known", start, lambda acc, x: F.struct(
        x["position"].alias("last"),
        F.concat(acc["seq"], F.when(x["position"] - acc["last"] > max_gap + 1, "|").otherwise(""), F.lit("<"), x["code"].cast("string"), F.lit(">")).alias("seq"),
    ), lambda acc: acc["seq"])
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern")) for licence, kind, pattern in rules])
    nothing = F.array().cast("array<struct<licence:string,kind:string,n:int>>")

    def apply(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc["seq"], rule["pattern"], F.lit("|"))
        n = ((F.length(acc["seq"]) - F.length(F.replace(acc["seq"], rule["pattern"], F.lit("")))) / F.length(rule["pattern"])).cast("int")
        hit = F.struct(rule["licence"].alias("licence"), rule["kind"].alias("kind"), n.alias("n"))
        return F.struct(rest.alias("seq"), F.when(n > 0, F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"]).alias("hits"))

    matched = let(seq, lambda s: F.when(s == "", nothing).otherwise(
        F.aggregate(table, F.struct(s.alias("seq"), nothing.alias("hits")), apply, lambda acc: acc["hits"])))
    return marked.select("doc_id", F.size("known").cast("long").alias("n_known"), "known", matched.alias("licences"))


def oracle_sql(max_gap: int = MAX_GAP) -> str:
    """The same scan of ``documents`` in SQL, with licences as text."""
    codes, rules = _tables()
    values = ", ".join(f"('{part}', {code})" for part, code in codes.items())
    steps, last = [], "s0"
    for k, (licence, kind, pattern) in enumerate(rules, 1):
        n = f"((length(seq) - length(replace(seq, '{pattern}', ''))) // {len(pattern)})"
        steps.append(f"s{k} AS (SELECT r, doc_id, n_known, replace(seq, '{pattern}', '|') AS seq, "
                     f"CASE WHEN {n} > 0 THEN list_append(hits, '{licence}:{kind}=' || {n}) ELSE hits END AS hits FROM {last})")
        last = f"s{k}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '{STOPS}', chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS ss FROM documents),
u AS (SELECT r, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM d),
k AS (SELECT r, i, code, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1) AS gap FROM u JOIN (VALUES {values}) v(s, code) USING (s)),
q AS (SELECT r, count(*) AS n, string_agg(CASE WHEN gap > {max_gap + 1} THEN '|' ELSE '' END || '<' || code || '>', '' ORDER BY i) AS seq FROM k GROUP BY r),
s0 AS (SELECT d.r, doc_id, coalesce(n, 0) AS n_known, coalesce(seq, '') AS seq, []::VARCHAR[] AS hits FROM d LEFT JOIN q USING (r)),
{", ".join(steps)}
SELECT doc_id, n_known, array_to_string(hits, ';') AS licences FROM {last}"""
