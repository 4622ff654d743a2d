"""Licence scans by sentence rules (operator 2).

A text loses its comment leaders and is normalised to lower-case letters and
digits; slots for holders, programs and versions take one form; the known
sentences, bounded by words and not denied, become identifiers, and so do the
names in an SPDX line. A licence rule is an ordered list of identifiers that
must occur in that order, others between them allowed. Everything runs in one
pass over each row, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import lookup
from graphloom.llm.common import ascii_lower, whole

#: A text without any of these words holds no known sentence.
TRIGGER = "licen[sc]e|copyright|permi|redistribut|warrant|public[^a-z0-9]+domain"
#: What begins a comment line, or ends a comment.
LEADER = r"(?m)^[\x20\x09]*(?:/?\*+/?|//+!?|#+|--+|;+|%+|<!--)"
#: An SPDX line up to its expression.
SPDX = r"spdx[^a-z0-9\n]+license[^a-z0-9\n]+identifier[^a-z0-9\n]+"
#: A sentence right after one of these words is denied, not granted.
DENIAL = r"not|not be|not yet|never|no longer|isn t|aren t|wasn t|weren t|neither|nor"
#: Parts of normalised sentences that vary, and the form they take.
SLOTS = (
    (r"\bneither the names? of (?:[a-z0-9]+ ){1,20}?nor the names of (?:its|their|the|any|other)(?: other)? contributors",
     "neither the name of the copyright holder nor the names of its contributors"),
    (r"\bin no event shall (?:[a-z0-9]+ ){1,20}?be liable for any claim",
     "in no event shall the authors or copyright holders be liable for any claim"),
    (r"\b(?:this |the )?[a-z0-9]+ is free software you can redistribute", "this program is free software you can redistribute"),
    (r"\b(?:this |the )?[a-z0-9]+ is distributed in the hope", "this program is distributed in the hope"),
    (r"\beither version ([0-9](?: [0-9])?) or at your option", r"either version \1 of the license or at your option"),
    (r"\bcopy modify (?:and or|and|or) distribute this software", "copy modify and or distribute this software"),
)

#: Sentences of public licences and notices, normalised.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-2": "licensed under the gnu general public license version 3",
    "gpl3-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-text": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-text": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "epl1-terms": "under the terms of the eclipse public license v1 0",
    "epl1-terms-2": "under the terms of the eclipse public license v 1 0",
    "epl2-terms": "under the terms of the eclipse public license v2 0",
    "epl2-terms-2": "under the terms of the eclipse public license v 2 0",
    "epl2-terms-3": "under the terms of the eclipse public license 2 0",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-notice": "distributed under the boost software license version 1 0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl11-terms": "subject to the mozilla public license version 1 1",
}
#: The GNU licences, their names in sentences and their versions.
GNU = (
    ("GPL", "gnu general public license", ("1", "2", "3")), ("LGPL", "gnu lesser general public license", ("2.1", "3")),
    ("LGPL", "gnu library general public license", ("2",)), ("AGPL", "gnu affero general public license", ("3",)),
)


def _gnu() -> tuple[dict[str, str], tuple]:
    """Notices of the GNU licences and their rules, made from one set of forms."""
    known, rules = {}, []
    for short, full, versions in GNU:
        for version in versions:
            v = version.replace(".", " ")
            under = f"this program is free software you can redistribute it and or modify it under the terms of the {full}"
            forms = {
                "terms": f"{under} as published by the free software foundation either version {v} of the license or at your option any later version",
                "only": f"{under} as published by the free software foundation version {v} of the license",
                "only-2": f"{under} version {v}", "notice-2": f"licensed under the {full} version {v}",
                "notice-v": f"licensed under the {full} v{v}",
            }
            name = f"{short}-{version}" if "." in version else f"{short}-{version}.0"
            for form, sentence in forms.items():
                key = f"{short.lower()}{version}-{form}"
                known[key] = sentence
                rules.append((name, (key,)))
    return known, tuple(rules)


SENTENCES |= _gnu()[0]

#: (licence, identifiers in order). A licence may have several rules.
RULES = (
    ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is", "mit-liability")),
    ("Apache-2.0", ("apache-notice",)), ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-comply", "apache-basis", "apache-see")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-grant",)), ("MPL-2.0", ("mpl2-terms",)), ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)), ("CC-BY-NC-4.0", ("cc-by-nc-text",)),
    ("CC-BY-4.0", ("cc-by-notice",)), ("CC-BY-4.0", ("cc-by-text",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)), ("CC-BY-SA-4.0", ("cc-by-sa-text",)),
    ("EPL-1.0", ("epl1-terms",)), ("EPL-1.0", ("epl1-terms-2",)), ("EPL-2.0", ("epl2-terms",)),
    ("EPL-2.0", ("epl2-terms-2",)), ("EPL-2.0", ("epl2-terms-3",)), ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-notice",)), ("BSL-1.0", ("bsl-grant",)), ("0BSD", ("0bsd-grant",)), ("MPL-1.1", ("mpl11-terms",)),
) + _gnu()[1]
#: Names in SPDX expressions, and the identifiers they give.
SPDX_NAMES = {
    "mit": "spdx-mit", "apache-2.0": "spdx-apache", "bsd-2-clause": "spdx-bsd2", "bsd-3-clause": "spdx-bsd3",
    "isc": "spdx-isc", "mpl-2.0": "spdx-mpl2", "unlicense": "spdx-unlicense", "cc-by-4.0": "spdx-cc-by",
    "cc-by-sa-4.0": "spdx-cc-by-sa", "cc-by-nc-4.0": "spdx-cc-by-nc", "mpl-1.1": "spdx-mpl11", "epl-1.0": "spdx-epl1",
    "epl-2.0": "spdx-epl2", "zlib": "spdx-zlib", "bsl-1.0": "spdx-bsl", "0bsd": "spdx-0bsd",
}
_SPDX_GNU = {name.lower(): f"spdx-{name.lower().removesuffix('.0').replace('-', '')}" for name, _ in _gnu()[1]}
#: What each of these identifiers means.
_NAMED = {name.lower(): name for name, _ in RULES}
RULES += tuple((_NAMED[name], (found,)) for name, found in (SPDX_NAMES | _SPDX_GNU).items())
SPDX_NAMES |= {name + end: found for name, found in _SPDX_GNU.items() for end in ("", "+", "-only", "-or-later")}
#: A licence that gives way to one whose rule contains its own.
YIELDS = {"BSD-2-Clause": "BSD-3-Clause"}


#: Known sentences, of those that begin alike the longest, with a denial before them.
KNOWN = rf"\b(?:(?:{DENIAL}) )?(?:" + "|".join(sorted(SENTENCES.values(), key=len, reverse=True)) + r")\b"
_IDS = {sentence: f"|{name}|" for name, sentence in SENTENCES.items()}
_SPDX_IDS = {name: f"|{found}|" for name, found in SPDX_NAMES.items()}


def normalised(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(ascii_lower(sentence), "[^a-z0-9]+", " "))
    return reduce(lambda c, slot: F.regexp_replace(c, slot[0], slot[1].replace("\\1", "$1")), SLOTS, plain)


def identifiers(text: Column) -> Column:
    """Identifiers of a text in order, each as ``|identifier|``, joined. A denied
    sentence is no sentence of the table."""

    def sentences(part: Column) -> Column:
        return F.transform(F.regexp_extract_all(normalised(part), F.lit(KNOWN), F.lit(0)), lambda s: lookup(_IDS, s))

    def expression(part: Column) -> Column:
        names = F.split(F.regexp_extract(part, rf"\A{SPDX}([^\n]*)", 1), r"[^a-z0-9.+-]+")
        return F.transform(names, lambda s: lookup(_SPDX_IDS, F.regexp_replace(s, r"[.-]+$", "")))

    parts = F.split(F.regexp_replace(ascii_lower(text), LEADER, ""), f"(?={SPDX})")
    return F.array_join(F.flatten(F.transform(parts, lambda p: F.when(
        p.rlike(rf"\A{SPDX}"), F.concat(expression(p), sentences(F.regexp_replace(p, r"\A[^\n]*", "")))
    ).otherwise(sentences(p)))), "")


def pattern(rule: tuple[str, ...]) -> str:
    return "%" + "%".join(f"|{name}|" for name in rule) + "%"


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_known, sentences, licenses`` of every document.

    ``sentences`` are the identifiers in the order of the text, ``licenses`` the
    names of the matching licences in alphabetical order, both joined by commas
    and empty where nothing is known (null and empty texts too). Repeated rows
    give repeated results; other columns are left behind.
    """
    text = whole("text")
    found = docs.select("doc_id", F.when(ascii_lower(text).rlike(TRIGGER), identifiers(text)).otherwise("").alias("s"))
    names = sorted({name for name, _ in RULES})
    hit = {name: reduce(lambda a, b: a | b, [F.col("s").like(pattern(rule)) for n, rule in RULES if n == name])
           for name in names}
    shown = [F.when(hit[n] & ~hit[YIELDS[n]] if n in YIELDS else hit[n], n) for n in names]
    known = F.filter(F.split("s", r"\|"), lambda s: s != "")
    return found.select(
        "doc_id", F.size(known).cast("long").alias("n_known"), F.array_join(known, ",").alias("sentences"),
        F.array_join(F.array(*shown), ",").alias("licenses"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL. Its expressions cannot look ahead, so SPDX lines
    are marked with a control character before the text is split there."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = lambda d: f"map([{', '.join(map(quoted, d))}], [{', '.join(map(quoted, d.values()))}])"
    plain = "trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"
    for slot, form in SLOTS:
        plain = f"regexp_replace({plain}, {quoted(slot.replace('{', '{{').replace('}', '}}'))}, {quoted(form)}, 'g')"
    known = lambda part: (
        f"list_transform(regexp_extract_all({plain.format(part)}, {quoted(KNOWN)}), lambda s: map_extract(ids, s)[1])")
    names = sorted({name for name, _ in RULES})
    hit = {n: "(" + " OR ".join(f"s LIKE '{pattern(rule)}'" for name, rule in RULES if name == n) + ")" for n in names}
    shown = ", ".join(f"CASE WHEN {hit[n]}{f' AND NOT {hit[YIELDS[n]]}' if n in YIELDS else ''} THEN '{n}' END" for n in names)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH tables AS MATERIALIZED (SELECT {table(_IDS)} AS ids, {table(_SPDX_IDS)} AS spdx),
    low AS MATERIALIZED (SELECT doc_id, {lower} AS t FROM documents),
    cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(translate(t, chr(30), ' '), {quoted(LEADER)}, '', 'g'),
                {quoted('(' + SPDX + ')')}, chr(30) || '\\1', 'g'), chr(30)) AS parts
            FROM low WHERE regexp_matches(t, {quoted(TRIGGER)})),
    found AS MATERIALIZED (SELECT doc_id, array_to_string(list_filter(flatten(list_transform(parts, lambda p:
        CASE WHEN regexp_matches(p, {quoted(chr(92) + 'A' + SPDX)})
        THEN list_concat(list_transform(
               string_split_regex(regexp_extract(p, {quoted(chr(92) + 'A' + SPDX + '([^' + chr(92) + 'n]*)')}, 1), '[^a-z0-9.+-]+'),
               lambda s: map_extract(spdx, regexp_replace(s, '[.-]+$', ''))[1]), {known("regexp_replace(p, '" + chr(92) + "A[^" + chr(92) + "n]*', '')")})
        ELSE {known('p')} END)), lambda s: s IS NOT NULL), '') AS s FROM cut, tables),
    every AS (SELECT doc_id, s FROM found UNION ALL SELECT doc_id, '' FROM low WHERE NOT regexp_matches(t, {quoted(TRIGGER)}))
    SELECT doc_id, CAST(len(list_filter(string_split(s, '|'), lambda x: x <> '')) AS BIGINT) AS n_known,
           array_to_string(list_filter(string_split(s, '|'), lambda x: x <> ''), ',') AS sentences,
           array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ',') AS licenses
    FROM every"""
