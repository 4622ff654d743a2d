"""Quality, token counts, licences, line dedup and byte-level BPE against plain versions."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, licenses, line_dedup, quality, token_counts

from .conftest import rows

SPACES = " \t\n\x0b\x0c\r"
ODD = [
    None, "", " ", "\n\n", "a", "aa" * 700, " " * 300, "it's  the\n\n end\t", "naïve 漢字 🙂 x", "\x00\x1c\x85",
    "<|endoftext|>a<|endoftext|>", "The The the " * 60, "a ", "word " * 20_000, "a1!? " * 9,
]


def texts(seed, n=150):
    pick = random.Random(seed)
    parts = ["the", "ing", " ", "  ", "\n", "é", "1", "漢", "'s", "!!", " ", "aaa", "<|endoftext|>", "Zq", "\t"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 50))) for _ in range(n)]


def table(docs, more=()):
    every = ODD + texts(1)
    return every, docs([*enumerate(every), (0, None), (4, "a"), *more])


def test_token_counts(docs):
    every, df = table(docs)
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(
        df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=100).collect()
    assert len(got) == len(every) + 2
    for r in got:
        text = every[r.doc_id] or ""
        n = len(tool.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)


def test_byte_bpe(docs):
    every, df = table(docs)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.round_trip(df, path, public_tokenizers.PATTERN, tokens=True).collect()
    assert len(got) == len(every) + 2
    for r in got:
        text = every[r.doc_id] or ""
        packed = np.array(tool.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r.tokens) == packed and r.n_tokens == len(packed) // 4
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.round_trip(docs([]), path, public_tokenizers.PATTERN).count() == 0


def plain_quality(text):
    words = [w for w in text.translate(str.maketrans(dict.fromkeys(SPACES, " "))).split(" ") if w]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {
        w for w in set(windows) if sum(w == x for x in windows) > 1}
    hit = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_quality(docs):
    every, df = table(docs)
    got = quality.quality(df).collect()
    assert len(got) == len(every) + 2
    for r in got:
        text = every[r.doc_id] or ""
        want = plain_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.quality(docs([])).count() == 0


def test_quality_bands(docs):
    pick = random.Random(3)
    prose = " ".join("".join(pick.choice(["ta", "ren", "mo", "li", "es", "or"]) for _ in range(pick.randint(1, 4))) for _ in range(400))
    noise = " ".join(base64.b64encode(pick.randbytes(90)).decode() for _ in range(80))
    half = " ".join(f"{k % 7}{'abcdefg'[k % 5]}" for k in range(1500))
    got = rows(quality.quality(docs([(1, prose), (2, noise), (3, prose + " " + half * 4)])))
    assert got[1].kept and not got[2].kept and not got[3].kept
    assert not got[2].base_failed
    assert got[1].ratio == pytest.approx(len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(prose.encode())) / len(prose.encode()))


def test_licenses(docs):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction,\nincluding without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
           "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
           "WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
           "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
           "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
    bsd = [licenses.SENTENCES[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    got = rows(licenses.license_scan(docs([
        (1, None), (2, ""), (3, "words\nReleased under the MIT License.\nmore"), (4, mit), (5, ". ".join(bsd)),
        (6, ". ".join(bsd[:3])), (7, ". ".join([bsd[1], bsd[0], bsd[2]])), (8, "a licence of no kind. " * 2000),
        (9, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."),
    ])))
    assert [got[k].licenses for k in range(1, 10)] == [
        "", "", "MIT", "MIT", "BSD-3-Clause", "BSD-2-Clause", "", "", "Apache-2.0,CC-BY-NC-4.0"]
    assert got[9].sentences == "cc-by-nc-notice,apache-notice" and got[9].n_known == 2
    assert licenses.license_scan(docs([])).count() == 0


def notices():
    gpl = ("This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published "
           "by the Free Software Foundation; {2}.")
    bsd = [licenses.SENTENCES[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    return [
        (". ".join(bsd).replace("the copyright holder nor", "Google Inc. nor"), "BSD-3-Clause"),
        (gpl.format("program", "General Public License", "version 2 of the License"), "GPL-2.0"),
        ("# " + gpl.format("program", "General Public License version 2", "no more"), "GPL-2.0"),
        (gpl.format("library", "Lesser General Public License", "either\n * version 2.1 of the License, or (at your option) any later version"), "LGPL-2.1"),
        (gpl.format("tool", "Affero General Public License", "either version 3 of the License, or (at your option) any later version"), "AGPL-3.0"),
        ("// SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"),
        ("x\n# SPDX-License-Identifier: EPL-2.0 OR GPL-2.0+ WITH Classpath-exception-2.0\nLicensed under the MIT license", "EPL-2.0,GPL-2.0,MIT"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
         "provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
        ("This is not licensed under the MIT License.", ""), ("It isn't licensed under the MIT License.", ""),
        ("Not licensed under the MIT License. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        ("Made available under the terms of the Eclipse Public License v1.0 which accompanies it", "EPL-1.0"),
        ("The contents are subject to the Mozilla Public License Version 1.1", "MPL-1.1"),
        ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ]


def test_licenses_with_slots_versions_and_denials(docs):
    import duckdb

    table = [(k, t) for k, (t, _) in enumerate(notices())]
    table += [(100, APACHE), (101, None), (102, ""), (103, "licence \x1e words " * 50), (104, APACHE), (104, APACHE)]
    found = licenses.license_scan(docs(table)).collect()
    got = rows(licenses.license_scan(docs(table)))
    assert [(k, got[k].licenses) for k in range(len(notices()))] == [(k, x) for k, (_, x) in enumerate(notices())]
    documents = docs(table).select("doc_id", "text").toPandas()  # noqa: F841 (read by the statement)
    plain = duckdb.sql(f"SELECT doc_id, n_known, sentences, licenses FROM ({licenses.oracle()})").fetchall()
    assert sorted(map(tuple, found)) == sorted(plain)


APACHE = """/*
 * Copyright (C) 2020 Foo
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *      http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package foo;"""


def test_licenses_in_comments_and_parts(docs):
    mit = [licenses.SENTENCES[f"mit-{x}"].split() for x in ("grant", "keep", "as-is", "liability")]
    lines = ["Copyright (c) 2020 Foo"] + [" ".join(w[k:k + 9]) + ":" * (k + 9 >= len(w)) for w in mit for k in range(0, len(w), 9)]
    got = rows(licenses.license_scan(docs([
        (1, APACHE), (2, APACHE.replace(" *", " #").replace("/*", "#")), (3, "\n".join(f"// {x}" for x in lines)),
        (4, "This project is released under the MIT License."), (5, "; SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)\nmov"),
        (6, "# SPDX-License-Identifier: MIT-0"), (7, "This is free and unencumbered software released into the public\n-- domain."),
        (8, "The terms of Mozilla follow. This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0."),
        (9, "unreleased under the MIT licensees"), (10, "// SPDX-License-Identifier: ISC\n" + APACHE),
    ])))
    assert [got[k].licenses for k in range(1, 11)] == [
        "Apache-2.0", "Apache-2.0", "MIT", "MIT", "BSD-3-Clause,GPL-2.0", "", "Unlicense", "MPL-2.0", "", "Apache-2.0,ISC"]
    assert got[1].sentences == "apache-header,apache-basis,apache-see"
    assert got[10].sentences == "spdx-isc," + got[1].sentences and got[3].n_known == 4


def plain_lines(table):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    split = {i: (t or "").split("\n") for i, t in table.items()}
    holders = {}
    for i, ls in split.items():
        for k in {key(x) for x in ls}:
            holders.setdefault(k, set()).add(i)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    return {i: (len(ls), [x for x in ls if hot.get(key(x), i) <= i]) for i, ls in split.items()}


def test_line_dedup(docs):
    long, other = "X" * 20 + " é" * 10 + "b", "another line that is long enough to be counted"
    table = {k: f"{k}\n {long.swapcase() if k % 2 and False else long}\t\nshort" for k in range(8)}
    table |= {8: f"{long}\n{long}\n", 9: None, 10: "", 11: "x" * 39, 30: "\n\n"}
    table |= {k: other.upper() + f"\n{k}" for k in range(12, 16)} | {k: "x" * 39 for k in range(16, 22)}
    table |= {k: "y" * 40 for k in range(22, 27)}
    want = plain_lines(table)
    got = rows(line_dedup.line_dedup(docs(list(table.items()))))
    assert {i: (r.n_lines, r.n_dropped, r.text) for i, r in got.items()} == {
        i: (n, n - len(kept), "\n".join(kept)) for i, (n, kept) in want.items()}
    twice = line_dedup.line_dedup(docs(list(table.items()) + [(8, table[8]), (None, long)]))
    assert twice.count() == len(table) + 2
    assert twice.filter("doc_id IS NULL AND n_dropped = 0").count() == 1
    assert line_dedup.line_dedup(docs([])).count() == 0


def test_runs_compact(spark):
    """Counts and keepers survive any number of batches and compactions."""
    runs = line_dedup.Runs(fan=2)
    for b in range(5):
        runs.add(spark.range(3).selectExpr("id AS h1", f"id % (1 + {b}) AS h2", f"{100 - b}L AS keeper", "2L AS n"))
    assert len(runs.all()) == 2 and all(len(level) < 2 for level in runs.levels)
    total = line_dedup.compact(runs.all()).agg(F.sum("n"), F.max("keeper")).first()
    assert tuple(total) == (30, 100)
