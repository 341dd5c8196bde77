"""Language, quality, licenses, LM scoring and LZ fingerprints against plain versions and odd rows."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import langid, licenses, lmscore, lzprint, quality
from sondage.llm.common import crc_mod


def test_gram_counts_match_a_plain_count():
    text = "Été à la  mer, l'eau! straße ÀB c"
    grams, counts = langid.counted(langid.gram_keys(text))
    want = Counter()
    words = [w for w in re.split(r"[^\w]+|\d|_", text) if w]
    for w in words:
        w = "\x01" + w.lower() + "\x01"
        for c in w[1:-1]:
            want[ord(c)] += 1
        for i in range(len(w) - 2):
            want[ord(w[i]) | ord(w[i + 1]) << 21 | ord(w[i + 2]) << 42] += 1
    singles = {int(g): int(n) for g, n in zip(grams, counts) if g < 2**21 or g >= 2**42}
    assert singles == dict(want)


def test_profiles_cover_all_rows_and_judge_them(spark, docs, empty):
    profiles = langid.fit_profiles(docs, where=crc_mod("doc_id", 4) != 2)
    assert set(profiles) == {"en", "es", "fr"} or set(profiles) == {"en", "es"}
    got = langid.identify(docs, profiles).select("row.doc_id", "row.text", "row.lang", "lang_pred", "score").collect()
    assert len(got) == docs.count()
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0.0 < r["score"] <= 1.0
    assert sum(r["lang_pred"] == r["lang"] for r in got if r["lang"] in ("en", "es") and r["text"] and len(r["text"]) > 30) > 55
    assert langid.fit_profiles(empty) == {}
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(empty, profiles).count() == 0


def test_out_of_place_distance():
    judge = langid.Judge({"a": langid.ranked(langid.gram_keys("aa ab")).tolist(), "b": langid.ranked(langid.gram_keys("bb bc")).tolist()})
    assert judge("aa ab") == ("a", 1.0)
    assert judge("bb bc")[0] == "b"
    assert judge("zz")[1] == 0.0


def test_held_out_accuracy_on_the_given_tables(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    lang = dict(con.execute(f"SELECT doc_id, lang FROM '{d}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    got = [r for r in entry.queries()["op6_langid"](spark, d).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.97
    mark = dict(con.execute(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall())
    got = [r for r in entry.queries()["op1_quality"](spark, d).collect() if r["held_out"] and r["doc_id"] in mark]
    assert np.mean([r["predicted"] == mark[r["doc_id"]] for r in got]) > 0.95


def test_quality_odd_rows(docs, empty, labels):
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).select("row.text", "score").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert quality.score_quality(empty, model).count() == 0
    flat = quality.fit_quality(empty, labels)
    assert flat.score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert len(quality.features(b"")) == len(quality.features(b"one two two")) == len(quality.FEATURES)


def test_model_is_a_sum_of_bins():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.Model(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95  # only a pair of features tells
    row = x[0]
    z = m.intercept + sum(t[np.searchsorted(c, row[f], side="right")] for f, (c, t) in enumerate(zip(m.cuts, m.tables)))
    z += sum(grid[np.searchsorted(m.coarse[f], row[f], side="right"), np.searchsorted(m.coarse[g], row[g], side="right")] for f, g, grid in m.pairs)
    assert math.isclose(1 / (1 + math.exp(-z)), m.score(x[:1])[0], rel_tol=1e-9)


def test_license_automata():
    automata = {n: licenses.Automaton(t) for n, t in licenses.TEMPLATES.items()}

    def labels(text):
        return licenses.scan(text.encode(), automata)[5]

    assert labels("Released under the terms of the MIT license.") == "mit"
    assert labels("Released under the nice MIT license.") == ""
    assert labels("x Licensed under the Apache License, Version 2.0. y") == "apache-2.0"
    assert labels("Licensed under the Apache License, Version 3.0.") == ""
    assert labels("Copyright (c) 2020 Some Body. All rights reserved.") == "proprietary,reserved"
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    a = licenses.Automaton("a <<var:2>> b <<optional>>c<<end>> d")
    for words, want in (("a b d", 1), ("a x b d", 1), ("a x y b c d", 1), ("a x y z b d", 0), ("a b c", 0)):
        assert a.accepts_from([w.encode() for w in words.split()], 0) == bool(want)


AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT_START = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, """
MIT = MIT_START + """and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """ + AS_IS
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = "3. Neither the name of the Example Company nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def gnu(kind, version):
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details."""


NOTICES = [
    ("mit", MIT), ("bsd-2-clause", BSD_HEAD + BSD_TAIL), ("bsd-3-clause", BSD_HEAD + BSD_NAMES + BSD_TAIL),
    ("gpl,gpl-2.0", gnu("General Public", "2")), ("gpl,gpl-3.0", gnu("General Public", "3")), ("agpl,gpl", gnu("Affero General Public", "3")), ("gpl,lgpl-2.1", gnu("Lesser General Public", "2.1")), ("gpl,lgpl-3.0", gnu("Lesser General Public", "3")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by-sa-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. """ + AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")),
]


@pytest.mark.parametrize("label,text", NOTICES, ids=[n for n, _ in NOTICES])
def test_whole_notices_are_accepted_and_altered_ones_are_not(label, text):
    automata = {n: licenses.Automaton(t) for n, t in licenses.TEMPLATES.items()}

    def labels(t):
        return licenses.scan(t.encode(), automata)[5]

    assert labels("Some lead.\n" + text + " Some end.") == label
    assert all(re.search(licenses.pattern(licenses.TEMPLATES[n]), " " + " ".join(re.findall("[a-z0-9]+", text.lower())) + " ") is not None for n in licenses.TEMPLATES if licenses.LABEL_OF.get(n, n) == label.split(",")[-1] and n.endswith(("-notice", "-text")))


def test_altered_wording_is_rejected():
    automata = {n: licenses.Automaton(licenses.TEMPLATES[n]) for n in ("mit-text", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "gpl-3.0-notice", "mpl-2.0")}

    def labels(t):
        return licenses.scan(t.encode(), automata, {})[5]

    assert labels(MIT_START + "but you shall pay me. " + AS_IS) == ""
    assert labels(MIT.replace("shall be included", "need not be included")) == "" and labels(MIT.replace("subject to the following conditions", "for money, subject to the following conditions")) == ""
    assert labels(BSD_HEAD + "3. You shall pay me.\n" + BSD_TAIL) == "" and labels(BSD_HEAD + BSD_NAMES.replace("may be", "must be") + BSD_TAIL) == ""
    words = MIT.split()
    kept = {"AUTHORS", "OR", "COPYRIGHT", "HOLDERS", "THE"}
    for at in range(0, len(words), 7):
        if words[at] not in kept:  # those may stand in the replaceable part
            assert labels(" ".join([*words[:at], "altered", *words[at + 1 :]])) == ""


def test_many_places_are_counted_on():
    text = "all rights reserved " * 200_000
    assert licenses.scan(text.encode(), {})[:4] == (600_000, 200_000, 0, 599_997)


def test_license_places_against_a_plain_scan(docs, empty):
    got = licenses.scan_licenses(docs).select("row.text", "n_words", "n_base", "first_word", "last_word").collect()
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        places = [i for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan(b"CC-BY cc by", {})[:4] == (4, 2, 0, 2)


def test_lm_losses_against_a_plain_model(docs, empty, labels):
    rows = docs.collect()
    got = lmscore.score(docs, labels).collect()
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
    words = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in rows]

    def counts(texts):
        one, two = Counter(), Counter()
        for t in texts:
            if t:
                one.update([*t, None])
                two.update(zip([None, *t], [*t, None]))
        return one, two, sum(one.values())

    (t1, t2, nt), (b1, b2, nb) = counts(t for i, t in words if i in good), counts(t for _, t in words)

    def losses(t):
        back, target = [], []
        for v, w in zip([None, *t], [*t, None]):
            pb = b1[w] / nb
            pt = (t1[w] + 4 * pb) / (nt + 4)
            back.append(-math.log((b2[v, w] + 4 * pb) / (b1[v] + 4)))
            target.append(-math.log((t2[v, w] + 4 * pt) / (t1[v] + 4)))
        return round(sum(target) / len(target), 8), round(sum(back) / len(back), 8)

    want = Counter((i, len(t), *(losses(t) if t else (None, None))) for i, t in words)
    have = Counter((r["doc_id"], r["n_tokens"], *(None if x is None else round(x, 8) for x in (r["target_loss"], r["background_loss"]))) for r in got)
    # rows that share an id and a length differ in their losses; sums in another order may round otherwise
    key = lambda x: tuple((v is None, v or 0) for v in x)
    for a, b in zip(sorted(want.elements(), key=key), sorted(have.elements(), key=key), strict=True):
        assert a[:2] == b[:2] and all(x is y or abs(x - y) < 1e-6 for x, y in zip(a[2:], b[2:]))
    assert all(r["score"] is None if not r["n_tokens"] else abs(r["score"] - r["target_loss"] + r["background_loss"]) < 1e-9 for r in got)
    # the size of the chunks changes nothing
    small = lmscore.score(docs, labels, chunk_bytes=200)
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"] or 0.0, 6)) for r in small.collect()) == sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"] or 0.0, 6)) for r in got)
    assert lmscore.score(docs, labels.limit(0)).where("score IS NOT NULL AND n_tokens > 0").count() == sum(bool(t) for _, t in words)
    assert lmscore.score(empty, labels).count() == 0


def plain_phrases(raw):
    seen, at, out = set(), 0, set()
    while at < len(raw):
        end = at + 1
        while end < len(raw) and raw[at:end] in seen:
            end += 1
        seen.add(raw[at:end])
        out.add(raw[at:end])
        at = end
    return out


def test_parse_and_signature():
    for raw in (b"abababababa", b"aaaaaaa", b"", b"x", "Été à la mer ".encode() * 40, bytes(range(256)) * 3):
        p = lzprint.Parser()
        p.feed(raw[: len(raw) // 3])
        q = p.copy()
        q.feed(raw[len(raw) // 3 :])
        cuts = q.cuts if q.cuts[-1] == len(raw) else [*q.cuts, len(raw)]
        assert {raw[a:b] for a, b in zip(cuts, cuts[1:])} == plain_phrases(raw)
    a, b = b"the quick brown fox " * 30, b"jumps over a lazy dog, " * 30

    def sig(raw):
        p = lzprint.Parser()
        p.feed(raw)
        return lzprint.signature(raw, p.cuts)

    exact = len(plain_phrases(a) & plain_phrases(a[:400] + b)) / len(plain_phrases(a) | plain_phrases(a[:400] + b))
    assert abs(lzprint.likeness(sig(a), sig(a[:400] + b)) - exact) < 0.25
    assert lzprint.likeness(sig(a), sig(a)) == 1.0


def test_edited_texts_and_neighbours(docs, empty):
    rows = sorted([(r["doc_id"], r["text"] or "") for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    got = lzprint.fingerprint_pairs(docs).collect()
    want = Counter()
    for k, (i, t) in enumerate(rows):
        cut, nxt = len(t) // 2, rows[(k + 1) % len(rows)][1]
        want[i, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_length = {}
    for r in got:
        by_length.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(by_length[0]) == 1
    assert lzprint.fingerprint_pairs(empty).count() == 0
    one = lzprint.fingerprint_pairs(docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_limits_reject_an_unlearned_language_and_letter_noise(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    rng = np.random.default_rng(7)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (50, 300) for _ in range(50)]
    rows = [(-1 - k, t, None) for k, t in enumerate(noise)]
    short = docs.where("length(text) > 200").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.substring("text", 1, 60).alias("text"), F.lit(None).cast("string").alias("lang"))
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(short).unionByName(docs)
    held_out = more.withColumn("was", F.col("lang")).withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    stays = {r["doc_id"] for r in cp.language(spark, held_out, "").collect()}
    assert not any(k < 0 for k in stays)
    long_texts = [(r["doc_id"], r["was"]) for r in held_out.where("length(text) > 400 AND doc_id < 1000000 AND was IS NOT NULL").collect()]
    assert np.mean([k in stays for k, w in long_texts if w == "fr"]) < 0.05
    assert np.mean([k in stays for k, w in long_texts if w != "fr"]) > 0.99
    stays = {r["doc_id"] for r in cp.language(spark, more, "").collect()}
    wanted = {r["doc_id"] for r in short.collect()}
    assert len(wanted & stays) > 0.99 * len(wanted)
