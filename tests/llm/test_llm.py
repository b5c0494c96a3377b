"""The training-data operators against brute-force versions, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, jaccard, langid, licenses, mtree, packing, quality, secrets, substrings, warc
from tidemark.llm.common import crc_fold

DOCS = "doc_id long, text string"
TESTDATA = "/root/testdata/sf0.001"


def words(r, n):
    return [("".join(r.choice(["an", "the", "or", "ti", "on", "re", "sh", "ou"]) for _ in range(r.randint(1, 4)))) for _ in range(n)]


def docs_df(spark, rows, parts=4):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCS + ", key string, length int, n int, piece string")
    return df.repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    rows = [(i, " ".join(words(r, r.randint(3, 220)))) for i in range(60)]
    shared = " ".join(words(r, 40))
    rows += [(100 + i, " ".join(words(r, 20)) + " " + shared + " " + " ".join(words(r, 10))) for i in range(12)]
    base = words(r, 140)
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"zz{r.randrange(10**6)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "a"), (304, "A"), (305, "a b"), (306, "é" * 400), (-7, rows[5][1]), (307, rows[5][1]), (308, rows[5][1].upper()), (309, "abc" * 300), (310, "x" + "abc" * 90 + "y")]
    return rows


def brute_components(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        return set() if not w else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}

    sets = {i: shingles(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 1024), (5, 80, 16)])
def test_jaccard(spark, corpus, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_df(spark, corpus), percent, k).collect()}
    assert got == brute_components(corpus, k, percent)


@pytest.mark.parametrize("block", [4, 4096])
def test_jaccard_stars(spark, monkeypatch, block):
    """Copies link to their centre, not to one another, and groups go over several blocks; two centres differ by a little too much."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r, rows = random.Random(12), []
    for star in range(14):
        centre = words(r, 60)
        rows.append((star * 100 + 50, " ".join(centre)))
        for i in range(11):
            w = list(centre)
            w[4 + i * 5] = f"edit{i}"
            rows.append((star * 100 + (i if i < 6 else 60 + i), " ".join(w)))
    far = words(r, 400)
    for i in range(30):
        w = list(far)
        for j in range(10 + i % 3):
            w[3 + (i % 2) * 200 + j * 12] = f"other{i}"
        rows.append((5000 + i, " ".join(w)))
    assert len({i for i, _ in rows}) == len(rows)
    for k, percent in ((3, 90), (5, 80)):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(docs_df(spark, rows), percent, k).collect()}
        assert got == brute_components(rows, k, percent)


def test_jaccard_very_long_text(spark, monkeypatch):
    """At the real length of a piece: two copies of a text of 5 MB with an edit, and one of its halves."""
    text = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(640_000))
    assert len(text) > jaccard.PIECE
    rows = [(1, text), (2, text.replace("w7919 ", "changed ", 1)), (3, text[: len(text) // 2]), (4, None)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard.join(docs_df(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_jaccard_empty_table(spark):
    assert jaccard.join(docs_df(spark, [])).count() == 0


def test_sketch_bounds_difference():
    """Hamming distance and differing words never exceed the symmetric difference; close sets share a key."""
    r = np.random.default_rng(1)
    for n in (4, 20, 150, 900):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for percent in (80, 90):
            d = int(len(a) * (100 - percent) / 100)
            b = a[d:]
            far = sum(bin(x ^ y).count("1") for x, y in zip(jaccard.wide_sketch(a), jaccard.wide_sketch(b)))
            assert far <= d and jaccard.enough(len(b), len(a), len(b), percent)
            keys = [{k for lay in jaccard.layouts(len(s), percent, [1]) for k in jaccard.sketch_words(s, *lay).tolist()} for s in (a, b)]
            assert keys[0] & keys[1]


def test_unrelated_long_sets_are_not_verified():
    """A sketch of 1024 bits is full at some 2,000 shingles, so that any two long sets of a group were candidates."""
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (3000, 3050, 2700, 5500, 5400, 6000)]
    sets.append(np.unique(np.concatenate((sets[0], sets[1][:400]))))
    n, zero, yes = np.array([len(s) for s in sets]), np.zeros(len(sets), dtype=np.int64), np.ones(len(sets), dtype=bool)
    wide = jaccard.Sketches([jaccard.wide_sketch(s) for s in sets])
    assert len(set(wide.words.tolist())) > 1  # of two lengths
    i, j, far = jaccard._near(zero, yes, yes, np.arange(len(sets)), n, wide, 80)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 6)]
    for a in range(len(sets)):
        for b in range(a):
            apart = int(wide.far(np.array([a]), np.array([b]))[0])
            assert apart == int(wide.far(np.array([b]), np.array([a]))[0]) <= len(np.setxor1d(sets[a], sets[b]))


def test_jaccard_in_turns(spark, corpus):
    """Keys of different turns are different ones, each is in one turn, and components stay."""
    docs = docs_df(spark, corpus)
    keys = lambda *turn: {tuple(r) for r in jaccard._keys(docs, 5, 80, *turn).collect()}
    each = [keys(turn, 2) for turn in range(2)]
    assert all(each) and not {k for k, *_ in each[0]} & {k for k, *_ in each[1]} and each[0] | each[1] == keys()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, 80, 5, turns=2).collect()}
    assert got == brute_components(corpus, 5, 80)


def test_pipeline_keeps_one_stage_on_disk(spark, monkeypatch):
    import glob

    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.range(10).withColumnRenamed("id", "doc_id"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"only_{i}", lambda s, docs, d, i=i: docs.where(f"doc_id <> {i}")) for i in range(4)])
    assert corpus_pipeline.run(spark, "").count() == 6
    assert [p.rpartition("/")[2] for p in glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/tidemark/*/only_*")] == ["only_2"]


def test_components_of_a_path(spark):
    n = 60
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, n)}


def brute_substrings(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b, spans = (t or "").encode(), []
        for s in range(len(b) - width + 1):
            h = b[s : s + width]
            if h in seen:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + width
                else:
                    spans.append([s, s + width])
            seen.add(h)
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        out[i] = (len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("segment", [None, 300])
def test_substrings(spark, corpus, monkeypatch, segment):
    if segment:
        monkeypatch.setattr(substrings, "SEGMENT", segment)
        monkeypatch.setattr(substrings, "CHUNK", 2000)
        monkeypatch.setattr(substrings, "GROUP", 3)  # most anchors go the way of crowded ones
    got = {r[0]: tuple(r[1:5]) for r in substrings.deduplicate(docs_df(spark, corpus)).collect()}
    assert got == brute_substrings(corpus)


def test_substrings_very_long_text_and_missing_ids(spark):
    """At the real constants: texts longer than a segment, a repeat over a segment's edge, rows without an id."""
    r = random.Random(6)
    long = " ".join(str(r.random()) for _ in range(40_000))
    edge = substrings.SEGMENT
    rows = [(1, long), (2, "a " + long[edge - 700 : edge + 500] + " b"), (3, "x" * 300_000), (None, long[5000:5400]), (None, None)]
    got = {r[0]: tuple(r[1:5]) for r in substrings.deduplicate(docs_df(spark, rows)).where("doc_id is not null").collect()}
    want = brute_substrings([(-9, rows[3][1]), *rows[:3]])
    assert got == {i: want[i] for i in (1, 2, 3)}
    none = substrings.deduplicate(docs_df(spark, rows)).where("doc_id is null").select("n_bytes", "n_removed").collect()
    assert sorted(map(tuple, none)) == [(0, 0), (400, 0)]


def test_substrings_repeated_rows_and_empty(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(90))
    rows = [(1, text), (1, text), (2, text)]
    got = sorted((r[0], r[2]) for r in substrings.deduplicate(docs_df(spark, rows)).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    assert substrings.deduplicate(docs_df(spark, [])).count() == 0


def test_substrings_of_shared_and_missing_ids(spark):
    """Different texts of one id, or of none, are documents of their own, in the order of their SHA-256."""
    r = random.Random(12)
    a, b, c = (" ".join(str(r.random()) for _ in range(60)) for _ in range(3))
    for rows in ([(5, a + b), (5, b), (7, c + b)], [(None, a), (None, b + a), (1, b), (2, a)], [(5, a), (5, None), (5, a), (6, a), (None, None), (None, "x"), (None, a[:300])]):
        sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
        order = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, sha(x[1])))
        number = {x: n for n, x in enumerate(order)}
        want = brute_substrings([(n, t) for (_, t), n in number.items()])
        got = sorted((tuple(x) for x in substrings.deduplicate(docs_df(spark, rows)).collect()), key=str)
        assert got == sorted(((i, *want[number[i, t or ""]]) for i, t in rows), key=str)


def test_substrings_behind_a_common_header(spark):
    """These two share their anchor and 32 bits of the fingerprint of the whole, but no window."""
    head = "Permission to copy this notice is granted to any person who "
    rows = [(i, head + f" {i:09d} " + f"{i * 2654435761 % 10**29:029d}") for i in (69888, 265262)]
    got = sorted((r[0], r[2]) for r in substrings.deduplicate(docs_df(spark, rows)).collect())
    assert got == [(69888, 0), (265262, 0)]


def test_warc_round_trip(spark):
    rec = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://h/{i}", "<p>" + "lorem ipsum " * i) for i in range(150)]
    rows += [(900, None, None), (901, "http://a b\r\nc", ""), (902, "u", rec * 3), (903, "u", "x" * 500 + rec + "WARC/1.1\r\n" + "y" * 700), (904, "u", "x" * 500 + rec + "WARC/1.1\r\n" + "y" * 700), (905, "u", "WARC/1.1\r\n"), (907, "é", "é" * 600), (890, "é", "é" * 600), (908, "q", "small"), (909, "q", "small")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, file int").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r[0]: tuple(r[1:5]) for r in warc.round_trip(df).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    same = defaultdict(list)
    for i, _, h in rows:
        same[(h or "").encode()].append(i)
    want = {}
    for i, _, h in rows:
        b = (h or "").encode()
        last = max(same[b])
        revisit = len(b) >= 1000 and last != i
        want[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_long_headers_and_large_ids(spark):
    fake = f"WARC/1.1\r\nContent-Length: {2**63 - 1}\r\n\r\n"
    rows = [(1, "u", "first"), (2, "data:text/plain," + "x" * 100_000, "second"), (3, "u", fake), (4, "u", "last")]
    rows += [(10**18, "u", "a" * 1500), (2**63 - 1, "u", "a" * 1500), (-(2**63), "u", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest(), 2**63 - 1 if i == 10**18 else None) for i, _, h in rows}


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus + [(400, " ".join(words(random.Random(9), 1500)))]
    want = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for p, (a, n) in enumerate(packing.cut(len(ids), 128)):
            want[i, p] = (a, n, zlib.crc32(ids[a : a + n].tobytes()))
    out = packing.pack(docs_df(spark, rows), capacity=128).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    lengths = [n for _, n, _ in want.values()]
    assert len(bins) <= max(-(-sum(lengths) // 128), sum(n > 64 for n in lengths)) * 1.05 + 1  # two of more than half never share a bin
    seqs = packing.sequences(docs_df(spark, rows), capacity=128).collect()
    assert len(seqs) == len(bins) and all(len(s["input_ids"]) == sum(n for _, n in bins[s["sequence_id"]]) for s in seqs if s["sequence_id"] in bins)
    assert packing.pack(docs_df(spark, [])).count() == 0


def test_packing_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"end of page {mark} next", mark, mark * 3, f"  {mark}\n\n{mark}it's", f"a{mark}b <|endoftext| >", f"é  {mark}  ü", "<|ENDOFTEXT|>", f"<|{mark}|>", "x " * 40 + mark + " y" * 40]
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        for p, (a, n) in enumerate(packing.cut(len(ids), 32)):
            want[i, p] = (a, n, zlib.crc32(ids[a : a + n].tobytes()))
    out = packing.pack(docs_df(spark, list(enumerate(texts))), capacity=32).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want


def test_fullest_combination():
    r = random.Random(2)
    for _ in range(40):
        counts = {r.randint(1, 20): r.randint(1, 3) for _ in range(5)}
        slack = r.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        used = packing.fullest(counts, slack)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= slack) and all(n <= counts[k] for k, n in used.items())


def test_secrets(spark):
    r = random.Random(3)
    key = "".join(r.choice("0123456789abcdef") for _ in range(40))
    mixed = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(i, f'see token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" and ' + " ".join(words(r, 60) + [w.upper() for w in words(r, 30)] + ["".join(w.title() for w in words(r, 4)) for _ in range(30)]) + " TheTiOnReShOuTheAnTiOnRe2 version 1234567 20240101") for i in range(30)]
    rows += [(100, f'é password: token: abcdefgh12 x AKIA{"Z" * 12} y {key}'), (101, None), (102, ""), (103, "AKIA" + "B" * 11), (104, f"call {mixed} now"), (105, "API_KEY='short1'"), (106, "ſecret: abcdefghij"), (107, "secret=abcdefghij")]
    model = secrets.train(docs_df(spark, rows))
    got = {x["doc_id"]: x for x in secrets.scan(docs_df(spark, rows), model).collect()}

    def spans(text):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])

    for i, t in rows:
        base = spans(t or "")
        kinds = ["assign", "access", "hex"]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(k == n for _, k, _ in base) for n in range(3)]
    assert got[104]["spans"] == "markov:5:45" and not any("markov" in got[i]["spans"] for i in range(30))
    red = {x["doc_id"]: x["text"] for x in secrets.scan(docs_df(spark, rows), model, redact=True).collect()}
    assert red[104] == "call [SECRET] now" and key not in red[100] and red[101] is None
    assert secrets.secrets(docs_df(spark, [])).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of Example Widgets Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False), ""])


def test_licenses(spark):
    rows = [(1, "Text.\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nx"), (3, None), (4, ""), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "licensed under nothing"), (7, "LICENSED   under CC BY-NC 4.0."), (8, "A title\nReleased under the MIT License\nAnd more"), (5, "This work is licensed under the GNU General Public License, version 3."), (9, "word " * 200_000 + "\n\nReleased under the MIT License.")]
    got = [(r["doc_id"], r["n_matches"], r["licenses"]) for r in licenses.scan(docs_df(spark, rows)).collect()]
    assert sorted(got) == [(1, 1, "MIT"), (2, 3, "Apache-2.0"), (3, 0, ""), (4, 0, ""), (5, 1, "GPL-3.0-only"), (5, 1, "GPL-3.0-only"), (6, 0, ""), (7, 1, "CC-BY-NC-4.0"), (8, 1, "MIT"), (9, 1, "MIT")]
    assert licenses.scan(docs_df(spark, [])).count() == 0


def test_licence_texts_wrapped_and_commented(spark):
    texts = {"MIT": MIT, "BSD-2-Clause": BSD2 + AS_IS, "BSD-3-Clause": BSD2 + ENDORSE + AS_IS, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "MPL-2.0": MPL}
    rows, want = [], {}
    for name, text in texts.items():
        for width, mark in ((10_000, ""), (72, ""), (70, " * "), (60, "# "), (76, "// ")):
            rows.append((len(rows), "Copyright (c) 2001 Somebody\n\n" + wrapped(text, width, mark) + "\n\nint main() { return 0; }"))
            want[rows[-1][0]] = name
    rows.append((len(rows), MIT + "\n\n" + wrapped(BSD2 + ENDORSE, 72) + "\n\n" + BSD2))
    want[rows[-1][0]] = "BSD-2-Clause,BSD-3-Clause,MIT"
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs_df(spark, rows)).collect()} == want


def brute_top_k(vecs, k=5):
    """Scores of ids: the largest over the rows that share an id."""
    q = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 256).astype(int)) for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for a in {i for i, _ in q if i % 50 == 0}:
        best: dict[int, int] = {}
        for i, x in q:
            for j, y in q:
                if i == a and j != a:
                    best[j] = max(best.get(j, -(10**18)), int(x @ y))
        want |= {(a, n): (b, s) for n, (b, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k], 1)}
    return want


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:  # several parts of a leaf and several shares of the queries
        monkeypatch.setattr(mtree, "SPLIT", 20)
        monkeypatch.setattr(mtree, "CHUNK", 3)
        monkeypatch.setattr(mtree, "PAGE", 4)
    r = np.random.default_rng(5)
    vecs = [(i, r.normal(0, 0.2, 8).tolist()) for i in range(400)]
    vecs += [(400 + i, vecs[3][1]) for i in range(60)] + [(500, None), (550, [float("nan")] * 8), (551, [None] + [0.1] * 7), (552, [float("inf")] * 8), (None, [1.0] * 8)]
    vecs += [(i, vecs[i][1]) for i in (50, 100, 7)] + [(7, r.normal(0, 0.3, 8).tolist()), (150, r.normal(0, 0.3, 8).tolist())]  # repeated ids
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in vecs], "vec_id long, embedding array<float>, dist double, leaf int").repartition(4)
    got = {(x[0], x[1]): (x[2], x[3]) for x in mtree.top_k(df, F.col("vec_id") % 50 == 0, 5, capacity=16).collect()}
    assert got == brute_top_k(vecs)
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert mtree.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_top_k_prunes_clustered_vectors(spark):
    r = np.random.default_rng(9)
    centres = r.normal(0, 2, (40, 16))
    vecs = [(i, (centres[i % 40] + r.normal(0, 0.05, 16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    rows = mtree.search(df, F.col("vec_id") % 50 == 0, 5, capacity=64).agg(F.sum("products")).first()[0]
    assert rows < 0.35 * 80 * 4000


def test_quality_on_held_out(spark):
    docs, labels = spark.read.parquet(f"{TESTDATA}/documents.parquet"), spark.read.parquet(f"{TESTDATA}/labels.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "")], DOCS)
    got = quality.classify(docs.select("doc_id", "text").unionByName(extra), labels, crc_fold("doc_id", 3) != 1)
    rows = got.join(labels, "doc_id", "left").withColumn("held", crc_fold("doc_id", 3) == 1).collect()
    held = [r for r in rows if r["held"] and r["quality"] is not None]
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in held) / len(held) > 0.9 and all(0 <= r["score"] <= 1 for r in rows) and len(rows) == docs.count() + 2
    none = quality.classify(docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_equals_plain_discriminant(spark):
    """Every score against the textbook formula on explicit covariance matrices, inverted as a whole."""
    docs, labels = spark.read.parquet(f"{TESTDATA}/documents.parquet"), spark.read.parquet(f"{TESTDATA}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, crc_fold("doc_id", 3) != 1).collect()}
    x = {r["doc_id"]: np.array(quality.statistics(r["text"])) for r in docs.select("doc_id", "text").collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    rows = {c: np.array([x[i] for i in y if y[i] == c and i in x]) for c in (0, 1)}
    every = np.concatenate(list(rows.values()))
    mean, sd = every.mean(0), np.sqrt(np.maximum(every.var(0), 1e-6))
    pooled, d, parts = np.cov(every.T, bias=True) / np.outer(sd, sd), every.shape[1], {}
    for c, part in rows.items():
        cov = 0.9 * np.cov(part.T, bias=True) / np.outer(sd, sd) + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.eye(d) * np.trace(cov) / d + 1e-9 * np.eye(d)
        parts[c] = ((part.mean(0) - mean) / sd, np.linalg.inv(cov), np.linalg.slogdet(cov)[1], np.log(len(part) / len(every)))
    for i, v in x.items():
        z = (v - mean) / sd
        density = {c: prior - 0.5 * det - 0.5 * (z - m) @ inv @ (z - m) for c, (m, inv, det, prior) in parts.items()}
        want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 4.0, -30, 30)))
        assert abs(got[i] - want) < 1e-6


def test_language_equals_plain_average(spark):
    """Every prediction against the embeddings averaged subword by subword."""
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    model = langid.train(docs, crc_fold("doc_id", 4) != 2)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").limit(40).collect()}
    for r in langid.identify(docs.where(F.col("doc_id").isin(list(texts))), model).collect():
        raw = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in (" " + texts[r["doc_id"]] + " ").encode())
        total, count = np.zeros(len(model.langs)), 0
        for n in langid.ORDERS:
            for at in range(len(raw) - n + 1):
                h = 0
                for k, c in enumerate(raw[at : at + n], 1):
                    h = (h * 16777619 + c + k) % 2**32
                total += model.table[(h * 2654435761 % 2**32) >> 17]
                count += 1
        p = np.exp((total / count + model.bias) / model.temperature)
        p /= p.sum()
        assert r["lang_pred"] == model.langs[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4
    assert {langid.identify(docs, model, reject=1.01).select("lang_pred").distinct().first()[0]} == {"und"}


def test_language_of_long_texts_and_repeated_ids(spark):
    """Pieces give the counts of the whole; a repeated id is learnt from once."""
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text", "lang")
    text = " ".join(r["text"] for r in docs.where("text is not null").orderBy("doc_id").limit(150).collect())
    whole = np.unique(langid.buckets(text), return_counts=True)
    assert len(text) > langid.PIECE and all((a == b).all() for a, b in zip(langid.counts(text), whole))
    once = langid.train(docs, F.lit(True))
    again = langid.train(docs.unionByName(docs).unionByName(docs.where("doc_id < 20")), F.lit(True))
    assert (once.table == again.table).all() and langid.histograms(docs.unionByName(docs), F.lit(True), 50).count() == 50
    lang, score = once.predict(text)
    mean = (once.table[langid.buckets(text)].astype(float).mean(0) + once.bias) / once.temperature
    p = np.exp(mean - mean.max())
    assert lang == once.langs[int(p.argmax())] and abs(score - p.max() / p.sum()) < 1e-4


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 250_000), (5, "same text here"), (5, "same text here"), (None, "no id")]


def test_scans_and_classifiers_on_odd_rows(spark):
    """Null, empty, very long and repeated texts, a missing id, clashing columns and an empty table."""
    docs, labels = spark.read.parquet(f"{TESTDATA}/documents.parquet"), spark.read.parquet(f"{TESTDATA}/labels.parquet")
    odd = docs_df(spark, ODD).withColumns({"score": F.lit(3.0), "f": F.lit(1), "y": F.lit(2), "lang_pred": F.lit("x"), "ids": F.lit(0), "spans": F.lit(0), "lang": F.lit(None).cast("string")})
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text").where("doc_id > 10"))
    twice = labels.unionByName(labels)  # a label given twice counts once
    first = {r["doc_id"]: r["score"] for r in quality.classify(both, labels).where("doc_id > 10").collect()}
    assert {r["doc_id"]: r["score"] for r in quality.classify(both, twice).where("doc_id > 10").collect()} == pytest.approx(first)
    model = langid.train(docs, F.lit(True))
    keys = secrets.train(odd)
    results = {
        "quality": lambda d: quality.classify(d, labels), "keep": lambda d: quality.keep(d, labels, least=0.0), "language": lambda d: langid.identify(d, model),
        "licences": licenses.scan, "secrets": lambda d: secrets.scan(d, keys), "redacted": lambda d: secrets.scan(d, keys, redact=True), "packing": lambda d: packing.tokenize_pieces(d).where("piece = 0"),
    }
    for name, apply in results.items():
        assert apply(odd).count() == len(ODD), name
        assert apply(odd.limit(0)).count() == 0, name
    assert langid.train(odd, F.lit(True)).langs == []


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    model = langid.train(docs, crc_fold("doc_id", 4) != 2)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crc_fold("doc_id", 4) == 2).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.9
    odd = langid.identify(docs_df(spark, [(1, None), (2, ""), (3, "123 !? 4"), (4, "the and of")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in odd} == {1: True, 2: True, 3: True, 4: False}
    assert langid.identify(docs_df(spark, [(4, "the")]), langid.fit([])).first()["lang_pred"] == "und"


def test_decontamination(spark):
    r = random.Random(8)
    items = [(i, " ".join(words(r, r.randint(18, 50)))) for i in range(12)]
    rows = [(i, " ".join(words(r, 300))) for i in range(80)]
    leaks = {(100 + i, i): " ".join(words(r, 30)) + " " + t + ". " + " ".join(words(r, 25)) for i, t in items}
    near = {}
    for i, t in items[:5]:
        w = t.split()
        for j in range(0, len(w) - 9, 7):
            w[j] = "swapped"
        near[200 + i, i] = " ".join(words(r, 30)) + " " + " ".join(w) + " " + " ".join(words(r, 15))
    rows += [(d, t) for (d, _), t in (leaks | near).items()] + [(300, None), (301, ""), (302, "a")]
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    got = decontaminate.find_leaks(docs_df(spark, rows), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == set(leaks) | set(near)
    assert decontaminate.find_leaks(docs_df(spark, []), bench).count() == 0 and decontaminate.find_leaks(docs_df(spark, rows), bench.limit(0)).count() == 0


def brute_leaks(rows, items, min_lcs=0.8, min_paraphrase=0.6, answer=8):
    """Every item at every place of every text, by the confirming test alone."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: [w for w in re.split(r"[\x00-\x20.,;:!?\"()\[\]{}|#$%&*<>]+", (t or "").translate(low)) if w]
    number: dict[str, int] = {}
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in cut(t)], dtype=np.int64)
    texts, out = [(i, ids(t)) for i, t in rows], set()
    for item, t in items:
        q = ids(t)
        for doc, w in texts:
            if len(q) and len(np.intersect1d(q, w)) and any(decontaminate.confirm(w, q, at, min_lcs, min_paraphrase, answer)[1] for at in range(0, len(w), 2)):
                out.add((doc, item))
    return out


def test_decontamination_against_every_place(spark):
    """Verbatim items of 3 to 60 words, and paraphrases with words swapped, dropped and put in: recall of the search by vectors."""
    r = random.Random(21)
    items = [(i, " ".join(words(r, n))) for i, n in enumerate([3, 4, 5, 6, 8, 10, 14, 20, 28, 36, 44, 52, 60, 18, 24, 30])]
    rows, paraphrased = [(i, " ".join(words(r, 120))) for i in range(30)], set()
    for i, t in items:
        rows.append((100 + i, " ".join(words(r, r.randint(0, 30))) + " " + t + " " + " ".join(words(r, 20))))
        if len(t.split()) >= 18:
            for kind in range(3):
                w = t.split()
                for at in range(len(w) - 10, 0, -6):
                    w[at : at + 1] = (["swapped"], [], [w[at], "put", "in"])[kind]
                rows.append((200 + 10 * i + kind, " ".join(words(r, 25)) + " " + " ".join(w) + " " + " ".join(words(r, 15))))
                paraphrased.add((rows[-1][0], i))
    want = brute_leaks(rows, items)
    assert {(100 + i, i) for i, _ in items} <= want and paraphrased <= want
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs_df(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want
    assert {(100 + i, i) for i, _ in items} <= got
    assert len(got & paraphrased) >= 0.9 * len(paraphrased)


def plain_leaks(rows, items):
    """Independent of the module: word lists, longest common subsequence by a table over every stretch of text with room for insertions."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: [w for w in re.split(r"[\x00-\x20.,;:!?\"()\[\]{}|#$%&*<>]+", (t or "").translate(low)) if w]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    out = set()
    for doc, t in rows:
        w = cut(t)
        for item, q in ((i, cut(x)) for i, x in items):
            spans = [w[at : at + len(q) + len(q) // 3] for at in range(max(len(w) - len(q) + 1, 1))]
            if q and any(len(set(q) & set(s)) >= 0.6 * len(set(q)) and (lcs(q, s) >= 0.8 * len(q) or lcs(q, s) >= 0.6 * len(q) and lcs(q[-8:], s) >= 0.75 * len(q[-8:])) for s in spans):
                out.add((doc, item))
    return out


def test_decontamination_against_a_plain_version(spark):
    r = random.Random(31)
    items = [(i, " ".join(words(r, n))) for i, n in enumerate([1, 2, 3, 4, 4, 7, 12, 25, 40])] + [(90, "..."), (91, "Only, TWO")]
    rows = [(i, " ".join(words(r, 90))) for i in range(25)] + [(100 + i, " ".join(words(r, 20)) + " " + t + " " + " ".join(words(r, 9))) for i, t in items] + [(200, "only two"), (201, "two only"), (202, "onlytwo"), (203, items[5][1] + "x"), (204, "x" + items[6][1] + " y")]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs_df(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_leaks(rows, items)
    verbatim = {(100 + i, i) for i, t in items if t != "..."} | {(200, 91)}
    assert verbatim <= got and (202, 91) not in got
    assert got <= want and all(w in got for w in want if w[0] >= 100 and w[0] - 100 == w[1])


def test_decontamination_compares_words_not_terms(spark):
    """A text of other words with the same 16-bit terms is no leak."""
    hasher = decontaminate.Hasher(space=decontaminate.BREAKS)
    r = random.Random(3)
    item = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(12)]
    term = lambda ws: (hasher.word_hashes(" ".join(ws)) >> np.uint64(48)).astype(int).tolist()
    wanted, twins = dict(zip(term(item), item)), {}
    for n in range(60):
        pool = [f"q{n:02d}{i:05d}" for i in range(40_000)]
        twins.update({t: w for t, w in zip(term(pool), pool) if t in wanted})
        if len(twins) == len(wanted):
            break
    twin = " ".join(twins[t] for t in term(item))
    assert term(twin.split()) == term(item)
    rows = [(1, "some words before " + twin + " and after"), (2, "some words before " + " ".join(item) + " and after")] + [(10 + i, " ".join(words(r, 60))) for i in range(40)]
    got = [(x["doc_id"], x["lcs"]) for x in decontaminate.find_leaks(docs_df(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()]
    assert got == [(2, 1.0)]


def test_decontamination_long_texts_and_many_items(spark, monkeypatch):
    r = random.Random(23)
    item = words(r, 400)
    monkeypatch.setattr(decontaminate, "PART", 4096)
    rows = []
    for i, at in enumerate((3000, 3800, 4000, 4090, 4096, 4300, 9000)):  # over the edges of parts
        rows.append((i, " ".join([*words(r, at), *item, *words(r, 3000)])))
    bench = spark.createDataFrame([(1, " ".join(item))] * 2001 + [(None, " ".join(item)), (2, None)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["lcs"], x["start_word"]) for x in decontaminate.find_leaks(docs_df(spark, rows), bench).collect()}
    assert got == {(i, k): (1.0, at) for i, at in enumerate((3000, 3800, 4000, 4090, 4096, 4300, 9000)) for k in (1, None)}
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 2)  # in blocks the answer is the same
    short = [(i, " ".join(words(r, 30))) for i in range(7)]
    rows = [(i, " ".join(words(r, 50)) + " " + t + " " + " ".join(words(r, 10))) for i, t in short]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs_df(spark, rows), spark.createDataFrame(short, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(7)}


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(30):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 15))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a), np.array(b)) == t[-1][-1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    frames = [docs]
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, frames[-1], TESTDATA).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frames[-1].columns == docs.columns
    kept = [{r[0] for r in f.select("doc_id").collect()} for f in frames]
    assert kept[0] > kept[1] >= kept[2] >= kept[3] == kept[4] == kept[5]
    after = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    roots = brute_components(list(after.items()), 5, 80)
    assert kept[2] == {i for i, (_, root) in roots.items() if i == root}
    assert all(r["text"] == secrets.redacted(r["text"], secrets.ratio_matrix(np.zeros((2, 68, 68))), 9.9) for r in frames[4].limit(50).collect())
    assert {(r["doc_id"]) for r in corpus_pipeline.run(spark, TESTDATA).collect()} == kept[5]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, very long and repeated texts, extra columns with clashing names, and an empty table, through every stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    few = docs.orderBy("doc_id").limit(30)
    odd = spark.createDataFrame([(10**7, None, None, None, None), (10**7 + 1, "", "en", "s", 0), (10**7 + 2, "word " * 300_000, "en", "s", 1_500_000), (None, "no id", None, None, 5)], docs.schema)
    extra = {"score": F.lit(1.5), "n": F.lit(3), "z": F.lit("z"), "key": F.lit(7), "component_id": F.lit(1), "item_id": F.lit(2), "length": F.lit(9), "string": F.lit("q")}
    mixed = few.unionByName(few.limit(5)).unionByName(odd).withColumns(extra)
    for table in (mixed, mixed.limit(0)):
        at = table
        for i, (name, apply) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{table is mixed}/{i}"
            apply(spark, at, TESTDATA).write.parquet(path)
            after = spark.read.parquet(path)
            if name != "best_fit_packing":
                assert after.columns == table.columns and after.count() <= at.count()
            at = after
        assert (at.count() > 0) == (table is mixed)


def test_secrets_recall_on_held_out(spark):
    """Markov spans: random strings that no base pattern knows are found, ordinary identifiers are not."""
    r = random.Random(17)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rand = lambda: "".join(r.choice(alphabet) for _ in range(r.randint(28, 44)))
    name = lambda: "".join(w.title() for w in words(r, r.randint(5, 9)))
    train = [(i, f"api_key = {rand()} and {name()} with {name()} " + " ".join(words(r, 40))) for i in range(150)]
    model = secrets.train(docs_df(spark, train))
    held = [(1000 + i, f"see {rand()} here") for i in range(200)] + [(2000 + i, f"see {name()} here") for i in range(200)]
    got = {x["doc_id"]: "markov" in x["spans"] for x in secrets.scan(docs_df(spark, held), model).collect()}
    assert sum(got[i] for i, _ in held[:200]) >= 170 and sum(got[i] for i, _ in held[200:]) <= 4
