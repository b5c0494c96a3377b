"""Cross-tokenizer alignment against a brute-force version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import alignment

DOCS = "doc_id long, text string"


def brute(rows):
    tok = alignment.Tokenizers()
    decode = {i: bytes([b]) for i, b in ((tok.b.piece_to_id(f"<0x{b:02X}>"), b) for b in range(256))}
    docs, holders = [], Counter()
    for doc_id, text in rows:
        a = tok.a.encode_ordinary(" " + text) if text else []
        b = tok.b.encode(text) if text else []
        ab, bb = [tok.a.decode_single_token_bytes(i) for i in a], [decode.get(i) or tok.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            docs.append((doc_id, [], [], 0, Counter(), ""))
            continue
        spans = []
        for parts in (ab, bb):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links, j = Counter(), 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links[a[i], b[k]] += 1
                k += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for end in ends:
            ga, gb = [], []
            while i < len(a) and spans[0][i][1] <= end:
                ga.append(a[i])
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        holders.update(links.keys())
        docs.append((doc_id, a, b, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (x, _), n in holders.items():
        top[x] = max(top[x], n)
    out = [(d, len(a), len(b), g, sum(li.values()), sum(n for p, n in li.items() if holders[p] == top[p[0]]), sum(n * holders[p] for p, n in li.items()), h) for d, a, b, g, li, h in docs]
    return sorted(out, key=str), holders, top


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    parts = ["straße", " the", "ing", "\n", "  ", "\t", "日本", "😀", "é", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x41>", "1234", "'s", ".", "\r\n", "an", " tion", "\x00", "\x1c", "á", "ﬁ", " ", "　", "ü"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 60)))) for i in range(150)]
    rows += [(200 + i, " ".join(r.choice(["the", "engine", "runs", "quietly", "zeta"]) for _ in range(r.randint(1, 300)))) for i in range(60)]
    return rows + [(300, None), (301, ""), (302, " "), (303, "a▁b"), (304, rows[3][1]), (304, rows[3][1]), (304, "other"), (None, "no id"), (305, "x" * 5000), (306, "the engine " * 20000)]


@pytest.mark.parametrize("radices,run_bytes,fan_in", [(256, 4 << 20, 64), (4, 900, 3)])
def test_alignment(spark, corpus, radices, run_bytes, fan_in):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in corpus], DOCS + ", run int, docs string, radix string").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(df, radices, run_bytes, fan_in).collect()), key=str)
    want, _, _ = brute(corpus)
    assert got == want


def test_pair_counts(spark, corpus):
    _, holders, top = brute(corpus)
    got = {(r["a"], r["b"]): (r["docs"], r["best"]) for r in alignment.pair_counts(spark.createDataFrame(corpus, DOCS).repartition(4), 8).collect()}
    assert got == {p: (n, n == top[p[0]]) for p, n in holders.items()}


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).collect() == []
    assert [tuple(r)[1:] for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], DOCS)).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_merge_in_chunks():
    r = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(9):
        keys = np.unique(r.integers(0, 500, 200))
        counts = r.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append(iter([(keys[s : s + 17], counts[s : s + 17]) for s in range(0, len(keys), 17)]))
    got = [(int(k), int(n)) for keys, counts in alignment.merged(runs) for k, n in zip(keys, counts)]
    assert got == sorted(want.items())
