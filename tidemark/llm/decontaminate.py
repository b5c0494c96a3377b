"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to 2**16 terms. Inverse document frequencies and a randomised
SVD of the TF-IDF passages come from the whole corpus: every task adds up its
share of A'Y and Y'Y for Y = A * Omega, whose sizes are fixed, and the small
factorisation follows from these sums. The leading directions hold languages and
common phrases; rare words, which tell passages apart, lie mostly outside them, so
a random projection of the orthogonal rest completes the latent vector.

Every document is then read once, in windows of a few lengths at a stride of
``STRIDE`` words; windows whose cosine with a benchmark passage reaches
``min_cosine`` are candidates. A candidate is confirmed when the longest common
subsequence covers ``min_lcs`` of the item's words, or at least
``min_paraphrase`` of them with its closing words (the answer) also present.
Terms only propose: words are compared by 48 bits of their hashes.

Items of up to ``SHORT`` words are too short for a direction in any space, and their words
stand near each other by chance. They are looked up instead: a text holds one where its
words stand in a row.

The benchmark is the stated query set: its words are held by the driver, and by
every task in blocks of ``MAX_ITEMS`` items. Weights and basis come from the whole
benchmark and the whole corpus, once; only the search is repeated for each block.

Edge cases: null and empty texts match nothing; items without a word are left
out, with none left the result is empty; items that consist of frequent words only
keep a small weight; repeated rows and items are reported once per pair of ids (a
null id like any other); documents shorter than a window are padded; very long
texts go in parts that overlap by the longest item and more, and places count
from the text's start; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import one_blas_thread, stage
from tidemark.llm.jaccard import Hasher

TERMS = 1 << 16
STRIDE = 8
SHORT = 4
LENGTHS = (8, 16, 24, 40, 56, 72)
MAX_ITEMS = 2_000
PASSAGE = 64
PART = 1 << 15  # words, a multiple of STRIDE
MATCH = "doc_id long, item_id long, cosine double, lcs double, start_word long"
#: Punctuation never separates a copy from its source: it counts as white space.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*range(33), *b".,;:!?\"()[]{}|#$%&*<>"]] = True


def tokens(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, w, x): each text's words in order, as terms (the upper 16 bits of their hashes) and the next 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(space=BREAKS)
        for batch in batches:
            h = [hasher.word_hashes(t.as_py()) for t in batch.column(1)]
            w, x = ([(v >> np.uint64(bits)).astype(kind).tobytes() for v in h] for bits, kind in ((48, "<u2"), (16, "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.binary()), pa.array(x, pa.binary())], ["id", "w", "x"])

    return texts.select(F.col(id_col).alias("id"), "text").mapInArrow(run, "id long, w binary, x binary")


def exact(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Terms and their further bits as one number a word."""
    return w << 32 | x


def _words(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype="<u2").astype(np.int64)


def document_frequencies(toks: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1, dtype=np.int64), 0
        for batch in batches:
            for v in batch.column(0):
                df[np.unique(_words(v))] += 1
                n += 1
        df[TERMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(df[at])], ["term", "n"])

    out = np.zeros(TERMS + 1, dtype=np.int64)
    for r in toks.select("w").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most TERMS + 1 rows
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def term_weights(df: np.ndarray, n: int, items: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Inverse document frequency, at most 6. Frequent terms weigh nothing, unless they
    are rare within the benchmark: then a widespread leak makes them frequent."""
    idf = np.minimum(np.log((n + 1.0) / (df + 1.0)), 6.0)
    inside = np.zeros(TERMS, dtype=np.int64)
    for _, w in items:
        inside[np.unique(w)] += 1
    frequent = df > max(2, 0.01 * n, 4 * df.mean())
    rare = (inside > 0) & (inside <= max(2, 0.02 * len(items)))
    weights = np.where(frequent, np.where(rare, np.maximum(idf, 4.0), 0.0), idf)
    for _, w in items:  # an item of frequent words only must not vanish
        if not weights[w].any():
            weights[w] = np.maximum(idf[w], 1.0)
    return weights.astype(np.float32)


def latent_basis(toks: DataFrame, idf: np.ndarray, rank: int, residual: int, oversample: int = 8, seed: int = 11) -> np.ndarray:
    """TERMS x (rank + residual): leading right singular vectors of the TF-IDF passages of
    all documents, and a random projection of what is orthogonal to them."""
    k = rank + oversample
    weighted = np.random.default_rng(seed).standard_normal((TERMS, k)).astype(np.float32) * idf[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        c, g = np.zeros((TERMS, k), np.float32), np.zeros((k, k))

        def add(words: list[np.ndarray]) -> None:
            nonlocal g
            passage = np.concatenate([np.arange(len(w)) // PASSAGE + base for w, base in zip(words, np.cumsum([0] + [len(w) // PASSAGE + 1 for w in words]))])
            term = np.concatenate(words)
            live = idf[term] > 0
            term, passage = term[live], passage[live]
            if not len(term):
                return
            starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
            y = np.add.reduceat(weighted[term], starts, axis=0)
            g += y.T.astype(float) @ y
            row = np.repeat(np.arange(len(starts)), np.diff([*starts, len(term)]))
            order = np.argsort(term, kind="stable")
            term = term[order]
            heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            c[term[heads]] += np.add.reduceat(y[row[order]], heads, axis=0)

        words, size = [], 0
        for batch in batches:
            for v in batch.column(0):
                words.append(_words(v))
                size += len(words[-1])
                if size > 1 << 17:
                    add(words)
                    words, size = [], 0
        if size:
            add(words)
        at = np.flatnonzero(np.abs(c).sum(1))
        ids = np.concatenate((at, TERMS + np.arange(k)))
        rows = np.concatenate((c[at] * idf[at, None], g)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype("int32")), pa.array([r.tobytes() for r in rows], pa.binary())], ["at", "v"])

    def add_up(key: tuple, rows: pa.Table) -> pa.Table:
        at = rows["at"].to_numpy()
        v = np.frombuffer(b"".join(rows["v"].to_pylist()), dtype=np.float32).reshape(len(at), k)
        ids, where = np.unique(at, return_inverse=True)
        total = np.zeros((len(ids), k))
        np.add.at(total, where, v)
        return pa.table([pa.array(ids), pa.array([r.tobytes() for r in total], pa.binary())], names=["at", "v"])

    full = np.zeros((TERMS + k, k))
    parts = toks.select("w").mapInArrow(run, "at int, v binary").groupBy(F.expr("at div 512")).applyInArrow(add_up, "at int, v binary")
    for r in parts.collect():  # at most TERMS + k rows of k numbers
        full[r["at"]] = np.frombuffer(r["v"])
    c, g = full[:TERMS], full[TERMS:]
    # Y = QR with R'R = Y'Y, and B = Q'A = R'^-1 Y'A has A's leading right singular vectors.
    g = g + np.eye(k) * (1e-6 * np.trace(g) / k + 1e-12)
    one_blas_thread()
    b = np.linalg.solve(np.linalg.cholesky(g), np.eye(k)) @ c.T
    values, u = np.linalg.eigh(b @ b.T)  # of size k: the squares of the singular values
    order = np.argsort(-values)[:rank]
    v = b.T @ u[:, order] / np.sqrt(np.maximum(values[order], 1e-12))
    rest = np.random.default_rng(seed + 1).standard_normal((TERMS, residual)) / np.sqrt(residual)
    return np.concatenate((v, rest - v @ (v.T @ rest)), axis=1).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


Item = tuple[int | None, np.ndarray, np.ndarray]  # id, terms, words


class Queries:
    """The benchmark's passages by window length: unit latent vectors and their terms as bit rows; short items word by word."""

    def __init__(self, items: list[Item], embed: np.ndarray):
        self.items = items
        parts: dict[int, list] = {n: [] for n in LENGTHS}
        most = LENGTHS[-1] - STRIDE + 1
        self.short: dict[int, dict[tuple, list[int]]] = {}
        for i, (_, w, words) in enumerate(items):
            if len(w) <= SHORT:
                self.short.setdefault(len(w), {}).setdefault(tuple(words.tolist()), []).append(i)
                continue
            for at in range(0, len(w), most):
                part = w[at : at + most]
                if not at or len(part) >= most // 2:
                    parts[next(x for x in LENGTHS if len(part) + STRIDE - 1 <= x)].append((i, at, part))
        self.by_length = {}
        for n, found in parts.items():
            if found:
                v = np.array([embed[p].sum(0) for _, _, p in found])
                v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                member = np.zeros((len(found), TERMS >> 3), dtype=np.uint8)
                for row, (_, _, p) in zip(member, found):
                    np.bitwise_or.at(row, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
                self.by_length[n] = (v.T.astype(np.float32), [f[:2] for f in found], member, np.array([len(p) for _, _, p in found]))
        self.starts = {n: np.unique([words[0] for words in known]) for n, known in self.short.items()}

    def verbatim(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place) of every short item that stands in a text, at its first place."""
        for n, known in self.short.items():
            left = dict(known)
            for at in np.flatnonzero(np.isin(words[: len(words) - n + 1], self.starts[n])).tolist():
                for i in left.pop(tuple(words[at : at + n].tolist()), ()):
                    yield i, at
                if not left:
                    break


def confirm(w: np.ndarray, item: np.ndarray, at: int, min_lcs: float, min_paraphrase: float, answer: int) -> tuple[float, bool]:
    """LCS share of ``item`` around word ``at`` of ``w`` and whether that is a leak."""
    room = STRIDE + len(item) // 3  # for inserted words
    near = w[max(at - room, 0) : max(at, 0) + len(item) + STRIDE + room]
    share = common_subsequence(item, near) / len(item)
    if share >= min_lcs:
        return share, True
    tail = item[-answer:]
    return share, share >= min_paraphrase and common_subsequence(tail, near) >= 0.75 * len(tail)


def place(w: np.ndarray, item: np.ndarray, at: int) -> int:
    """Where near ``at`` most words of ``item`` stand at their own places."""
    room = STRIDE + len(item) // 3
    tries = np.arange(max(at - room, 0), max(at, 0) + STRIDE + room)
    head = item[: 4 * STRIDE]
    padded = np.concatenate((w, np.full(len(head), -1)))
    tries = tries[tries < len(w)]
    return int(tries[(padded[tries[:, None] + np.arange(len(head))] == head).sum(1).argmax()]) if len(tries) else max(at, 0)


def search(toks: DataFrame, items: list[Item], embed: np.ndarray, min_cosine: float, min_lcs: float, min_paraphrase: float, answer: int = 8) -> DataFrame:
    queries = Queries(items, embed)
    tail = LENGTHS[-1] // STRIDE - 1  # empty blocks after each text, so that no window reaches the next

    overlap = -(-2 * max(len(w) for _, w, _ in items) // STRIDE) * STRIDE + 2 * LENGTHS[-1]

    def matches(docs: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[tuple]:
        counts = np.array([-(-len(w) // STRIDE) + tail for _, _, w, _ in docs])
        first = np.concatenate(([0], np.cumsum(counts)))
        flat = np.full(first[-1] * STRIDE, -1)
        for (_, _, w, _), b in zip(docs, first):
            flat[b * STRIDE : b * STRIDE + len(w)] = w
        e = embed[flat]
        e[flat < 0] = 0
        blocks = e.reshape(-1, STRIDE, e.shape[1]).sum(1)
        found: dict[tuple[int, int], tuple] = {}
        for d, (_, base, _, words) in enumerate(docs):
            for item, at in queries.verbatim(words):
                found[d, item] = (1.0, 1.0, base + at)
        for n, (q, owners, member, size) in queries.by_length.items():
            m = n // STRIDE
            x = blocks[: len(blocks) - m + 1].copy()
            for s in range(1, m):
                x += blocks[s : len(blocks) - m + 1 + s]
            dot = x @ q
            i, j = np.nonzero(dot >= min_cosine * np.maximum(np.sqrt((x * x).sum(1)), 1e-6)[:, None])
            if not len(i):
                continue
            near = flat[i[:, None] * STRIDE + np.arange(n)]
            there = (member[j[:, None], near >> 3] >> (near & 7) & 1) * (near >= 0)
            ok = there.sum(1) >= min_paraphrase * size[j]
            for b, p, c in zip(i[ok].tolist(), j[ok].tolist(), dot[i[ok], j[ok]] / np.sqrt((x[i[ok]] ** 2).sum(1))):
                d = int(np.searchsorted(first, b, side="right")) - 1
                item, shift = owners[p]
                start = (b - int(first[d])) * STRIDE - shift
                if (d, item) in found and found[d, item][1] >= 1.0:
                    continue
                share, leak = confirm(docs[d][3], items[item][2], start, min_lcs, min_paraphrase, answer)
                if leak and ((d, item) not in found or share > found[d, item][1]):
                    found[d, item] = (float(c), share, docs[d][1] + place(docs[d][3], items[item][2], start))
        return [(docs[d][0], items[i][0], *x) for (d, i), x in sorted(found.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if rows := matches(held):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], [c.split()[0] for c in MATCH.split(", ")])

        for batch in batches:
            for doc_id, v, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                w = _words(v)
                words = exact(w, np.frombuffer(x.as_buffer(), dtype="<u4").astype(np.int64))
                for at in range(0, len(w), PART):  # very long texts go in overlapping parts
                    part = w[at : at + PART + overlap]
                    held.append((doc_id, at, part, words[at : at + PART + overlap]))
                    size += len(part)
                    if size > PART:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    return _best(toks.mapInArrow(run, MATCH))


def _best(matches: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("cosine", "lcs", "start_word"), F.struct("lcs", "cosine", -F.col("start_word")))
    return matches.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.cosine", "m.lcs", "m.start_word")


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 24, residual: int = 48, min_cosine: float = 0.4, min_lcs: float = 0.8, min_paraphrase: float = 0.6) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, start_word) of every document that holds a benchmark item."""
    spark = docs.sparkSession
    whole = lambda v, kind: np.frombuffer(v, dtype=kind).astype(np.int64)
    items = [(r["id"], whole(r["w"], "<u2"), exact(whole(r["w"], "<u2"), whole(r["x"], "<u4"))) for r in tokens(benchmark, "item_id").distinct().collect()]
    items = [x for x in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1].tobytes(), x[2].tobytes())) if len(x[1])]
    if not items:
        return spark.createDataFrame([], MATCH)
    toks = stage(tokens(docs), "words", 1000)
    idf = term_weights(*document_frequencies(toks), [x[:2] for x in items])
    embed = latent_basis(toks, idf, rank, residual) * idf[:, None]
    blocks = [search(toks, items[i : i + MAX_ITEMS], embed, min_cosine, min_lcs, min_paraphrase) for i in range(0, len(items), MAX_ITEMS)]
    if len(blocks) == 1:
        return blocks[0]
    found = stage(reduce(DataFrame.unionByName, blocks), "matches")
    return _best(found)  # several items may share an id
