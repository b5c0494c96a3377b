"""Secret scans: base patterns plus a pair of character Markov models.

Two first-order character chains are trained from labelled samples: strings that
the base patterns found (random) and the other identifier-like words, but for those
that could be keys (ordinary).
Counts are taken over all documents as fixed-size matrices. A word is reported
when its log-likelihood ratio per character exceeds a threshold and it looks
like a key (length, digits and letters mixed).

Edge cases: null text counts as empty and gives no spans; repeated rows are
scanned separately; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns and the kinds' order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones just fail
KINDS = ("assign", "access", "hex", "markov")
HINT = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", re.I | re.A)

WORD = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEARN = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.zeros(128, dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    CODE[ord(_c)] = _i + 1
SIZE = len(ALPHABET) + 1  # 0: start of a string


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in reporting order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if HINT.search(text) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def transitions(word: str) -> tuple[np.ndarray, np.ndarray]:
    to = CODE[np.frombuffer(word.encode("ascii"), dtype=np.uint8)]
    return np.concatenate(([0], to[:-1])), to


def candidate(word: str) -> bool:
    """Long, with letters and digits: could be a key. Without a label such words teach neither class."""
    return len(word) >= 16 and any(c.isdigit() for c in word) and any(c.isalpha() for c in word)


def count_transitions(docs: DataFrame) -> DataFrame:
    """Transition counts of both classes over all documents: at most 2 * 68 * 68 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE * SIZE), dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                taken = [(a, b) for a, _, b in base_spans(text)]
                words: tuple[list, list] = ([], [])
                for m in LEARN.finditer(text):
                    secret = len(m[0]) >= 16 and any(a <= m.start() < b for a, b in taken)
                    if secret or not candidate(m[0]):
                        words[secret].append(m[0])
                for label in (0, 1):
                    if words[label]:
                        # NUL stands between words: code 0, the start state.
                        to = CODE[np.frombuffer(("\0" + "\0".join(words[label])).encode("ascii"), dtype=np.uint8)]
                        pair = to[:-1] * SIZE + to[1:]
                        counts[label] += np.bincount(pair[to[1:] > 0], minlength=SIZE * SIZE)
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype("int32")), pa.array(pair.astype("int32")), pa.array(counts[label, pair])], ["label", "pair", "n"])

    return docs.select("text").mapInArrow(run, "label int, pair int, n long").groupBy("label", "pair").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")


def ratio_matrix(counts: np.ndarray, smooth: float = 1.0, even: float = 0.3) -> np.ndarray:
    """log P(random) - log P(ordinary) of every transition, from a (2, SIZE, SIZE) count array.

    The random chain is mixed with an even one: known secrets use few alphabets, others may use any.
    """
    c = counts + smooth
    c[:, :, 0] = 0.0
    p = c / c.sum(axis=2, keepdims=True)
    p[1, :, 1:] = (1 - even) * p[1, :, 1:] + even / (SIZE - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.log(p[1]) - np.log(p[0]), nan=0.0, posinf=0.0, neginf=0.0)


def train(docs: DataFrame) -> np.ndarray:
    """The ratio matrix learnt from all documents. With no positive sample the random chain is uniform."""
    counts = np.zeros((2, SIZE, SIZE))
    for r in count_transitions(docs).collect():
        counts[r["label"], r["pair"] // SIZE, r["pair"] % SIZE] = r["n"]
    return ratio_matrix(counts)


def markov_spans(text: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    found = []
    for m in WORD.finditer(text):
        word = m[0]
        if candidate(word):
            a, b = transitions(word)
            if ratio[a, b].mean() >= threshold:
                found.append((m.start(), 3, m.end()))
    return found


def outside(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those spans that no base span covers wholly."""
    starts, reach = [], []  # of the base spans, and the furthest end so far
    for a, _, b in sorted(base):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    return [s for s in spans if not (n := bisect_right(starts, s[0])) or reach[n - 1] < s[2]]


def scan(docs: DataFrame, ratio: np.ndarray, threshold: float = 0.5, redact: bool = False) -> DataFrame:
    """Spans of every document; with ``redact`` the documents again, each span replaced by a mark."""
    if redact:
        return _redacted(docs, ratio, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + outside(markov_spans(text, ratio, threshold), base))
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, ratio: np.ndarray, threshold: float, mark: str = "[SECRET]") -> str:
    """``text`` with every span (overlapping ones merged) replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in sorted(base_spans(text) + markov_spans(text, ratio, threshold)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:] if at else text


def _redacted(docs: DataFrame, ratio: np.ndarray, threshold: float) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = names.index("text")
            texts = [None if t is None else redacted(t, ratio, threshold) for t in batch.column(i).to_pylist()]
            cols = list(batch.columns)
            cols[i] = pa.array(texts, pa.string())
            if "n_chars" in names:
                j = names.index("n_chars")
                cols[j] = pa.array([o if t is None else len(t) for t, o in zip(texts, batch.column(j).to_pylist())], batch.column(j).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def secrets(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Train on all documents, then scan them all."""
    return scan(docs, train(docs), threshold)
