"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are hashed byte n-grams (1 to 4 bytes) of its words, marked at
the word edges; its vector is the average of their embeddings; a linear softmax
gives the language. Embeddings and softmax are trained by stochastic gradient
descent in numpy on a bounded sample of labelled documents (``max_train``, taken
in hash order) that is reduced to n-gram histograms on the executors. After
training embedding and softmax collapse into one table of logits per bucket.

Confidence is calibrated by a temperature fitted on a part of the sample that
SGD did not see; predictions below ``reject`` become ``und`` (0: only texts
without a letter are rejected).

Edge cases: null texts and texts without a letter are ``und`` with score 0;
rows with a null language are not learnt from; with no labelled row everything
is ``und``; rows that share a doc_id are judged each, and one of them is learnt from; a
text of any length is read whole, in pieces; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 18  # bytes of a text that are looked at at once
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def buckets(text: str) -> np.ndarray:
    """Hash buckets of all subwords of the whole text, in text order by n-gram order."""
    b = _LOWER[np.frombuffer((" " + text + " ").encode("utf-8", "replace"), dtype=np.uint8)]
    return _hashed(b, len(b))


def _hashed(b: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the subwords of ``b`` that begin at its first ``starts`` bytes."""
    b = b.astype(np.uint32)
    out, h = [], np.zeros(len(b), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(16777619) + b[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            out.append(((h[:starts] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64))
    return np.concatenate(out)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of all subwords of a whole text; long texts go in pieces."""
    if len(text) <= PIECE:
        return np.unique(buckets(text), return_counts=True)
    total = np.zeros(BUCKETS, dtype=np.int64)
    b = _LOWER[np.frombuffer((" " + text + " ").encode("utf-8", "replace"), dtype=np.uint8)]
    for at in range(0, len(b), PIECE):
        total += np.bincount(_hashed(b[at : at + PIECE + max(ORDERS) - 1], min(PIECE, len(b) - at)), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text[64:]))


def histograms(docs: DataFrame, keep: Column, max_train: int) -> DataFrame:
    """Histograms of at most ``max_train`` labelled documents, chosen in hash order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids, n = counts(text.as_py())
                rows.append((doc_id, lang, ids.astype("int32").tobytes(), (n / n.sum()).astype("float32").tobytes()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["doc_id", "lang", "ids", "w"])

    usable = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = usable.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(run, "doc_id long, lang string, ids binary, w binary")
    return rows.groupBy("doc_id").agg(F.min(F.struct("lang", "ids", "w")).alias("r")).select("r.*")  # one of each id


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.table, self.bias, self.temperature = langs, table, bias, temperature

    def predict(self, text: str | None, reject: float = 0.0) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        if len(text) <= PIECE:
            mean = self.table[buckets(text)].mean(0)
        else:
            ids, n = counts(text)
            mean = n @ self.table[ids] / n.sum()
        logits = (mean + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        at = int(p.argmax())
        return (self.langs[at] if p[at] >= reject else UNKNOWN), float(p[at])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 12, rate: float = 2.0, seed: int = 7) -> Model:
    """SGD over (language, bucket ids, weights); one sample in ten calibrates the temperature."""
    langs = sorted({s[0] for s in samples})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, dim)) / dim).astype(np.float32)
    out, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    y = np.array([langs.index(s[0]) for s in samples])
    order = rng.permutation(len(samples))
    held = order[: len(order) // 10]
    learn = order[len(order) // 10 :]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            _, ids, w = samples[i]
            rows = emb[ids]
            mean = w @ rows
            g = _softmax(mean @ out + bias)
            g[y[i]] -= 1
            back = out @ g
            out -= step * np.outer(mean, g)
            bias -= 0.1 * step * g
            emb[ids] = rows - 10 * step * np.outer(w, back)
    table = emb @ out
    best = (np.inf, 1.0)
    logits = np.array([w @ table[ids] + bias for _, ids, w in (samples[i] for i in held)])
    for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0) if len(held) else ():
        loss = -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        best = min(best, (loss, t))
    return Model(langs, table.astype(np.float32), bias, best[1])


def train(docs: DataFrame, keep: Column, max_train: int = 1500) -> Model:
    rows = histograms(docs, keep, max_train).collect()  # at most max_train histograms of BUCKETS entries
    rows.sort(key=lambda r: (r["lang"], bytes(r["ids"]), bytes(r["w"])))
    return fit([(r["lang"], np.frombuffer(r["ids"], dtype=np.int32), np.frombuffer(r["w"], dtype=np.float32)) for r in rows])


def identify(docs: DataFrame, model: Model, reject: float = 0.0) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py(), reject) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
