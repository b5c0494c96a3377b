"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has its own mean and covariance of the transformed statistics; the
covariance is shrunk towards the pooled one and towards a multiple of the unit
matrix. Scores come from the difference of the classes' Gaussian log-densities,
computed with Cholesky factors that are made once per class.

Training needs only sums and outer products, so it runs as one aggregation whose
result has a fixed size; nothing of the corpus reaches the driver.

Edge cases: null and empty texts have defined statistics (all counts zero) and
get a score like any other, however long; rows with a null label or without a
doc_id are not learnt from; a label that is given twice counts once, contrary
labels of one document count each; repeated documents are scored each; with one
class missing all scores are 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import one_blas_thread, settled, stage

FEATURES = (
    "log_bytes", "log_words", "word_len", "letters", "upper", "digits", "punct", "symbols", "pipes", "bangs",
    "spaces", "log_lines", "line_len", "distinct_words", "top_word", "repeated_lines", "squeeze", "short_words", "sentences",
)
SCHEMA = "doc_id long, f array<double>"
_BYTE = np.zeros(256, dtype=np.int64)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()-?", b"#$%&*@^~<>=+_{}[]\\/", b"|", b"!", b" \t\r\n\f\v"), 1):
    for _b in _set:
        _BYTE[_b] = _k
_BYTE[128:] = 2  # letters beyond ASCII


def _share(a: float, b: float) -> float:
    """A proportion on the logit scale, smoothed."""
    p = (a + 0.5) / (b + 1.0)
    return float(np.log(p / (1.0 - p))) if p < 1 else float(np.log((a + 0.5) / 0.5))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    kinds = np.bincount(_BYTE[np.frombuffer(raw, dtype=np.uint8)], minlength=9) if n else np.zeros(9)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    counts = Counter(words)
    nw, nl = len(words), len(lines)
    letters = kinds[1] + kinds[2]
    return [
        np.log1p(n), np.log1p(nw), np.log1p(n / max(nw, 1)), _share(letters, n), _share(kinds[1], letters), _share(kinds[3], n),
        _share(kinds[4], n), _share(kinds[5], n), _share(kinds[6], n), _share(kinds[7], n), _share(kinds[8], n), np.log1p(nl),
        np.log1p(n / max(nl, 1)), _share(len(counts), nw), _share(max(counts.values(), default=0), nw), _share(nl - len(set(lines)), nl),
        np.log((len(zlib.compress(raw, 1)) + 8) / (n + 16)), _share(sum(len(w) <= 3 for w in words), nw), _share(len(re.findall(rb"[.?]\s", raw)), nw),
    ]


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _inverse_of_triangle(lower: np.ndarray) -> np.ndarray:
    """By forward substitution, row by row."""
    out = np.zeros_like(lower)
    for i in range(len(lower)):
        out[i, i] = 1.0
        out[i] = (out[i] - lower[i, :i] @ out[:i]) / lower[i, i]
    return out


class Model:
    """Class priors, means and Cholesky factors on standardised statistics."""

    def __init__(self, centre, scale, log_prior, means, factors, temperature):
        self.centre, self.scale, self.log_prior, self.means, self.factors, self.temperature = centre, scale, log_prior, means, factors, temperature
        #: Of each factor, once: its inverse (a triangle too) and its log determinant.
        self.whiten = None if factors is None else [_inverse_of_triangle(f) for f in factors]
        self.log_det = None if factors is None else [float(np.log(np.diag(f)).sum()) for f in factors]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), 0.5)
        z = (x - self.centre) / self.scale
        density = []
        for mean, whiten, log_det, prior in zip(self.means, self.whiten, self.log_det, self.log_prior):
            m = (z - mean) @ whiten.T
            density.append(prior - log_det - 0.5 * (m * m).sum(1))
        return 1.0 / (1.0 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -30, 30)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, ridge: float = 0.05, temperature: float = 4.0) -> Model:
    """A model from each class's count, sum and sum of outer products."""
    d = len(FEATURES)
    if set(moments) != {0, 1}:
        return Model(np.zeros(d), np.ones(d), None, None, None, temperature)
    total = sum(m[0] for m in moments.values())
    centre = sum(m[1] for m in moments.values()) / total
    second = sum(m[2] for m in moments.values()) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(second), 1e-6))
    pooled = second / np.outer(scale, scale)
    means, factors, priors = [], [], []
    for c in (0, 1):
        n, s, ss = moments[c]
        mean = s / n
        cov = (ss / n - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrink) * cov + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.eye(d) * np.trace(cov) / d
        means.append((mean - centre) / scale)
        factors.append(np.linalg.cholesky(cov + 1e-9 * np.eye(d)))
        priors.append(np.log(n / total))
    return Model(centre, scale, priors, means, factors, temperature)


def train(feats: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None) -> Model:
    """Learn from the labelled rows of ``feats`` for which ``learn`` holds."""
    d = len(FEATURES)
    lab = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1)).distinct()
    rows = (feats if learn is None else feats.where(learn)).join(lab, "doc_id").select("y", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        sums = {0: [0.0, np.zeros(d), np.zeros((d, d))], 1: [0.0, np.zeros(d), np.zeros((d, d))]}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(len(y), d)
            for c, s in sums.items():
                part = x[y == c]
                s[0] += len(part)
                s[1] += part.sum(0)
                s[2] += part.T @ part
        flat = [(c, i, v) for c, s in sums.items() if s[0] for i, v in enumerate(np.concatenate(([s[0]], s[1], s[2].ravel())))]
        cols = list(zip(*flat)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64()))], ["y", "i", "v"])

    moments: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        moments.setdefault(r["y"], np.zeros(1 + d + d * d))[r["i"]] = r["v"]
    return fit({c: (m[0], m[1 : 1 + d], m[1 + d :].reshape(d, d)) for c, m in moments.items()})


def score(feats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return feats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, score) of every document."""
    feats = stage(features(docs), "quality", 1000)
    return score(feats, train(feats, labels, learn=learn))


def keep(docs: DataFrame, labels: DataFrame, learn: Column | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more: nothing is shuffled but the labels' join."""
    model = train(settled(lambda: features(docs), "quality", 1000), labels, learn=learn)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(where)], dtype=float).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= least))

    return docs.mapInArrow(run, docs.schema)
