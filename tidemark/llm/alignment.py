"""Cross-tokenizer alignment by external spill counting.

A text is tokenised by a byte-level BPE (side A) and a sentence-piece model (side B)
over the same bytes. Byte offsets where tokens of both end cut them into groups; an
A and a B token are linked where their byte ranges overlap. How many documents hold
an id pair linked is counted over the corpus, and each document gets what its links
add up to.

1. Tasks cut their documents into runs of bounded size. A run's pair-document
   records are sorted and radix-partitioned by the A id; each partition is one zstd
   block of sorted pairs with their documents counted, so a pair that every document
   holds is one entry a run and no id is hot.
2. Blocks of a partition meet in one task, where a heap merges them k ways, bounded
   in fan-in and chunk by chunk. Pairs come A-major, so an A id's highest count is
   known when its last pair has passed.
3. Counts stream back to each block, blocks to their runs, and a run adds up the
   contributions of each of its documents.

Blocks go through Spark's shuffle and written tables only; no task holds more than
a run, or the distinct pairs of one radix partition.

Edge cases: a text that is null, empty, or that a side does not give back byte by
byte (side B writes spaces as U+2581, so a text with that character is not) has no
tokens: zeros and an empty digest. Strings of special tokens are plain text. Repeated
rows count once each; rows that share a doc_id, or have none, are documents of their
own. A text of any length is one document, and a run holds at least one. An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

SHIFT = 15  # bits of a B id within a pair
RUN_BYTES = 4 << 20
RADICES = 256
FAN_IN = 64
CHUNK = 1 << 16
RECORD = SHIFT + 16 + 12  # bits of a radix and a pair

BLOCKS = "run long, radix int, docs binary, a binary, b binary"
EMPTY_DIGEST = ""


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype=kind)


def radix_of(a: np.ndarray, radices: int) -> np.ndarray:
    """Radix partition of A ids: the high bits of a product, so that neighbours spread."""
    return ((a.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64) * radices >> 16


class Tokenizers:
    """Both sides: ids of texts, and the bytes of every id."""

    def __init__(self, ranks_path: str | None = None, model_path: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.a = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.a_len = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.a_len[i] = len(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        if len(pieces) > 1 << SHIFT:
            raise ValueError("side B has more ids than a pair has room for")


    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(A ids, B ids, bytes) of a text, None if a side does not give its bytes back."""
        whole = (" " + text).encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        a = np.array(self.a.encode_ordinary(" " + text), dtype=np.int64)
        return (a, np.array(b, dtype=np.int64), len(whole)) if self.a_len[a].sum() == len(whole) else None


def _numbers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1 in five bytes (0 where there is none) with room for what follows, and how many bytes are used."""
    i = np.arange(n)
    digits = np.zeros((n, 6), np.uint8)
    for k in range(5):
        at = 10 ** (4 - k)
        digits[:, k] = np.where((i >= at) | (at == 1), 48 + i // at % 10, 0)
    return digits, (digits != 0).sum(1) + 1


_NUMBERS, _WIDTHS = _numbers(1 << 16)


class Aligned:
    """The alignment of several texts laid end to end; texts end at shared offsets, so nothing crosses them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray, ends: np.ndarray):
        size = int(ends[-1]) if len(ends) else 0
        mark = np.zeros(size + 1, np.uint8)
        mark[np.cumsum(a_len[a])] |= 1
        mark[np.cumsum(b_len[b])] |= 2
        mark[0] = 0
        cuts = np.flatnonzero(mark)
        on_a, on_b = mark[cuts] & 1, mark[cuts] >> 1
        # Between two cuts lies one A and one B token: each such stretch is one link.
        self.a_at, self.b_at = np.cumsum(on_a, dtype=np.int64) - on_a, np.cumsum(on_b, dtype=np.int64) - on_b
        shared = mark[cuts] == 3
        self.group_ends = np.flatnonzero(shared)
        self.links = np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)  # of each text
        self.groups = np.diff(np.searchsorted(cuts[shared], ends, "right"), prepend=0)
        self.a, self.b = a, b
        self.pairs = (a[self.a_at] << SHIFT) | b[self.b_at]

    def digests(self, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """SHA-256 of every text's groups written as ``a1,a2|b1;a3|b2,b3``."""
        a_end, b_end = self.a_at[self.group_ends], self.b_at[self.group_ends]  # last token of each group
        a_group = np.repeat(np.arange(len(a_end)), np.diff(a_end, prepend=-1))
        b_group = np.repeat(np.arange(len(b_end)), np.diff(b_end, prepend=-1))
        b_before = np.concatenate([[0], b_end + 1])[:-1] if len(b_end) else b_end
        at_a, at_b = np.arange(len(self.a)) + b_before[a_group], np.arange(len(self.b)) + a_end[b_group] + 1
        ids, sep = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), 44, np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sep[at_a[a_end]], sep[at_b[b_end]] = 124, 59
        chars = _NUMBERS[ids]
        chars[:, 5] = sep
        ends = np.cumsum(_WIDTHS[ids])[np.cumsum(n_a + n_b) - 1]
        flat = chars.ravel()
        flat = flat[flat != 0].tobytes()
        return [hashlib.sha256(flat[s : e - 1]).hexdigest() for s, e in zip([0, *ends[:-1]], ends)]  # without the last ;


def _run(number: int, docs: list[tuple], tok: Tokenizers, radices: int) -> list[tuple]:
    """A run's rows: one block of counted pairs for each radix, and under radix -1 its documents and their records."""
    live = [d for d in docs if d[1] is not None]
    n_a, n_b = (np.array([len(d[1][k]) for d in live], dtype=np.int64) for k in (0, 1))
    cols = [np.zeros(len(docs), np.int64) for _ in range(4)]
    digests = [EMPTY_DIGEST] * len(docs)
    rows, doc_of, local, times = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if live:
        at = np.array([i for i, d in enumerate(docs) if d[1] is not None])
        al = Aligned(np.concatenate([d[1][0] for d in live]), np.concatenate([d[1][1] for d in live]), tok.a_len, tok.b_len, np.cumsum([d[1][2] for d in live]))
        for col, values in zip(cols, (n_a, n_b, al.groups, al.links)):
            col[at] = values
        for i, digest in zip(at, al.digests(n_a, n_b)):
            digests[i] = digest
        bits = SHIFT + 16
        key = (radix_of(al.a, radices)[al.a_at] << bits) | al.pairs  # by radix, then by pair
        record = np.sort((np.repeat(np.arange(len(live)), al.links) << RECORD) | key)
        first = np.flatnonzero(np.diff(record, prepend=-1))
        times = np.diff(first, append=len(record))
        record = record[first]
        doc_of = at[record >> RECORD]
        codes, found = pd.factorize(record & ((1 << RECORD) - 1))
        order = np.argsort(found)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        local, n_docs = rank[codes], np.bincount(codes)[order]
        keys, radix = found[order] & ((1 << bits) - 1), found[order] >> bits
        edges = np.flatnonzero(np.diff(radix, prepend=-1, append=radices))
        for s, e in zip(edges, edges[1:]):
            rows.append((number, int(radix[s]), None, packed(np.diff(keys[s:e], prepend=0).astype("<u4")), packed(n_docs[s:e].astype("<u4"))))
    each = np.bincount(doc_of, minlength=len(docs)).astype("<u4")
    table = pa.table({
        "doc_id": pa.array([d[0] for d in docs], pa.int64()), "n_a": cols[0], "n_b": cols[1], "n_groups": cols[2], "n_links": cols[3],
        "groups_sha256": pa.array(digests, pa.string()), "records": each.astype(np.int64),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    steps = np.diff(local, prepend=0).astype("<i4")
    rows.append((number, -1, zstandard.compress(sink.getvalue().to_pybytes(), 1), packed(steps), packed(times.astype("<u4"))))
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["run", "radix", "docs", "a", "b"])


def runs(docs: DataFrame, radices: int = RADICES, run_bytes: int = RUN_BYTES, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """Runs of ``docs`` as blocks (see ``_run``); the paths must be readable on every executor."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, number, held, size = Tokenizers(ranks_path, model_path), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                got = tok.encode(text) if text else None
                held.append((doc_id, got))
                size += 64 + (got[2] if got else 0)
                if size >= run_bytes or len(held) >= 1 << 63 - RECORD - 1:
                    yield _batch(_run(number, held, tok, radices))
                    number, held, size = number + 1, [], 0
        if held:
            yield _batch(_run(number, held, tok, radices))

    return docs.select("doc_id", "text").mapInArrow(make, BLOCKS)


def merged(sources: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of sorted (keys, counts) chunks: each key once, its counts added up, in chunks.

    The heap is ordered by the last key that each source holds: up to the least of
    these all sources are known, so that much is merged at once.
    """
    heap: list = []
    for i, source in enumerate(sources):
        if head := next(source, None):
            heap.append((int(head[0][-1]), i, head))
    heapq.heapify(heap)
    while heap:
        limit, keep, part = heap[0][0], [], []
        while heap:
            last, i, (keys, counts) = heapq.heappop(heap)
            n = len(keys) if last <= limit else int(np.searchsorted(keys, limit, "right"))
            if n:
                part.append((keys[:n], counts[:n]))
            rest = (keys[n:], counts[n:]) if n < len(keys) else next(sources[i], None)
            if rest:
                keep.append((int(rest[0][-1]), i, rest))
        heap = keep
        heapq.heapify(heap)
        keys = np.concatenate([p[0] for p in part])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([p[1] for p in part])[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[first], np.add.reduceat(counts, first)


def _chunks(row: tuple[bytes, bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keys, counts = np.cumsum(unpacked(row[0], "<u4"), dtype=np.int64), unpacked(row[1], "<u8" if len(row) > 2 else "<u4").astype(np.int64)
    for s in range(0, len(keys), CHUNK):
        yield keys[s : s + CHUNK], counts[s : s + CHUNK]


def _as_row(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, bytes, bool]:
    got = list(parts)
    keys, counts = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    return packed(np.diff(keys, prepend=0).astype("<u4")), packed(counts.astype("<u8")), True


def counted(blocks: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, keys, counts): every partition's pairs with their documents counted, in pair order."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            keys, counts, _ = _as_row(merged([_chunks(h) for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary())], ["radix", "keys", "counts"])

        for batch in batches:
            for radix, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if radix != at:
                    if held:
                        yield done()
                    at, held = radix, []
                held.append((keys.as_py(), counts.as_py()))
                if len(held) >= fan_in:
                    held = [_as_row(merged([_chunks(h) for h in held]))]
        if held:
            yield done()

    return blocks.where("radix >= 0").select("radix", "a", "b").repartition("radix").sortWithinPartitions("radix").mapInArrow(merge, "radix int, keys binary, counts binary")


def highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their A id, ties included; keys are A-major."""
    first = np.flatnonzero(np.diff(keys >> SHIFT, prepend=-1))
    top = np.maximum.reduceat(counts, first) if len(first) else counts
    return counts == np.repeat(top, np.diff(first, append=len(keys)))


def answered(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Each block's pairs as corpus counts (``a``) and marks of the highest (``b``), in the block's order."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = totals = best = np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for run, radix, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3)):
                if run is None:
                    keys, totals = np.cumsum(unpacked(a.as_py(), "<u4"), dtype=np.int64), unpacked(b.as_py(), "<u8").astype(np.int64)
                    best = highest(keys, totals)
                    continue
                at = np.searchsorted(keys, np.cumsum(unpacked(a.as_py(), "<u4"), dtype=np.int64))
                rows.append((run, radix, None, packed(totals[at].astype("<u8")), packed(best[at])))
            yield _batch(rows)

    both = counts.select(F.lit(None).cast("long").alias("run"), "radix", F.col("keys").alias("a"), F.col("counts").alias("b"))
    both = both.unionByName(blocks.where("radix >= 0").select("run", "radix", "a", "b"))
    return both.repartition("radix").sortWithinPartitions("radix", F.asc_nulls_first("run")).mapInArrow(answer, BLOCKS)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def contributions(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per document: its links, those of the highest count of their A id, and all counts added up."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        for batch in batches:
            for run, radix, docs, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), *(batch.column(i) for i in (2, 3, 4))):
                if radix < 1 << 30:
                    held.append((run, a.as_py(), b.as_py()))
                    continue
                count = np.concatenate([np.zeros(0, np.int64), *(unpacked(h[1], "<u8").astype(np.int64) for h in held)])
                best = np.concatenate([np.zeros(0, bool), *(unpacked(h[2], "?") for h in held)])
                held = []
                table = pa.ipc.open_stream(zstandard.decompress(docs.as_py())).read_all()
                local, times = np.cumsum(unpacked(a.as_py(), "<i4"), dtype=np.int64), unpacked(b.as_py(), "<u4").astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(table["records"].to_numpy())])
                sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * best[local], times * count[local])]
                out = {c: table[c].combine_chunks() for c in names if c in table.column_names} | {c: pa.array(np.diff(s)) for c, s in zip(("n_best", "count_sum"), sums)}
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    own = blocks.where("radix < 0").withColumn("radix", F.lit(1 << 30))  # behind the answers to its run
    return answers.unionByName(own).repartition("run").sortWithinPartitions("run", "radix").mapInArrow(add, RESULT)


def align(docs: DataFrame, radices: int = RADICES, run_bytes: int = RUN_BYTES, fan_in: int = FAN_IN, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """The operator as a whole: one row per document."""
    blocks = stage(runs(docs, radices, run_bytes, ranks_path, model_path), "runs", 1000)
    counts = stage(counted(blocks, fan_in), "pair_counts")
    answers = stage(answered(blocks, counts), "answers", 1000)
    return contributions(blocks, answers)


def pair_counts(docs: DataFrame, radices: int = RADICES) -> DataFrame:
    """(a, b, docs, best): every linked id pair of the corpus, the documents that hold it, and whether no other pair of ``a`` has more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                keys, totals = np.cumsum(unpacked(k.as_py(), "<u4"), dtype=np.int64), unpacked(c.as_py(), "<u8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> SHIFT), pa.array(keys & ((1 << SHIFT) - 1)), pa.array(totals), pa.array(highest(keys, totals))], ["a", "b", "docs", "best"])

    return counted(stage(runs(docs, radices), "runs", 1000)).select("keys", "counts").mapInArrow(rows, "a long, b long, docs long, best boolean")
