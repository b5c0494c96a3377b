"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Only the first ``width`` bytes of a suffix matter, and groups that are equal at
that depth are exactly the repeated windows. The digits are compared from a point
that equal windows share: the window's ``digit`` bytes of smallest hash, its
anchor. Neighbouring windows mostly have one anchor, so a text of n bytes has
about 2n / (width - digit) of them and they stand for all of its windows. Passes,
most significant digit first, and a group that has become a singleton leaves at once:

1. The anchor's own bytes, through ``KEY`` bits of a fingerprint, which only
   decide who goes on: anchors met once leave, and with them nearly all windows
   of unique text. Chunks ship an anchor that they hold several times once.
2. All bytes of the anchor's windows together, its hull: Spark sorts the hulls
   themselves. Hulls equal here repeat window by window; the earliest goes on.
3. The single windows of different hulls that share an anchor, in digits of eight
   bytes: outward from the anchor, then the anchor's. Groups of more than
   ``GROUP`` hulls are not held by a task: Spark sorts their windows as it did hulls.

So every removed byte lies in a window whose bytes were compared; fingerprints
only bring candidates together.

Edge cases: null texts are empty and keep the hash of nothing; texts shorter
than ``width`` are kept whole; a text is cut into overlapping segments of
``SEGMENT`` bytes, so its length is not limited; rows with the same doc_id and text
are one document, given several times; different texts of one doc_id are documents of
their own, in the order of their SHA-256, and so are texts without a doc_id, which come
before all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, release, stage

SEGMENT = 1 << 19
CHUNK = 1 << 21
BITS = np.uint64(22)  # of a place within a chunk
KEY = np.uint64(40)  # bits of an anchor's fingerprint
GROUP = 1 << 16  # hulls of one anchor that a task compares in its memory
NO_ID = -(2**63)  # stands for a missing doc_id
MANY = 1 << 20  # bit of an extent: the chunk itself holds the anchor again
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse."""

    def __init__(self, base: int, n: int):
        self.up = self._powers(base, n)
        self.down = self._powers(pow(base, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        x = np.full(n, np.uint64(base & (2**64 - 1)))
        x[0] = 1
        return np.multiply.accumulate(x)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Prefix:
    """Fingerprints of any substring of a buffer from running sums."""

    def __init__(self, data: np.ndarray, powers: Powers):
        self.p = powers
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.p.down[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


class Chunk:
    """Segments of several texts side by side: bytes, owners and places."""

    def __init__(self, width: int):
        self.width, self.parts, self.docs, self.offsets, self.size = width, [], [], [], 0

    def add(self, doc_id: int, raw: bytes) -> Iterator[Chunk]:
        """Take in a text; yields itself whenever full (the caller then starts anew with ``clear``)."""
        for at in range(0, max(len(raw) - self.width + 1, 0), SEGMENT):
            part = raw[at : at + SEGMENT + self.width - 1]
            if self.size + len(part) > CHUNK:
                yield self
                self.clear()
            self.parts.append(part)
            self.docs.append(doc_id)
            self.offsets.append(at)
            self.size += len(part)

    def clear(self) -> None:
        self.parts, self.docs, self.offsets, self.size = [], [], [], 0

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """bytes, and for each segment its start in the buffer, its doc_id and what to add for the place in the text."""
        lengths = np.array([len(p) for p in self.parts])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        return np.frombuffer(b"".join(self.parts), dtype=np.uint8), starts, np.array(self.docs, dtype=np.int64), np.array(self.offsets, dtype=np.int64) - starts[:-1]


def anchors(data: np.ndarray, starts: np.ndarray, width: int, digit: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(segment, anchor, first window, last window, key) of each anchor of a chunk."""
    one = Prefix(data, powers)
    at = np.arange(len(data) - digit + 1)
    ranked = (one.of(at, at + digit) >> BITS << BITS) | at.astype(np.uint64)
    low = sliding_min(ranked, width - digit + 1)
    counts = np.diff(starts) - width + 1  # windows of each segment
    segment = np.repeat(np.arange(len(counts)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[:-1][segment]
    anchor = (low[window] & ((np.uint64(1) << BITS) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1]))))
    last = np.concatenate((new[1:] - 1, [len(window) - 1]))
    a = anchor[new]
    return segment[new], a, window[new], window[last], one.of(a, a + digit) >> (np.uint64(64) - KEY)


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the stretches [a, b) of each document (touching ones join)."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    _, rank = np.unique(doc, return_inverse=True)
    lift = rank * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + lift)
    new = np.flatnonzero(np.concatenate(([True], (a + lift)[1:] > reach[:-1])))
    return doc[new], a[new], reach[np.concatenate((new[1:] - 1, [len(doc) - 1]))] - lift[new]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield doc_id, (text.as_py() or "").encode("utf-8", "replace")


def _anchor_rows(docs: DataFrame, width: int, digit: int) -> DataFrame:
    """(key, doc_id, pos, extent) of all anchors. Of those that a chunk holds several times one goes by the
    key, the others by a key of their own; all of them bear the mark ``MANY``."""

    def emit(chunk: Chunk, powers: Powers) -> Iterator[pa.RecordBatch]:
        data, starts, docs_of, shift = chunk.arrays()
        seg, a, lo, hi, key = anchors(data, starts, width, digit, powers)
        doc, pos, extent = docs_of[seg], a + shift[seg], (a - lo) * 256 + (a - hi)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        number = np.cumsum(head) - 1
        extent[order[np.bincount(number)[number] > 1]] += MANY
        rest = order[~head]
        own = key.view(np.int64).copy()
        own[rest] = -1 - (mix(doc[rest].astype(np.uint64) * np.uint64(31) + pos[rest].astype(np.uint64)) >> np.uint64(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(doc), pa.array(pos), pa.array(extent.astype(np.int32))], ["key", "doc_id", "pos", "extent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASES[0], CHUNK + 1)
        chunk = Chunk(width)
        for doc_id, raw in _texts(batches):
            for full in chunk.add(doc_id, raw):
                yield from emit(full, powers)
        if chunk.size:
            yield from emit(chunk, powers)

    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(run, "key long, doc_id long, pos long, extent int")


def _sorted(rows: DataFrame, by: str, *order: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, by).sortWithinPartitions(*(order or (by,)))


def _met_again(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, extent) of the anchors whose key occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, pos, extent in _by_key(batches):
            number = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
            live = (np.bincount(number)[number] > 1) | (extent >= MANY)
            if live.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[live]) for c in (doc, pos, extent % MANY)], ["doc_id", "pos", "extent"])

    return _sorted(rows, "key").mapInArrow(run, "doc_id long, pos long, extent int")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sorted batches again, cut so that no key is split over two of them."""
    held: list[np.ndarray] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # strings as objects
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held and len(held[0]):
        yield held


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id (``NO_ID`` for none) and the text's bytes, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(1)], pa.binary())], ["doc_id", "z"])

    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(run, "doc_id long, z binary")


STRING = "string binary, doc_id long, at long, off long"
DONE = 16  # bytes of a finished stretch's string: its place. No hull is as short.


def _string_rows(strings: list[bytes], doc, at, off) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), *(pa.array(c, pa.int64()) for c in (doc, at, off))], ["string", "doc_id", "at", "off"])


def _firsts(buffer: bytes, a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray, off: np.ndarray, powers: Powers) -> Iterator[pa.RecordBatch]:
    """The strings buffer[a:b] of a task, each at its earliest place; what repeats within the buffer
    is a finished stretch, which bears its end as ``off``. Fingerprints find the repeats, bytes decide."""
    print_ = Prefix(np.frombuffer(buffer, dtype=np.uint8), powers).of(a, b) ^ (b - a).astype(np.uint64)
    order = np.lexsort((at, doc, print_))
    a, b, doc, at, off, print_ = (c[order] for c in (a, b, doc, at, off, print_))
    head = np.concatenate(([True], print_[1:] != print_[:-1]))
    first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    rest = np.flatnonzero(~head)
    same = np.array([buffer[w:x] == buffer[y:z] for w, x, y, z in zip(a[rest].tolist(), b[rest].tolist(), a[first[rest]].tolist(), b[first[rest]].tolist())], dtype=bool)
    known = rest[same]
    keep = np.ones(len(a), dtype=bool)
    keep[known] = False
    yield _string_rows([buffer[x:y] for x, y in zip(a[keep].tolist(), b[keep].tolist())], doc[keep], at[keep], off[keep])
    again = known[(doc[known] != doc[first[known]]) | (at[known] != at[first[known]])]
    if len(again):
        d, x, y = merged(doc[again], at[again], at[again] + (b - a)[again])
        yield _string_rows([r.tobytes() for r in np.stack((d, x), 1)], d, x, y)


def _gathered(pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_firsts`` of what ``pieces`` makes of the batches: (bytes, start and end of strings in them, doc_id, place of the bytes, off)."""
    powers = Powers(BASES[1], 2 * CHUNK + 1)
    held: list[tuple] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        shift = np.cumsum([0] + [len(h[0]) for h in held])
        a, b = (np.concatenate([h[i] + s for h, s in zip(held, shift)]) for i in (1, 2))
        doc = np.repeat(np.array([h[3] for h in held], dtype=np.int64), [len(h[1]) for h in held])
        at, off = np.concatenate([h[1] + h[4] for h in held]), np.concatenate([h[5] for h in held])
        return _firsts(b"".join(h[0] for h in held), a, b, doc, at, off, powers)

    for piece in pieces(batches):
        if held and (size + len(piece[0]) > 2 * CHUNK):
            yield from out()
            held, size = [], 0
        held.append(piece)
        size += len(piece[0])
    if held:
        yield from out()


def _hulls(texts: DataFrame, live: DataFrame, width: int) -> DataFrame:
    """The hulls of the anchors in ``live``, read from the texts."""
    lists = live.groupBy("doc_id").agg(F.collect_list("pos").alias("p"), F.collect_list("extent").alias("e"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, packed, places, extents in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
                raw = z.decompress(packed.as_py())
                pos, e = places.values.to_numpy(), extents.values.to_numpy().astype(np.int64)
                order = np.argsort(pos)
                pos, e = pos[order], e[order]
                off = e // 256
                a, b = pos - off, pos - e % 256 + width
                part = a // SEGMENT  # long texts go in parts
                for n in np.unique(part).tolist():
                    own = part == n
                    base = int(a[own][0])
                    yield raw[base : int(b[own].max())], a[own] - base, b[own] - base, doc_id, base, off[own]

    return texts.join(lists, "doc_id").select("doc_id", "z", "p", "e").mapInArrow(lambda batches: _gathered(pieces, batches), STRING)


def _ordered(strings: DataFrame) -> DataFrame:
    """Sorted by their bytes: who is the earliest of its equals (string kept), and who starts later (``again``, up to ``end``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_doc, last_at = b"", 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column(0).to_pylist()
            doc, at, off = (batch.column(i).to_numpy() for i in (1, 2, 3))
            size = np.array([len(x) for x in s])
            new = np.array([x != y for x, y in zip(s, [last, *s])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            begun = first >= 0  # else the run of equals began in an earlier batch
            first_doc, first_at = np.where(begun, doc[first], last_doc), np.where(begun, at[first], last_at)
            done = size == DONE
            again = done | (doc != first_doc) | (at != first_at)
            keep = ~again & new
            live = again | keep  # a place that is given twice counts once
            cols = [pa.array([x if k else None for x, k in zip(s, keep.tolist())], pa.binary()), batch.column(1), batch.column(2), batch.column(3), pa.array(again), pa.array(np.where(done, off, at + size))]
            yield pa.RecordBatch.from_arrays(cols, ["string", "doc_id", "at", "off", "again", "end"]).filter(pa.array(live))
            last, last_doc, last_at = s[-1], int(first_doc[-1]), int(first_at[-1])

    return _sorted(strings, "string", "string", "doc_id", "at").mapInArrow(run, STRING + ", again boolean, end long")


def repeated_windows(group: np.ndarray, hulls: pa.Array, doc: np.ndarray, at: np.ndarray, off: np.ndarray, width: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the windows of hulls of equal ``group`` that start earlier in another one: digits of eight bytes, singletons leaving."""
    reach = width - digit
    ends = np.frombuffer(hulls.buffers()[1], dtype=np.int32)[hulls.offset : hulls.offset + len(hulls) + 1].astype(np.int64)
    data = np.frombuffer(hulls.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    side = np.zeros((len(size), reach + width + 8), dtype=np.uint8)  # anchors below one another, zeros behind
    side[row, np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size) + np.repeat(reach - off, size)] = data
    rows, starts = [], []
    for o in range(reach + 1):  # windows that begin ``o`` bytes before the anchor
        live = np.flatnonzero((off >= o) & (off - (size - width) <= o))
        same = group[live]
        begin = reach - o
        columns = np.concatenate((np.arange(reach + digit, begin + width), np.arange(reach - 1, begin - 1, -1), np.arange(reach, reach + digit)))
        columns = np.concatenate((columns, np.full(-len(columns) % 8, side.shape[1] - 1)))
        for k in range(0, len(columns), 8):
            if len(live) < 2:
                break
            value = np.ascontiguousarray(side[live[:, None], columns[k : k + 8]]).view(">u8")[:, 0].astype(np.uint64)
            order = np.lexsort((value, same))
            live, same, value = live[order], same[order], value[order]
            number = np.cumsum(np.concatenate(([True], (same[1:] != same[:-1]) | (value[1:] != value[:-1])))) - 1
            more = np.bincount(number)[number] > 1
            live, same = live[more], number[more]
        if len(live) < 2:
            continue
        start = at[live] + off[live] - o
        order = np.lexsort((start, doc[live], same))
        live, same, start = live[order], same[order], start[order]
        head = np.concatenate(([True], same[1:] != same[:-1]))
        first = np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))
        again = (doc[live] != doc[live[first]]) | (start != start[first])
        rows.append(live[again])
        starts.append(start[again])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *starts])


def _compared(heads: DataFrame, width: int, digit: int) -> DataFrame:
    """(doc_id, a, b) of the windows of different hulls that start earlier; keys of at most ``GROUP`` hulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, hulls, doc, at, off in _by_key(batches):
            number = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
            crowd = np.flatnonzero(np.bincount(number)[number] > 1)
            if len(crowd):
                live = [c[crowd] for c in (number, doc, at, off)]
                row, start = repeated_windows(live[0], pa.array(hulls[crowd], pa.binary()), *live[1:], width, digit)
                if len(row):
                    out = merged(live[1][row], start, start + width)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["doc_id", "a", "b"])

    return _sorted(heads.select("key", "string", "doc_id", "at", "off"), "key").mapInArrow(run, "doc_id long, a long, b long")


def _windows(heads: DataFrame, width: int) -> DataFrame:
    """The single windows of hulls, for keys that no task could hold."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for hull, doc, at in zip(*(c.to_pylist() for c in batch.columns)):
                a = np.arange(len(hull) - width + 1)
                yield hull, a, a + width, doc, at, np.zeros_like(a)

    return heads.select("string", "doc_id", "at").mapInArrow(lambda batches: _gathered(pieces, batches), STRING)


def repeated_stretches(docs: DataFrame, width: int = 100, digit: int = 36) -> DataFrame:
    """(doc_id, a, b): stretches whose bytes lie in a window that also starts earlier; may overlap."""
    live = stage(_met_again(_anchor_rows(docs, width, digit)), "anchors")
    release(docs.sparkSession)  # the shuffle's files: the next one is as large
    hulls = stage(_ordered(_hulls(_packed(docs), live, width)), "hulls")
    release(docs.sparkSession, live)
    own = F.expr(f"substring(string, int(off) + 1, {digit})")
    heads = hulls.where("string is not null").withColumn("key", F.xxhash64(own))
    hot = stage(heads.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"), "hot")
    spans = hulls.where("again").select("doc_id", F.col("at").alias("a"), F.col("end").alias("b"))
    if hot.limit(1).count():
        crowded = broadcast_if_small(hot)  # at most a GROUP-th of the hulls
        single = _ordered(_windows(heads.join(crowded, "key", "left_semi"), width)).where("again")
        spans = spans.unionByName(single.select("doc_id", F.col("at").alias("a"), F.col("end").alias("b")))
        heads = heads.join(crowded, "key", "left_anti")
    spans = stage(spans.unionByName(_compared(heads, width, digit)), "stretches")
    release(docs.sparkSession, hulls, hot)
    return spans


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Where rows share a doc_id or have none: the table with a number for each (doc_id, text), in their order, as
    doc_id, and the doc_id of each number. A look at the ids alone tells whether that is needed."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1 or doc_id is null").limit(1).count():
        return None
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    texts = docs.select("doc_id", "text", sha.alias("sha"))
    pairs = texts.select("doc_id", "sha").distinct().repartitionByRange("doc_id", "sha").sortWithinPartitions("doc_id", "sha")
    pairs = stage(pairs.withColumn("number", F.monotonically_increasing_id()), "numbers")  # in order, with gaps
    same = texts["doc_id"].eqNullSafe(pairs["doc_id"]) & (texts["sha"] == pairs["sha"])
    rows = stage(texts.join(pairs, same).select(pairs["number"].alias("doc_id"), "text"), "numbered")
    return rows, pairs.select("number", "doc_id")


def deduplicate(docs: DataFrame, width: int = 100, digit: int = 36, with_text: bool = False) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 per document; ``with_text`` adds what is kept (bytes)."""
    if found := _numbered(docs):
        out = _deduplicated(found[0], width, digit, with_text).withColumnRenamed("doc_id", "number")
        return out.join(found[1], "number").select("doc_id", *[c for c in out.columns if c != "number"])
    return _deduplicated(docs, width, digit, with_text)


def _deduplicated(docs: DataFrame, width: int, digit: int, with_text: bool) -> DataFrame:
    lists = repeated_stretches(docs, width, digit).groupBy("doc_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, packed, starts, ends in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                raw = z.decompress(packed.as_py())
                kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
                parts = []
                if starts.is_valid:
                    a, b = starts.values.to_numpy(), ends.values.to_numpy()
                    _, a, b = merged(np.zeros(len(a), dtype=np.int64), a, b)
                    spans, removed = len(a), int((b - a).sum())
                    for x, y in zip(a.tolist(), b.tolist()):
                        parts.append(raw[at:x])
                        at = y
                parts.append(raw[at:])
                for part in parts:
                    kept.update(part)
                rows.append((None if doc_id == NO_ID else doc_id, len(raw), removed, spans, kept.hexdigest(), *([b"".join(parts)] if with_text else ())))
            cols = list(zip(*rows)) or [()] * (5 + with_text)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [c.split()[0] for c in schema.split(", ")])

    return _packed(docs).join(lists, "doc_id", "left").select("doc_id", "z", "a", "b").mapInArrow(run, schema)
