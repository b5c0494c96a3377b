"""N-gram Jaccard join with parity sketches.

A document's shingles are hashed to 64 bits. A sketch has ``blocks`` words of 128
bits; every shingle flips one bit, so two sketches differ in at most as many
bits, and in at most as many words, as the sets differ in elements. Within a
size band the threshold allows at most D different elements, hence of D + 1
words one must agree: equal words are joined, the rest of the work is verifying.
A quarter more words than that are kept, so that the ones of fewest shingles, which
agree by chance, need not be joined: an agreeing word holds the same shingles on
both sides, so as long as a document leaves out no more words than the surplus,
each partner is found by another word.

Documents with equal sets are one class and meet as one row. Words with the same
documents count once. A word that many classes share does not give all pairs:

* its smallest class is tried with each of the others, first each class with the
  nearest of these only, then those pairs that links do not join yet;
* words whose classes then lie in several components are looked at again: each
  class proposes its nearest class of another component. Whoever has none leaves;
  for the rest all pairs between components that are still apart are tried.

Groups of more than ``BLOCK`` classes are dealt in blocks: the classes outside a
group's largest component meet every block, the others only those from outside.
Everywhere the Hamming distance of one wide sketch a set leaves out pairs that
cannot link, and every link is verified on the sets themselves. A wide sketch has
about a bit a shingle, 1024 at least: a full one says nothing, and each pair of long
texts of a group would be verified. So components are exact, while the number of
pairs stays near the number of classes for groups that do link.

Words of different layouts never meet, so the words can be joined in turns, each for
the layouts of one remainder: less disk at a time for shingling once more a turn.

Edge cases: null texts and texts without a word have an empty set, link with
nothing and are their own component; fewer words than a shingle count as one
shingle; repeated rows fall into one class; rows without a doc_id link with nothing
and have no component; an empty table gives an empty result; other columns are ignored. Sets are compared through 64-bit hashes of
their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, settled, stage
from tidemark.llm.components import components
from tidemark.llm.substrings import BASES, Powers, Prefix, _by_key, mix

PIECE = 1 << 22
BLOCK = 4096
BATCH = 1000  # texts of an Arrow batch
WIDE = 1024  # bits of a wide sketch at least
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


class Hasher:
    """Word and shingle hashes; keeps the powers that the longest text so far needed."""

    def __init__(self, words: int = 3, space: np.ndarray = _SPACE):
        self.words, self.space, self.powers = words, space, Powers(BASES[0], 1 << 14)

    def _words(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers.up):
            self.powers = Powers(BASES[0], 1 << int(len(data)).bit_length())
        inside = np.concatenate(([False], ~self.space[data], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        return mix(Prefix(_LOWER[data], self.powers).of(start, end) + (end - start).astype(np.uint64))

    def word_hashes(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
        if len(data) <= PIECE:
            return self._words(data)
        space = np.flatnonzero(self.space[data])  # long texts go in pieces that end at white space
        cuts = np.unique(np.concatenate(([0], space[np.searchsorted(space, np.arange(PIECE, space[-1], PIECE))] if len(space) else [], [len(data)]))).astype(int)
        return np.concatenate([self._words(data[a:b]) for a, b in zip(cuts, cuts[1:])])

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles, sorted."""
        w, k = self.word_hashes(text), self.words
        if not len(w):
            return w
        if len(w) < k:
            h = np.array([len(w)], dtype=np.uint64)
            for i in range(len(w)):
                h = h * np.uint64(31) + w[i : i + 1] * _MULTIPLIERS[i % len(_MULTIPLIERS)]
            return mix(h)
        h = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            h = h * np.uint64(31) + w[i : len(w) - k + 1 + i] * _MULTIPLIERS[i % len(_MULTIPLIERS)]
        return np.unique(mix(h))


def bands(percent: int, top: int) -> list[int]:
    """Lower edges of the size bands; a partner's size lies in the same or a neighbouring band."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return edges


def layouts(n: int, percent: int, edges: list[int]) -> list[tuple[int, int]]:
    """(layout, words) in which a set of ``n`` takes part: its own band's and the next one's."""
    while edges[-1] <= n * 2 + 2:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    b = int(np.searchsorted(edges, n, side="right")) - 1
    return [(x, 2 * (edges[x + 1] - 1) * (100 - percent) // (100 + percent) + 1) for x in (b, b + 1)]


def surplus(needed: int) -> int:
    """How many words are kept beyond the ``needed`` D + 1."""
    return needed // 4 + 2


def sketch_words(shingles: np.ndarray, layout: int, needed: int) -> np.ndarray:
    """A key for each sketch word that must be joined, from its place, layout, 128 parity bits and its shingles' sum."""
    words = needed + surplus(needed)
    block = ((shingles >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64)
    at = block * 128 + (shingles & np.uint64(127)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=words * 128) & 1).astype(bool)).view(np.uint64).reshape(words, 2)
    # The blocks follow the hash, so sorted shingles are grouped by block.
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    sums = np.zeros(words, dtype=np.uint64)
    sums[block[first]] = np.add.reduceat(mix(shingles), first)
    keys = mix(mix(bits[:, 0] + np.uint64(layout)) * _MULTIPLIERS[0] + bits[:, 1] * _MULTIPLIERS[1] + sums * _MULTIPLIERS[2] + np.arange(words, dtype=np.uint64))
    held = np.bincount(block, minlength=words)
    below = np.cumsum(np.bincount(held))  # words of at most 0, 1, 2, ... shingles
    least = int(np.searchsorted(below, surplus(needed), side="right"))
    return keys[held >= least]


def wide_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles in a power of two of bits; the halves of a sketch, one xor the other, are the next shorter one."""
    bits = max(WIDE, 1 << (3 * len(shingles) // 4).bit_length())
    at = (mix(shingles) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


class Sketches:
    """Wide sketches of rows, and the Hamming distances of pairs of rows at the length of the shorter one."""

    def __init__(self, wide: list[bytes]):
        self.words = np.array([len(w) // 8 for w in wide], dtype=np.int64)
        self.start = np.cumsum(self.words) - self.words
        self.flat = np.frombuffer(b"".join(wide), dtype=np.uint64)

    def _at(self, rows: np.ndarray, words: int) -> np.ndarray:
        out = np.empty((len(rows), words), dtype=np.uint64)
        for own in np.unique(self.words[rows]).tolist():
            of = self.words[rows] == own
            got = self.flat[self.start[rows[of]][:, None] + np.arange(own)]
            while got.shape[1] > words:
                half = got.shape[1] // 2
                got = got[:, :half] ^ got[:, half:]
            out[of] = got
        return out

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both, out = np.minimum(self.words[i], self.words[j]), np.zeros(len(i), dtype=np.int64)
        for words in np.unique(both).tolist():
            of = np.flatnonzero(both == words)
            for at in range(0, len(of), BATCH):
                x = of[at : at + BATCH]
                out[x] = np.bitwise_count(self._at(i[x], words) ^ self._at(j[x], words)).sum(1)
        return out


def enough(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size of the set, two hashes of the whole set and its wide sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            n, s1, s2, wide = [], [], [], []
            for text in batch.column(1):
                s = hasher.shingles(text.as_py())
                n.append(len(s))
                wide.append(wide_sketch(s))
                s1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n, s1, s2)), pa.array(wide, pa.binary())], ["doc_id", "n", "s1", "s2", "wide"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, wide binary")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, where what is made of a row is much larger than the row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _keys(docs: DataFrame, words: int, percent: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(key, doc_id, n): all sketch words of this turn's layouts. Texts with equal sets within a task are taken once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, edges = Hasher(words), set(), [1]
        for batch in _slices(batches):
            keys, ids, sizes = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = hasher.shingles(text.as_py())
                if not len(s):
                    continue
                own = hash((len(s), int(s.sum(dtype=np.uint64)), int(s[0]), int(s[-1])))
                if own in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(own)
                for layout, needed in layouts(len(s), percent, edges):
                    if layout % turns != turn:
                        continue
                    keys.append(sketch_words(s, layout, needed))
                    ids.append(np.full(len(keys[-1]), doc_id))
                    sizes.append(np.full(len(keys[-1]), len(s)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32))], ["key", "doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, n int")


def _groups(keys: DataFrame, percent: int) -> DataFrame:
    """From sorted keys: pairs with each group's first document (group null), and the members of groups of three and more.

    A group is named by its members, and one that a task has seen is not given again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for key, doc, n in _by_key(batches):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((first, [len(key)])))
            name = mix(np.add.reduceat(mix(doc.view(np.uint64) + np.uint64(1)), first) + size.astype(np.uint64)).view(np.int64)
            fresh = np.zeros(len(first), dtype=bool)
            for i in np.flatnonzero(size >= 2).tolist():
                if (x := int(name[i])) not in seen:
                    fresh[i] = True
                    if len(seen) < 1 << 20:
                        seen.add(x)
            live = np.repeat(fresh, size)
            hub, hub_n, group, many = (np.repeat(x, size)[live] for x in (doc[first], n[first].astype(np.int64), name, size >= 3))
            doc, n = doc[live], n[live].astype(np.int64)
            near = (hub != doc) & (np.minimum(n, hub_n) * 100 >= np.maximum(n, hub_n) * percent)
            pair = np.unique(np.stack([hub, doc], 1)[near], axis=0)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["g", "a", "b"])
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(group[many]), pa.array(doc[many]), pa.nulls(int(many.sum()), pa.int64())], ["g", "a", "b"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").sortWithinPartitions("key", "doc_id").mapInArrow(run, "g long, a long, b long")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, far): the pairs whose sizes and sketches allow a link, and the distance of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy() for i in (2, 3))
                at = np.arange(batch.num_rows)
                far = Sketches(batch.column(4).to_pylist() + batch.column(5).to_pylist()).far(at, at + batch.num_rows)
                ok = far * (100 + percent) <= (na + nb) * (100 - percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far.astype(np.int32))], ["a", "b", "far"]).filter(pa.array(ok))

    j = pairs
    for end in ("a", "b"):
        j = j.join(sketches.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("wide").alias(f"w{end}")), end)
    j = j.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return j.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long, far int")


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, z): the compressed texts of the documents in ``wanted`` (id)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(1)], pa.binary())], ["id", "z"])

    return docs.select("doc_id", "text").mapInArrow(pack, "id long, z binary").join(wanted, "id", "left_semi").dropDuplicates(["id"])


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold. The texts travel compressed, which is less than their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, hasher, last, s = zstandard.ZstdDecompressor(), Hasher(words), None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:  # mostly the rows are sorted by a
                    last, s = a, hasher.shingles(z.decompress(x.as_py()).decode())
                t = hasher.shingles(z.decompress(y.as_py()).decode())
                keep.append(enough(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = stage(_packed(docs, stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")), "texts", BATCH)
    release(docs.sparkSession)  # the texts' own shuffle
    a, b = (texts.select(F.col("id").alias(end), F.col("z").alias(f"z{end}")) for end in ("a", "b"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _near(u: np.ndarray, probe: np.ndarray, base: np.ndarray, root: np.ndarray, n: np.ndarray, wide: Sketches, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j of one unit, of different roots, one probing the other, whose sizes and sketches allow a link; and their distance."""
    out = []
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    left = np.repeat(np.append(first[1:], len(u)), np.diff(np.append(first, len(u)))) - np.arange(len(u))  # rows of the unit from here on
    i = np.arange(len(u))
    for step in range(1, int(left.max(initial=1))):
        i = i[left[i] > step]
        j = i + step
        ok = (root[i] != root[j]) & (probe[i] & base[j] | base[i] & probe[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
        x, y = i[ok], j[ok]
        if len(x):
            far = wide.far(x, y)
            ok = far * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
            if ok.any():
                out.append((x[ok], y[ok], far[ok]))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(c) for c in zip((none, none, none), *out))


def _proposals(members: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(g, a, b): pairs between different components of one group whose sketches allow a link.

    ``members`` has g, id, root. ``nearest`` keeps for each a the closest b of a unit, so every
    class that has a possible partner in its group occurs as an a; else each pair is given once.
    """
    parts = members.groupBy("g", "root").agg(F.count("*").alias("m")).groupBy("g")
    parts = parts.agg(F.sum("m").alias("size"), F.max_by("root", F.struct("m", -F.col("root"))).alias("most"), F.max("m").alias("top"), F.count("*").alias("roots"))
    parts = parts.where("roots > 1").withColumns({"blocks": F.ceil(F.col("size") / BLOCK).cast("int"), "chunks": F.ceil((F.col("size") - F.col("top")) / BLOCK).cast("int")})
    dealt = members.join(parts, "g").join(sketches, "id").withColumns({"outside": F.col("root") != F.col("most"), "large": F.col("blocks") > 1})
    place = lambda seed, count: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(count)).cast("int")
    alone, zero = F.col("large") == F.lit(False), F.lit(0)
    base = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: F.struct(F.when(alone, zero).otherwise(place(1, "blocks")).alias("i"), F.when(alone, zero).otherwise(c).alias("c"), alone.alias("probe"), F.lit(True).alias("base")))
    base = F.when(alone, F.slice(base, 1, 1)).otherwise(base)
    probe = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), place(2, "chunks").alias("c"), F.lit(True).alias("probe"), F.lit(False).alias("base")))
    units = dealt.withColumn("at", F.explode(F.when(F.col("large") & F.col("outside"), F.concat(base, probe)).otherwise(base)))
    units = units.select(F.xxhash64("g", "at.i", "at.c").alias("u"), "g", "id", "root", F.col("n").cast("long").alias("n"), "at.probe", "at.base", "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, g, ids, root, n, probe, base, wide in _by_key(batches):
            i, j, far = _near(u, probe.astype(bool), base.astype(bool), root, n, Sketches(wide.tolist()), percent)
            if nearest and len(i):
                i, j, far = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((far, far))
                order = np.lexsort((ids[j], far, i))
                order = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))]
                i, j = i[order], j[order]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(g[i]), pa.array(ids[i]), pa.array(ids[j])], ["g", "a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, "u").sortWithinPartitions("u").mapInArrow(run, "g long, a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def join(docs: DataFrame, percent: int = 90, words: int = 3, turns: int = 1) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): links hold where 100 * common >= percent * union.

    ``turns``: sketch words are joined in so many jobs, whose shuffles are not on disk at the same time.
    """
    spark = docs.sparkSession
    every = stage(_signatures(docs, words), "signatures", BATCH)
    docs, sig = docs.where("doc_id is not null"), every.where("doc_id is not null")
    classes = sig.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id"))
    member = stage(sig.drop("wide").join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")
    sketches = sig.select(F.col("doc_id").alias("id"), "n", "wide").dropDuplicates(["id"])
    parts = []
    for turn in range(turns):
        parts.append(stage(_groups(_keys(docs, words, percent, turn, turns), percent), "groups", BATCH))
        release(spark)  # the keys, the largest shuffle
    groups = reduce(DataFrame.unionByName, parts)
    pairs = groups.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    possible = stage(_possible(pairs, sketches, percent), "possible", BATCH)
    links = member.where("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))

    def tested(more: DataFrame) -> None:
        nonlocal links, roots
        if more.limit(1).count():
            links = links.unionByName(settled(lambda: _verified(more, docs, words, percent), "links", BATCH))
        elif roots is not None:
            return
        roots = settled(lambda: components(links), "roots")

    roots = None
    # First the nearest of the smallest classes that a class meets, then those that are still apart.
    tried = stage(possible.groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a")).select("a", "b"), "pairs")
    tested(tried)
    rest = stage(_apart(possible.select("a", "b").join(tried, ["a", "b"], "left_anti"), roots), "pairs")
    tested(rest)
    tried = tried.unionByName(rest)
    active = stage(groups.where("g is not null").select("g", F.col("a").alias("id")).distinct(), "crowd")
    release(spark, *parts, possible)
    for nearest in (True, False):
        now = active.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        found = stage(_proposals(now, sketches, percent, nearest), "proposals")
        active = found.select("g", F.col("a").alias("id")).distinct()
        more = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = stage(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        tested(more)
        tried = tried.unionByName(more)
    found = member.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("root", "class_id").alias("component_id"))
    none = F.lit(None).cast("long")
    return found.unionByName(every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), none.alias("class_id"), none.alias("component_id")))
