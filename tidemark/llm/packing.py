"""Best-fit packing by minimum bin slack.

Token counts never exceed the capacity, so the whole corpus reduces to a
histogram of at most ``capacity`` lengths. Bins are planned on that histogram:
the longest remaining length opens a bin, a bitset subset-sum over the available
lengths finds the fullest feasible combination, and the combination is taken as
often as the counts allow. Pieces then find their place by their rank within
their length; ranks are two-level (salted), so a length that a third of the
corpus shares spreads over many tasks.

Edge cases: a null text counts as empty (one piece holding only the end token);
the string of an added token within a text is that token;
an empty table gives an empty result; equal documents are packed separately;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoder(ranks_path: str, pattern: str):
    """The byte-level BPE of ``byte_bpe_50k`` from its rank file; same ids as the JSON form, several times faster."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _added_tokens(json_path: str) -> dict[str, int]:
    """The tokens that the vocabulary's JSON form recognises inside texts before any merging."""
    with open(json_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens with matching options are not supported")
    return {t["content"]: t["id"] for t in added}


def _encode(enc, added: dict[str, int], cuts: re.Pattern, text: str) -> list[int]:
    """Ids of ``text``: added tokens as such, the parts between them each on its own."""
    if not any(t in text for t in added):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in cuts.split(text):
        if part in added:
            ids.append(added[part])
        elif part:
            ids += enc.encode_ordinary(part)
    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, with the remainder first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    edges = ([0] if first else []) + list(range(first, n + 1, capacity))
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def tokenize_pieces(docs: DataFrame, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document; ``with_ids`` adds the ids themselves.

    ``ranks_path`` is the vocabulary's rank file, readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        enc = _encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        added = _added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
        cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*_encode(enc, added, cuts, text.as_py() or ""), end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (doc_id, piece, start, length, zlib.crc32(part.tobytes()))
                    for c, v in zip(out, row + ((part,) if with_ids else ())):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            if with_ids:
                out[5] = [x.astype("int32") for x in out[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def fullest(counts: dict[int, int], slack: int) -> dict[int, int]:
    """Lengths (with multiplicity) whose sum is the largest possible up to ``slack``."""
    reach, steps, mask = 1, [], (1 << (slack + 1)) - 1
    for length in sorted((k for k, n in counts.items() if n and k <= slack), reverse=True):
        left, block = min(counts[length], slack // length), 1
        while left and not reach >> slack & 1:
            take = min(block, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & mask
            left, block = left - take, block * 2
        if reach >> slack & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins use it). Each step exhausts at least one length, so the list stays short."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        combo = fullest(counts, capacity - longest)
        counts[longest] += 1
        combo[longest] = combo.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in combo.items())
        plan.append((combo, times))
        for k, m in combo.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
    return plan


def segments(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, per bin, offset) for every length of every combination."""
    rows, used, first_bin = [], {}, 0
    for combo, times in plan:
        offset = 0
        for length in sorted(combo, reverse=True):
            m, at = combo[length], used.get(length, 0)
            rows.append((length, at, at + m * times, first_bin, m, offset))
            used[length] = at + m * times
            offset += length * m
        first_bin += times
    return rows


def assign(pieces: DataFrame, capacity: int = 1024, salts: int = 256) -> DataFrame:
    """Give each piece ``sequence_id`` and ``offset``. ``pieces`` needs doc_id, piece and length.

    The histogram has at most ``capacity`` rows; it and the bin plan are all that
    reaches the driver. A full piece is a bin of its own (negative sequence ids)
    and is not shuffled.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by_salt = short.groupBy("length", "_salt").agg(F.count("*").alias("_n")).collect()  # at most capacity * salts rows
    histogram: dict[int, int] = {}
    bases = []
    for r in sorted(by_salt, key=lambda r: (r["length"], r["_salt"])):
        bases.append((r["length"], r["_salt"], histogram.get(r["length"], 0)))
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["_n"]
    base = spark.createDataFrame(bases, "length long, _salt long, _base long")
    seg = spark.createDataFrame(segments(plan_bins(histogram, capacity)), "length long, _from long, _to long, _bin long, _per long, _off long")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = short.withColumn("_rank", F.row_number().over(within) - 1).join(F.broadcast(base), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = ranked.join(F.broadcast(seg), (ranked["length"] == seg["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(seg["length"])
    at = F.col("_rank") - F.col("_from")
    placed = placed.withColumns({"sequence_id": F.col("_bin") + F.floor(at / F.col("_per")), "offset": F.col("_off") + (at % F.col("_per")) * F.col("length")})
    return full.unionByName(placed.select(*full.columns))


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, ranks_path: str | None = None) -> DataFrame:
    """Pieces of every document with their places: the operator as a whole."""
    pieces = stage(tokenize_pieces(docs, ranks_path, capacity, end_id), "pieces", 1000)
    return assign(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, capacity: int = 1024, end_id: int = 2, ranks_path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, input_ids and the document spans within."""
    pieces = stage(tokenize_pieces(docs, ranks_path, capacity, end_id, with_ids=True), "pieces", 1000)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (
        assign(pieces, capacity).groupBy("sequence_id").agg(parts.alias("p"))
        .select("sequence_id", F.flatten(F.col("p.ids")).alias("input_ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["offset"], x["length"])).alias("spans"))
    )
