"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading cuts the files at the magic line ``WARC/1.1``, split by split. The magic
may also stand inside a payload, so a cut is only a candidate: each task emits
the candidate's place and, from its header, the place of its successor. Pointer
jumping from the start of each file then keeps the records that the chain
reaches; all other cuts lie inside payloads. Places are relative to the split at
first and become file offsets through the lengths of the splits before.

Only lengths, digests and header values are shuffled; bodies only for the few
records whose payload holds the magic itself.

Edge cases: a null payload is written and read as an empty one; a record that
runs past the end of its file is dropped, with all that follows in that file;
equal page ids with equal payloads are all responses if theirs is the largest
id; a null url is written empty; an empty table gives archives without records
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, new_path, stage

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MAX_LENGTH = 10**18  # beyond any file, and places plus lengths still fit 64 bits


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is set for revisits."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    large = p.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n"))
    shared = stage(large.where("n > 1").select("payload_digest", "last_id"), "shared")
    p = p.join(broadcast_if_small(shared), "payload_digest", "left")
    revisit = F.col("last_id").isNotNull() & (F.col("page_id") != F.col("last_id"))
    return p.withColumn("refers_to", F.when(revisit, F.col("last_id"))).drop("last_id")


def write(pages: DataFrame, path: str, min_bytes: int = 1000, records_per_file: int = 4096) -> None:
    """Write one record per page. Revisits carry no payload, only its length and digest."""
    r = plan_records(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit("\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    r.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


CHUNK = "file string, block long, rel long, size long, head long, length long, kind string, page_id long, refers_to long, digest string, payload_length long"
_FIELD = {k: re.compile(rb"(?:^|\r\n)" + k.encode() + rb": *<?(?:urn:page:|sha1:)?([^>\r]*)", re.I) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "X-Payload-Length", "Content-Length")}


def _number(raw: bytes | None) -> int | None:
    """A signed 64-bit integer, None if ``raw`` is none."""
    m = re.fullmatch(rb"(-?)0*([0-9]{1,19})", raw or b"")
    n = int(m[1] + m[2]) if m else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def parse_head(chunk: bytes) -> tuple[int, dict[str, bytes]] | None:
    """Header length and fields of a candidate record, None if it cannot be one."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k: m[1] for k, r in _FIELD.items() if (m := r.search(chunk, 0, end))}
    length = _number(fields.get("Content-Length"))
    return (end + 4, fields) if length is not None and 0 <= length < MAX_LENGTH else None


def _cuts(spark: SparkSession, path: str, bodies: bool) -> DataFrame:
    """Candidates of all splits in place order, ``rel`` counted from the split's first cut."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = None, 0
        for batch in batches:
            rows = []
            for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (file, block) != at:
                    at, rel = (file, block), 0
                chunk = value.as_py()
                if bodies:
                    rows.append((file, block, rel, chunk))
                elif got := parse_head(chunk):
                    head, f = got
                    length = _number(f["Content-Length"])
                    whole = len(chunk) >= head + length
                    digest = hashlib.sha1(chunk[head : head + length]).hexdigest() if whole else None
                    kind = f.get("WARC-Type", b"").decode("utf-8", "replace")
                    if kind == "revisit":
                        digest, paid = f.get("WARC-Payload-Digest", b"").decode("utf-8", "replace"), _number(f.get("X-Payload-Length"))
                    else:
                        paid = length
                    rows.append((file, block, rel, len(chunk), head, length, kind, _number(f.get("WARC-Record-ID")), _number(f.get("WARC-Refers-To")), digest, paid))
                else:
                    rows.append((file, block, rel, len(chunk), None, None, None, None, None, None, None))
                rel += len(chunk) + len(MAGIC)
            if bodies:
                types, names = (pa.string(), pa.int64(), pa.int64(), pa.binary()), ("file", "block", "rel", "body")
            else:
                types = (pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                names = [c.split()[0] for c in CHUNK.split(", ")]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], list(names))

    return raw.mapInArrow(run, "file string, block long, rel long, body binary" if bodies else CHUNK)


def reachable(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Pointer jumping: the (file, pos) that the chain from each file's start reaches.

    ``nodes`` has file, pos, nxt and reached (true at a file's first record). Each
    round doubles every pointer, so a file of n records takes log2(n) rounds.
    """
    for _ in range(max_rounds):
        nodes = stage(nodes, "chain")
        if nodes.where("reached and nxt is not null").limit(1).count() == 0:
            break
        target = nodes.select("file", F.col("pos").alias("nxt"), F.col("nxt").alias("after"), F.lit(True).alias("there"))
        step = nodes.join(target, ["file", "nxt"], "left")
        moved = step.select("file", "pos", "after", "reached")
        marked = step.where("reached and there").select("file", F.col("nxt").alias("pos"), F.lit(None).cast("long").alias("after"), F.lit(True).alias("reached"))
        nodes = moved.unionByName(marked).groupBy("file", "pos").agg(F.max("after").alias("nxt"), F.max("reached").alias("reached"))
    return nodes.where("reached").select("file", "pos")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record: page_id, payload_bytes, payload_digest, record_type, refers_to, file and offset."""
    cuts = stage(_cuts(spark, path, bodies=False), "cuts")
    gap = len(MAGIC)
    splits = cuts.groupBy("file", "block").agg(F.sum(F.col("size") + gap).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    cuts = cuts.join(base, ["file", "block"]).withColumn("pos", F.col("base") + F.col("rel"))
    record = cuts.where(F.col("head").isNotNull() & (F.col("pos") > 0))
    nodes = record.select("file", "pos", (F.col("pos") + F.col("head") + F.col("length") + len(END) + gap).alias("nxt"), (F.col("pos") == gap).alias("reached"))
    true = stage(record.join(reachable(nodes), ["file", "pos"]), "records")
    out = true.where("digest is not null")
    if true.where("digest is null").limit(1).count():
        out = out.unionByName(_reassembled(spark, path, cuts, true))
    return out.select("page_id", F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "file", (F.col("pos") - gap).alias("offset"))


def _reassembled(spark: SparkSession, path: str, cuts: DataFrame, true: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces are read again and joined."""
    gap = len(MAGIC)
    marks = cuts.select("file", "block", "rel", "pos").join(true.select("file", "pos", F.col("pos").alias("owner"), F.col("digest").isNull().alias("split")), ["file", "pos"], "left")
    upto = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a file's cuts: bounded by its size
    marks = marks.withColumns({"owner": F.last("owner", True).over(upto), "split": F.last("split", True).over(upto)})
    wanted = stage(marks.where("split").select("file", "block", "rel", "pos", "owner"), "pieces")
    pieces = _cuts(spark, path, bodies=True).join(broadcast_if_small(wanted), ["file", "block", "rel"])
    parts = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    full = F.aggregate(F.slice("parts.body", 2, 1 << 30), F.col("parts.body")[0], lambda a, b: F.concat(a, F.lit(MAGIC).cast("binary"), b))
    whole = parts.select("file", F.col("owner").alias("pos"), full.alias("whole"))
    joined = true.where("digest is null").drop("digest").join(whole, ["file", "pos"]).where(F.octet_length("whole") >= F.col("head") + F.col("length"))
    return joined.withColumn("digest", F.sha1(F.substring("whole", F.col("head").cast("int") + 1, F.col("length").cast("int")))).select(*true.columns)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
