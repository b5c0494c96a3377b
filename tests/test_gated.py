"""The gated data source: filters choose manifests, refused reads open no file, streams read day by day."""

import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators.core import KINDS
from tidemark.sources import gated, reader, sinks

DAY = 86_400 * 10**9
EVENT = "venue string, symbol_id long, exch_ts_ns long, recv_ts_ns long, stream_seq long, kind string, price double, qty double, side string, trade_id long, status_kind string, detail string"


@pytest.fixture
def root(spark, tmp_path):
    """Two symbols on each of three days; on the second the feed of symbol 2 was disconnected."""
    rows = [("okx", s, 0, i * DAY // 4, i, "trade", 10.0 + i, 1.0, "Buy" if i % 2 else "Sell", i, None, None) for i in range(12) for s in (1, 2)]
    rows += [("okx", 2, 0, DAY + k, 100 + k, "status", None, None, None, None, s, None) for k, s in ((5, "Disconnected"), (90, "Connected"))]
    sinks.compact(spark.createDataFrame(rows, EVENT), str(tmp_path / "store"), "h", KINDS)
    gated.register(spark)
    return str(tmp_path / "store")


def read(spark, root, mode="refuse"):
    return spark.read.format("gated_trades").options(root=root, mode=mode).load()


def spoil(root, date):
    """A file that any reader chokes on takes the place of the day's."""
    for p in pathlib.Path(root, "trades", "venue=okx", f"date={date}").glob("*.parquet"):
        p.write_bytes(b"not parquet")


def test_filters_reach_manifests_and_files(spark, root):
    spoil(root, "1970-01-03")
    d = read(spark, root).where("venue = 'okx' and symbol_id = 1 and date in ('1970-01-01', '1970-01-02') and recv_ts_ns > 21600000000000 and side = 'Buy'")
    want = reader.read_stream(spark, root, "trade", "okx", 1, ["1970-01-01", "1970-01-02"]).where("recv_ts_ns > 21600000000000 and side = 'Buy'")
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, want.select(*d.columns).collect())) and d.count() == 3
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan gated_trades" in plan and " Filter " not in plan  # the source has taken every filter


def test_refused_reads_open_no_file(spark, root):
    for date in ("1970-01-01", "1970-01-02", "1970-01-03"):
        spoil(root, date)
    for where, said in (("date = '1970-01-02'", "gap of okx 2"), ("symbol_id = 9", "no manifest"), ("date in ('1970-01-01', '1999-01-01') and symbol_id = 1", "no manifest"), ("true", "gap of okx 2")):
        with pytest.raises(Exception, match=said):
            read(spark, root).where(where).count()
    for p in pathlib.Path(root, "trades", "venue=okx", "date=1970-01-01").glob("*.parquet"):
        p.unlink()
    with pytest.raises(Exception, match="no data"):
        read(spark, root).where("date = '1970-01-01'").count()
    with pytest.raises(Exception, match="(?i)parquet"):
        read(spark, root, "warn").where("date = '1970-01-02'").count()
    assert read(spark, root, "warn").where("date = '1970-01-01'").count() == 0
    with pytest.raises(Exception, match="unknown mode"):
        read(spark, root, "maybe").count()
    assert read(spark, root + "-none", "warn").count() == 0


def test_days_as_a_stream(spark, root, tmp_path):
    def run():
        s = spark.readStream.format("gated_trades").options(root=root).load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.schema(reader.TRADES).parquet(str(tmp_path / "out")).groupBy("date").agg(F.count("*").alias("n")).orderBy("date").collect()

    assert [tuple(x) for x in run()] == [(f"1970-01-0{i}", 8) for i in (1, 2, 3)]
    sinks.compact(spark.createDataFrame([("okx", 1, 0, 3 * DAY + 7, 50, "trade", 1.0, 1.0, "Buy", 50, None, None)], EVENT), root, "h2", KINDS)
    assert [tuple(x) for x in run()] == [*((f"1970-01-0{i}", 8) for i in (1, 2, 3)), ("1970-01-04", 1)]
