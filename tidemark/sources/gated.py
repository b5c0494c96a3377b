"""Gated trades as a data source: which files are read follows from manifests, before any file of trades is opened.

``register(spark)``, then ``spark.read.format("gated_trades").option("root", ...)`` or ``readStream``. Options: ``root``;
``mode`` is ``warn`` (default: read what there is) or ``refuse``: raise CoverageError if a key and day that is asked for
has no manifest, a gap or no file. Filters on venue, symbol_id and date choose the manifests, all comparisons
with columns of the files reach the Parquet scan. Files are read by executors in Arrow batches. Spark gives such a
source no list of columns: for narrow scans of days known to be whole ``reader.read_stream`` is faster.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tidemark.operators.intervals import CoverageError
from tidemark.sources.reader import TRADES

KEYS = ("venue", "symbol_id", "date")
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class Day(InputPartition):
    """One file of a venue's day."""

    path: str
    venue: str
    date: str


def _compared(f: Filter) -> ds.Expression:
    x = ds.field(f.attribute[0])
    if isinstance(f, IsNotNull):
        return x.is_valid()
    return x.isin(list(f.value)) if isinstance(f, In) else COMPARED[type(f)](x, f.value)


def _all(parts: list[ds.Expression]) -> ds.Expression | None:
    return reduce(operator.and_, parts) if parts else None


class Gate:
    """The store under ``root``: planning from manifests, and reading of what was planned."""

    def __init__(self, options: dict[str, str]):
        self.root, self.mode = options["root"], options.get("mode", "warn")
        if self.mode not in ("warn", "refuse"):
            raise ValueError(f"unknown mode: {self.mode}")
        self.filters: list[Filter] = []

    def manifests(self, more: list[ds.Expression]) -> list[dict[str, Any]]:
        """Key, day and gaps of the manifests of trades that the filters choose; only these columns are read."""
        fs, root = FileSystem.from_uri(self.root)
        if fs.get_file_info(f"{root}/manifests").type == FileType.NotFound:
            return []
        hive = ds.partitioning(pa.schema([("venue", pa.string()), ("date", pa.string())]), flavor="hive")
        chosen = [_compared(f) for f in self.filters if f.attribute[0] in KEYS]
        table = ds.dataset(f"{root}/manifests", filesystem=fs, format="parquet", partitioning=hive)
        return table.to_table(columns=[*KEYS, "gaps"], filter=_all([ds.field("stream") == "trades", *chosen, *more])).to_pylist()

    def plan(self, more: list[ds.Expression] = []) -> list[Day]:  # noqa: B006  never changed
        fs, root = FileSystem.from_uri(self.root)
        found = self.manifests(more)
        days = {d: [] for d in sorted({(m["venue"], m["date"]) for m in found})}
        for (venue, date), files in days.items():
            listed = fs.get_file_info(FileSelector(f"{root}/trades/venue={venue}/date={date}", allow_not_found=True))
            files += [Day(x.path, venue, date) for x in listed if x.type == FileType.File and x.base_name.endswith(".parquet")]
        if self.mode == "refuse":
            self.refuse(found, days)
        return [f for files in days.values() for f in files]

    def refuse(self, found: list[dict[str, Any]], days: dict[tuple[str, str], list[Day]]) -> None:
        named = {f.attribute[0]: list(f.value) if isinstance(f, In) else [f.value] for f in self.filters if isinstance(f, (EqualTo, In)) and f.attribute[0] in KEYS}
        have = {tuple(m[c] for c in named) for m in found}
        if missing := [w for w in product(*named.values()) if w not in have]:
            raise CoverageError(f"no manifest for {dict(zip(named, missing[0]))}")
        for m in sorted(found, key=lambda m: (m["date"], m["venue"], m["symbol_id"])):
            if m["gaps"]:
                raise CoverageError(f"gap of {m['venue']} {m['symbol_id']} from {m['gaps'][0]['from_ns']} to {m['gaps'][0]['to_ns']}")
        if empty := [d for d, files in days.items() if not files]:
            raise CoverageError(f"no data for {empty[0][0]} {empty[0][1]}")

    def rows(self, day: Day | None) -> Iterator[pa.RecordBatch]:
        if day is None:  # what Spark reads where nothing was planned
            return
        schema = pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in TRADES.split(", "))])
        own = pa.schema([f for f in schema if f.name not in ("venue", "date")])
        fs, _ = FileSystem.from_uri(self.root)
        wanted = _all([_compared(f) for f in self.filters if f.attribute[0] in own.names])
        for batch in ds.dataset(day.path, schema=own, filesystem=fs, format="parquet").to_batches(filter=wanted):
            fixed = {"venue": pa.array([day.venue] * len(batch)), "date": pa.array([day.date] * len(batch))}
            yield pa.RecordBatch.from_arrays([fixed[f.name] if f.name in fixed else batch.column(f.name) for f in schema], schema=schema)


class GatedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.gate = Gate(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and type(f) in (In, IsNotNull, *COMPARED):
                self.gate.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Day]:
        return self.gate.plan()

    def read(self, partition: Day | None) -> Iterator[pa.RecordBatch]:
        return self.gate.rows(partition)


class GatedStream(DataSourceStreamReader):
    """Days in order, as their manifests appear: a micro-batch reads the days after the last one's. A day's manifests are written at once."""

    def __init__(self, options: dict[str, str]):
        self.gate = Gate(options)

    def initialOffset(self) -> dict[str, str]:
        return {"date": ""}

    def latestOffset(self) -> dict[str, str]:
        return {"date": max((m["date"] for m in self.gate.manifests([])), default="")}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[Day]:
        return self.gate.plan([ds.field("date") > start["date"], ds.field("date") <= end["date"]])

    def read(self, partition: Day | None) -> Iterator[pa.RecordBatch]:
        return self.gate.rows(partition)


class GatedTrades(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gated_trades"

    def schema(self) -> str:
        return TRADES

    def reader(self, schema: T.StructType) -> GatedReader:
        return GatedReader(self.options)

    def streamReader(self, schema: T.StructType) -> GatedStream:
        return GatedStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark offer its filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GatedTrades)
