"""Tables on disk: partitioned writes, merge by key, manifests, run metadata and checkpoints.

All of it goes to any file system that Spark knows. Small bookkeeping files are JSON and replaced in one
step; they are written and read by the driver alone.
"""

from __future__ import annotations

import json
import operator
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYOUT = ("chain_id", "block_date", "run_partition_id")


def write_dataset(df: DataFrame, root: str, layer: str, table: str, run_partition_id: str, ingested_at: int | None = None, cluster_by: tuple[str, ...] = (), fmt: str = "parquet") -> str | None:
    """Append ``df`` at root/layer/table, in folders by chain, day and run; an empty one writes nothing.

    Rows carry chain_id and block_date, or a timestamp (unix seconds) to tell the day from. A run that is
    repeated replaces its own folders only.
    """
    if not df.take(1):
        return None
    out = df.withColumns({"run_partition_id": F.lit(run_partition_id), "ingested_at": F.lit(ingested_at if ingested_at is not None else int(time.time())).cast("long")})
    if "block_date" not in out.columns:
        out = out.withColumn("block_date", F.to_date(F.timestamp_seconds("timestamp")) if "timestamp" in out.columns else F.lit(None).cast("date"))
    if cluster_by:
        out = out.sortWithinPartitions(*cluster_by)
    path = f"{root.rstrip('/')}/{layer}/{table}"
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).format(fmt).save(path)
    return path


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), cluster_by: tuple[str, ...] = ()) -> None:
    rows = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    w = rows.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None, sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Replace the catalogue's table ``name`` by ``df`` in ``buckets`` files by the hash of ``keys``, each sorted, and read it.

    Tables with the same number of buckets by the same keys meet by them, and are grouped and ranked by them, without
    a shuffle: it is paid once, when they are written. Rows are dealt by the same hash first, so that
    each task writes one file. A bucket is read as one task: choose their number for the largest table to come.
    """
    w = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *sort_by)
    (w.option("path", path) if path else w).saveAsTable(name)
    return df.sparkSession.table(name)


def latest(rows: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """One row for each key: the last in the order of ``by`` (columns, the greatest last; all others decide ties)."""
    others = [c for c, kind in rows.dtypes if c not in keys and not kind.startswith("map")]
    order = [F.col(c).desc_nulls_last() for c in dict.fromkeys([*(by or []), *others])]
    if not order:
        return rows.dropDuplicates(keys)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last")


def merged(old: DataFrame, new: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; nothing is deleted.

    Of rows of ``new`` that share a key the last by ``by`` counts, as ``latest`` has it. A null is equal to a null.
    """
    rows = latest(new, keys, by)
    told = rows.select(*[F.col(c).alias(f"_new_{c}") for c in keys])
    same = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in keys])
    return old.join(told, same, "left_anti").unionByName(rows, allowMissingColumns=True)


class Files:
    """The few steps on small files and folders that Spark has no writer for, on Hadoop's file systems."""

    def __init__(self, spark: SparkSession | None = None):
        context = (spark or SparkSession.builder.getOrCreate()).sparkContext
        self.gateway, self.conf = context._gateway, context._jsc.hadoopConfiguration()
        self.fs = context._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        at = self.fs.Path(path)
        system = at.getFileSystem(self.conf)
        return system.makeQualified(at), system

    def text(self, path: str) -> str | None:
        at, system = self._at(path)
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Replace a file in one step: a reader finds the old text or the new one."""
        at, system = self._at(path)
        new = self.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
        stream = system.create(new)  # makes the folder, too
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kinds = getattr(self.fs, "Options$Rename")
        flags = self.gateway.new_array(kinds, 1)
        flags[0] = kinds.OVERWRITE
        self.fs.FileContext.getFileContext(at.toUri(), self.conf).rename(new, at, flags)

    def names(self, path: str) -> list[str]:
        at, system = self._at(path)
        return sorted(x.getPath().getName() for x in system.listStatus(at)) if system.exists(at) else []

    def delete(self, path: str) -> None:
        at, system = self._at(path)
        system.delete(at, True)


class Table:
    """A Parquet table whose rows lie in folders of versions; a pointer file, replaced in one step, names the current ones.

    With ``by_block``, a column that a row's key decides, each range of ``span`` of its numbers has a folder of
    its own, and a merge reads and writes only the ranges that the new rows touch. A range of many rows is
    dealt out to several tasks and files by its size.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by_block: str | None = None, span: int = 10_000):
        self.spark, self.path, self.keys, self.by_block, self.span = spark, path.rstrip("/"), keys, by_block, span
        self.files = Files(spark)

    def _pointer(self) -> str:
        return f"{self.path}/_current.json"

    def folders(self) -> dict[str, str]:
        """The current folder of each range."""
        text = self.files.text(self._pointer())
        return json.loads(text) if text else {}

    def _load(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def read(self) -> DataFrame | None:
        return self._load(sorted(self.folders().values()))

    def _range(self):
        return F.coalesce(F.floor(F.col(self.by_block) / self.span), F.lit(-1)) if self.by_block else F.lit(0)

    def _write(self, rows: DataFrame, known: dict[str, str], ranges: list[str]) -> DataFrame | None:
        v = uuid.uuid4().hex
        rows.withColumn("range_of", self._range().cast("string")).hint("rebalance", "range_of").write.partitionBy("range_of").parquet(f"{self.path}/{v}")
        written = [n.partition("=")[2] for n in self.files.names(f"{self.path}/{v}") if n.startswith("range_of=")]
        new = {r: f for r, f in known.items() if r not in ranges} | {r: f"{v}/range_of={r}" for r in written}
        self.files.put(self._pointer(), json.dumps(new))
        return self._load(sorted(new.values()))

    def _ranges(self, rows: DataFrame) -> list[str]:
        return [r[0] for r in rows.select(self._range().cast("string")).distinct().collect()]  # one row for each range that is touched

    def merge(self, new: DataFrame, by: list[str] | None = None) -> DataFrame | None:
        """Merge by key and switch to the result; a failed run leaves the current version as it was.

        Of new rows that share a key the last by the columns ``by`` counts.
        """
        known, touched = self.folders(), self._ranges(new)
        old = self._load([known[r] for r in touched if r in known])
        rows = merged(old, new, self.keys, by) if old is not None else latest(new, self.keys, by)
        return self._write(rows, known, touched) if touched else self.read()

    def replace(self, rows: DataFrame) -> DataFrame | None:
        """Switch to ``rows`` alone."""
        ranges = self._ranges(rows)
        if not ranges:
            self.files.put(self._pointer(), "{}")
            return None
        return self._write(rows, {}, ranges)

    def exchange(self, rows: DataFrame, stays: Callable[[DataFrame], DataFrame], touched: Callable[[int], bool]) -> DataFrame | None:
        """In the ranges that are touched keep what ``stays`` lets through of the old rows, add ``rows``, which lie in them, and switch to the result."""
        known = self.folders()
        ranges = [r for r in known if touched(int(r))]
        old = self._load([known[r] for r in ranges])
        return self._write(rows if old is None else stays(old).unionByName(rows), known, ranges)

    def vacuum(self, keep: tuple[str, ...] = ()) -> None:
        """Delete the folders that neither the pointer nor ``keep`` (folders that a reader still uses) names."""
        used = {*self.folders().values(), *keep}
        for v in self.files.names(self.path):
            if v.startswith(("_", ".")):
                continue
            own = [f"{v}/{r}" for r in self.files.names(f"{self.path}/{v}") if r.startswith("range_of=")]
            gone = [f for f in own if f not in used]
            for f in [v] if gone == own else gone:
                self.files.delete(f"{self.path}/{f}")


def _put(path: str, value) -> None:
    Files().put(path, json.dumps(value, sort_keys=True, indent=1))


@dataclass
class Manifest:
    """What one run wrote of one source."""

    manifest_id: str
    run_partition_id: str
    source_name: str
    files: list[str]
    row_counts: dict[str, int]
    total_rows: int = field(init=False)

    def __post_init__(self):
        self.total_rows = sum(self.row_counts.values())

    def save(self, folder: str) -> str:
        path = f"{folder.rstrip('/')}/{self.manifest_id}.json"
        _put(path, asdict(self))
        return path

    @classmethod
    def load(cls, path: str) -> Manifest:
        found = json.loads(Files().text(path))
        found.pop("total_rows")
        return cls(**found)


class Runs:
    """Metadata of runs; a later record of a run replaces the earlier one."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def record(self, run_id: str, dag_id: str, chain_id: int, status: str, partitions: int = 0, manifest_ids: list[str] | None = None, started_at: int = 0, completed_at: int | None = None) -> dict:
        if status not in ("running", "success", "failed"):
            raise ValueError(status)
        row = {"run_id": run_id, "dag_id": dag_id, "chain_id": chain_id, "status": status, "partitions": partitions, "manifest_ids": manifest_ids or [], "started_at": started_at, "completed_at": completed_at}
        _put(f"{self.folder}/{run_id}.json", row)
        return row

    def get(self, run_id: str) -> dict:
        text = Files().text(f"{self.folder}/{run_id}.json")
        if text is None:
            raise FileNotFoundError(run_id)
        return json.loads(text)

    def record_source(self, run_id: str, source: str, chain_id: int, partition_key: str, paths: list[str], rows: int, watermark_block: int) -> None:
        """Once for each run, source and partition; a repeat replaces."""
        path = f"{self.folder}/{run_id}.sources.json"
        known = json.loads(Files().text(path) or "{}")
        known[f"{source}|{partition_key}"] = {"source_name": source, "chain_id": chain_id, "partition_key": partition_key, "paths": paths, "rows": rows, "watermark_block": watermark_block}
        _put(path, known)

    def lineage(self, run_id: str) -> dict:
        sources = list(json.loads(Files().text(f"{self.folder}/{run_id}.sources.json") or "{}").values())
        return {"run_id": run_id, "sources": sources, "total_rows": sum(s["rows"] for s in sources)}


class Checkpoint:
    """Last processed block of each chain and source, and block ranges to replay."""

    def __init__(self, path: str):
        self.path = path
        self.state = json.loads(Files().text(path) or "{}")

    def _at(self, chain_id: int, source: str) -> dict:
        return self.state.setdefault(f"{chain_id}|{source}", {"block": 0, "hash": None, "replays": []})

    def last_block(self, chain_id: int, source: str) -> int:
        return self._at(chain_id, source)["block"]

    def last_hash(self, chain_id: int, source: str) -> str | None:
        return self._at(chain_id, source)["hash"]

    def advance(self, chain_id: int, source: str, block: int, block_hash: str) -> None:
        """A lower or equal block changes nothing."""
        at = self._at(chain_id, source)
        if block > at["block"]:
            at["block"], at["hash"] = block, block_hash
            self.save()

    def mark_replay(self, chain_id: int, source: str, first: int, last: int) -> None:
        if first > last:
            raise ValueError("a range must not end before it starts")
        at = self._at(chain_id, source)
        if [first, last] not in at["replays"]:
            at["replays"].append([first, last])
            self.save()

    def pending_replays(self, chain_id: int, source: str) -> list[tuple[int, int]]:
        return [tuple(r) for r in self._at(chain_id, source)["replays"]]

    def clear_replay(self, chain_id: int, source: str, first: int, last: int) -> None:
        at = self._at(chain_id, source)
        at["replays"] = [r for r in at["replays"] if r != [first, last]]
        self.save()

    def save(self) -> None:
        _put(self.path, self.state)
