"""What a query will read, told from the footers of the Parquet files that its scans select."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCHEMA = "bytes long"


def _leaves(plan) -> Iterator:
    """Leaves of a physical plan as it is before it runs, those of its subqueries included."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _leaves(plan.initialPlan())
        return
    found = plan.collectLeaves()
    for i in range(found.size()):
        leaf = found.apply(i)
        yield from _leaves(leaf) if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else (leaf,)
    inner = plan.subqueriesAll()
    once = {inner.apply(i).name(): inner.apply(i) for i in range(inner.size())}  # a filter that the scan has too names its subquery twice
    for sub in once.values():
        if not sub.getClass().getSimpleName().startswith("Reused"):
            yield from _leaves(sub.child())


def _selected(spark: SparkSession, scan) -> list[tuple[str, int]]:
    """Path and size of the files that a scan's partition filters leave; filters known only at run time leave all."""
    jvm = spark._jvm
    known = jvm.java.util.ArrayList()
    filters = scan.partitionFilters()
    for i in range(filters.size()):
        if "dynamicpruning" not in filters.apply(i).toString() and "subquery" not in filters.apply(i).toString():
            known.add(filters.apply(i))
    to_seq = jvm.scala.jdk.javaapi.CollectionConverters.asScala
    folders = scan.relation().location().listFiles(to_seq(known).toSeq(), scan.dataFilters())
    out = []
    for i in range(folders.size()):
        files = folders.apply(i).files()
        out += [(files.apply(j).getPath().toString(), files.apply(j).getLen()) for j in range(files.size())]
    return out


def _paths(kind, above: str = "") -> list[str]:
    """Dotted names of the columns that a read schema needs, down through plain structs."""
    if not isinstance(kind, StructType):
        return [above]
    return [p for f in kind.fields for p in _paths(f.dataType, f"{above}.{f.name}" if above else f.name)]


def _footer_bytes(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Size in the file of the chunks of ``columns``, for each file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    def size(path: str) -> int:
        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_file(at) as f:
            meta = pq.ParquetFile(f).metadata
        wanted = [i for i in range(meta.num_columns) if any(f"{meta.schema.column(i).path}.".startswith(f"{c}.") for c in columns)]
        return sum(meta.row_group(g).column(i).total_compressed_size for g in range(meta.num_row_groups) for i in wanted)

    for b in batches:
        yield pd.DataFrame({"bytes": [size(p) for p in b["path"]]})


def scan_bytes(df: DataFrame, enough: int | None = None, files_per_task: int = 256) -> int:
    """Bytes that a query's scans will take from storage: the needed columns' chunks in the files that are left by partition filters.

    Footers are read by tasks, ``files_per_task`` each; the file list, which Spark holds on the driver anyway, and
    one sum come to the driver. Row groups that statistics rule out are counted, so this is an upper bound for
    filtered scans. Files of other formats count whole, cached tables not at all, and other sources by
    Catalyst's estimate. If whole files come to ``enough`` or less, their size is returned and no footer is read.
    """
    spark = df.sparkSession
    scans, total = [], 0
    for leaf in _leaves(df._jdf.queryExecution().executedPlan()):
        kind = leaf.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            columns = _paths(StructType.fromJson(json.loads(leaf.requiredSchema().json())))
            files = _selected(spark, leaf)
            if leaf.relation().fileFormat().toString() == "Parquet":
                scans.append((columns, files))
            else:
                total += sum(n for _, n in files)
        elif kind not in ("InMemoryTableScanExec", "LocalTableScanExec", "OneRowRelationExec") and leaf.logicalLink().isDefined():
            total += int(str(leaf.logicalLink().get().stats().sizeInBytes()))
    whole = total + sum(n for _, files in scans for _, n in files)
    if enough is not None and whole <= enough:
        return whole
    for columns, files in scans:
        if columns and files:
            listed = spark.createDataFrame([(p,) for p, _ in files], "path string").repartition(-(-len(files) // files_per_task))
            sizes = listed.mapInPandas(lambda batches, c=columns: _footer_bytes(batches, c), _SCHEMA)
            total += sizes.groupBy().sum("bytes").first()[0]
    return total

