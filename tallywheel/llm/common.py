"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words in every contract here.
BLANKS = " \t\n\x0b\x0c\r"
BLANKS_RE = "[\\x20\\x09-\\x0D]"
#: Spark's setting by which a query that has ended leaves no shuffle files.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and all runs on one machine (tests) a folder of our own is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("tallywheel.scratch", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallywheel-")
        spark.conf.set("tallywheel.scratch", found)
    return found.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later reader needs."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tallywheel-{label}-{uuid.uuid4().hex[:12]}"


def settled_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and the folder, which ``removed`` takes away.

    This cuts lineage in a way that survives the loss of any executor. What was shuffled for it goes when the
    table is written, as nobody reads it again; else it would lie there until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    return spark.read.schema(df.schema).parquet(path), path


def settled(df: DataFrame, label: str) -> DataFrame:
    """As ``settled_at``, for tables that stay as long as the result may be read."""
    return settled_at(df, label)[0]


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions that this session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with lines below before it where the table has such a column already, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def squeezed(text):
    """``text`` without any of the six blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")
