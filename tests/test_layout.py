"""What scans will read by the files' footers, and joins of bucketed tables that shuffle nothing."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tallywheel.operators import matching, traces
from tallywheel.plans import fixtures as X
from tallywheel.sources import scans, store
from tallywheel.sources.footers import scan_bytes

DIR = "/root/testdata/sf0.01"
on_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def bytes_read(spark):
    """Bytes that all stages so far have read, by Spark's own counters."""
    time.sleep(1)  # the listener is behind the tasks
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


@pytest.fixture
def copies(spark, tmp_path):
    """Two tables of the tests with more than a few rows, written as one file each."""
    spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), F.rand(3).alias("x")).coalesce(1).write.parquet(str(tmp_path / "plain"))
    nested = F.struct(F.sha2(F.col("id").cast("string"), 256).alias("a"), F.rand(5).alias("b")).alias("s")
    spark.range(300_000).select((F.col("id") % 3).alias("day"), nested, F.rand(4).alias("z")).repartition("day").write.partitionBy("day").parquet(str(tmp_path / "parted"))
    return spark.read.parquet(str(tmp_path / "plain")), spark.read.parquet(str(tmp_path / "parted"))


def test_bytes_by_footers_are_the_bytes_read(spark, copies):
    plain, parted = copies
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.hadoop.vectored.io.enabled", "false")  # whose reads aren't counted on a local disk
    for df in (plain.agg(F.sum("x")), plain.agg(F.max("h"), F.max("id")), parted.where("day = 1").agg(F.max("s.a")), parted.agg(F.sum("z"))):
        told = scan_bytes(df)
        before = bytes_read(spark)
        df.collect()
        assert told == pytest.approx(bytes_read(spark) - before, rel=0.1)


def test_bytes_of_pruned_columns_folders_and_subqueries(spark, copies):
    plain, parted = copies
    narrow, wide = scan_bytes(plain.agg(F.sum("x"))), scan_bytes(plain.agg(F.sum("x"), F.max("h")))
    assert narrow * 5 < wide
    one = scan_bytes(parted.where("day = 1").agg(F.sum("z")))
    assert one * 3 == pytest.approx(scan_bytes(parted.agg(F.sum("z"))), rel=0.01)
    assert scan_bytes(parted.agg(F.max("s.b"))) < scan_bytes(parted.agg(F.max("s.a")))
    plain.createOrReplaceTempView("plain_rows")
    assert scan_bytes(spark.sql("SELECT max(x) FROM plain_rows WHERE x > (SELECT avg(x) FROM plain_rows)")) == 2 * narrow
    assert scan_bytes(plain.where("false")) == 0 and scan_bytes(plain.groupBy().count()) == 0


def test_guard_raises_before_reading(spark, copies):
    plain, _ = copies
    narrow = scan_bytes(plain.agg(F.sum("x")))
    assert scans.guarded(plain.agg(F.sum("x")), narrow).count() == 1
    before = bytes_read(spark)
    with pytest.raises(scans.CostError):
        scans.guarded(plain.agg(F.sum("x")), narrow - 1)
    assert bytes_read(spark) - before < 1000


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.partition("== Initial Plan ==")[0].count("Exchange hashpartitioning")


@on_tables
def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    base, b = X.base(spark, DIR), 8
    save = lambda df, name: store.save_bucketed(df, f"bucketed_{name}", ["tx_hash"], b, str(tmp_path / name))
    frame = base.select("tx_hash", "block_number", "event_id", F.col("contract_address").alias("to_address"), (F.col("event_id") % 7 != 0).cast("int").alias("status"), F.when(F.col("event_id") % 7 == 0, "reverted").alias("error"), F.lit("0xa9059cbb").alias("input"), F.when(F.col("event_id") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("event_id") % 5).cast("int"))).alias("trace_address"))
    a, m = X.small_actions(spark, DIR), X.movements(spark, DIR)
    pool = lambda n: "0x" + format(4096 + n, "040x")
    run = {
        "matching": lambda a, m, f: matching.match_actions(a, m, lowered=True),
        "transfers": lambda a, m, f: scans.internal_transfers(f, pool(2), [pool(1)], 0, 10**9).select("event_id"),
        "ancestors": lambda a, m, f: traces.with_ancestor_success(f).select("event_id", "parent_success"),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, stored = (a, m, frame), (save(a, "actions"), save(m, "movements"), save(frame, "frames"))
        for name, f in run.items():
            assert exchanges(f(*plain)) > 0, name
            assert exchanges(f(*stored)) == 0, name
            assert sorted(map(str, f(*plain).collect())) == sorted(map(str, f(*stored).collect())), name
        files = [x for x in os.listdir(tmp_path / "actions") if x.endswith(".parquet")]
        assert len(files) == b  # one for each bucket, whatever the number of tasks before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("actions", "movements", "frames"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")
