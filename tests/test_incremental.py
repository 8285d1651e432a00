"""Models that are brought up to date equal those built whole, after new blocks, late rows and a reorganisation."""

import os

import pytest
from pyspark.sql import functions as F

from tallywheel.plans import marts
from tallywheel.plans.incremental import Incremental
from tallywheel.plans.models import growing_inputs
from tallywheel.sources.store import Table

DIR = "/root/testdata/sf0.001"
KEYED = [name for name, (_, _, key, _) in marts.MODELS.items() if key]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The inputs as tables of their own, so that each is computed once."""
    root = tmp_path_factory.mktemp("inputs")
    for name, rows in growing_inputs(spark, DIR).items():
        rows.write.parquet(str(root / name))
    return {p.name: spark.read.parquet(str(p)) for p in root.iterdir()}


def rows_of(df):
    columns = sorted(c for c in df.columns if c != "stretch")
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def same(state, inputs, depth):
    whole = marts.build(inputs, KEYED, depth)
    for name in KEYED:
        assert rows_of(state.read(name)) == rows_of(whole[name]), name


def test_all_keyed_models(spark, inputs, tmp_path):
    assert len(KEYED) == 10
    state = Incremental(spark, str(tmp_path), span=7, overlap=5, depth=4)
    cut = lambda n: {k: v.where(F.col("block_number") <= n) for k, v in inputs.items()}
    first = dict(state.run(cut(80)))
    second = dict(state.run(inputs))
    same(state, inputs, 4)
    assert state.first_block() == 99 - 4 + 1 - 5
    for name in ("int_economic_actions", "int_token_movements", "int_action_movement_recon", "ledger_entries", "staking_link_flows"):
        assert second[name] < 0.5 * first[name], name  # 20 of 100 blocks are new
    third = dict(state.run(inputs))
    assert third["int_token_movements"] < second["int_token_movements"]


def test_late_rows_and_reorganisation(spark, inputs, tmp_path):
    """Rows that come late, vanish or change within the overlap, and a replay from further back."""
    state = Incremental(spark, str(tmp_path), span=10, overlap=15, depth=4)
    late = (F.col("block_number") == 90) & F.lit(True)
    state.run({k: v.where(~late) for k, v in inputs.items()})
    state.run(inputs)
    gone = dict(inputs)
    gone["economic_actions"] = inputs["economic_actions"].where(~F.col("block_number").isin(88, 93))
    gone["balance_snapshots"] = inputs["balance_snapshots"].withColumn("balance", F.when(F.col("block_number") == 91, F.col("balance") * 50).otherwise(F.col("balance")))
    gone["blocks"] = inputs["blocks"].withColumn("timestamp", F.when(F.col("block_number").between(87, 89), F.col("timestamp") + 86400 * 40).otherwise(F.col("timestamp")))
    state.run(gone)
    same(state, gone, 4)
    deep = dict(inputs)
    deep["economic_actions"] = inputs["economic_actions"].where("block_number NOT BETWEEN 20 AND 30")
    state.run(deep, first=20)
    same(state, deep, 4)


def test_a_range_is_no_task(spark, tmp_path):
    """A range with many rows is written by several tasks, whatever the number of ranges; all rows are there."""
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.files.maxPartitionBytes": "64k"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    rows = spark.range(60_000).selectExpr("id AS block_number", "sha2(string(id), 256) AS h")
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        table = Table(spark, str(tmp_path / "t"), [], "block_number", 100_000)
        table.exchange(spark.read.parquet(str(tmp_path / "in")), lambda old: old, lambda r: True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    (folder,) = table.folders().values()
    assert len(list((tmp_path / "t" / folder).glob("*.parquet"))) > 4
    assert table.read().count() == table.read().distinct().count() == 60_000


def test_nothing_to_read(spark, tmp_path):
    with pytest.raises(ValueError, match="no run"):
        Incremental(spark, str(tmp_path)).read("ledger_entries")
