"""Balance snapshots against movements, and proxies by their storage words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywheel.functions.hexes import is_proxy_marker, word_to_address
from tallywheel.operators.movements import balance_delta, net_by_address


def verify_balance(snapshots: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` (holder_address, block_number, prior_block, expected_delta) with the observed change, its difference and is_consistent."""
    at = snapshots.select("holder_address", "block_number", F.col("balance").alias("_now"))
    before = snapshots.select("holder_address", F.col("block_number").alias("prior_block"), F.col("balance").alias("_before"))
    found = expected.join(at, ["holder_address", "block_number"], "left").join(before, ["holder_address", "prior_block"], "left")
    found = found.withColumn("observed_delta", F.col("_now") - F.col("_before")).withColumn("difference", F.col("observed_delta") - F.col("expected_delta"))
    return found.withColumn("is_consistent", F.col("difference") == 0).drop("_now", "_before")


def reconcile_pools(snapshots: DataFrame, movements: DataFrame, from_block: int, to_block: int) -> DataFrame:
    """For each holder: net movement in the range against the change from the block before it."""
    ends = snapshots.where(F.col("block_number").isin(from_block - 1, to_block)).groupBy("holder_address").agg(F.max(F.when(F.col("block_number") == to_block, F.col("balance"))).alias("_now"), F.max(F.when(F.col("block_number") == from_block - 1, F.col("balance"))).alias("_before"))
    net = balance_delta(movements, from_block, to_block).withColumnRenamed("address", "holder_address")
    found = ends.join(net, "holder_address", "left").withColumn("net_amount", F.coalesce("net_amount", F.lit(0)))
    return found.select("holder_address", (F.col("_now") - F.col("_before")).alias("observed_delta"), "net_amount", (F.col("_now") - F.col("_before") - F.col("net_amount")).alias("difference"))


def pool_balance_deltas(snapshots: DataFrame, movements: DataFrame, whole_range: bool = False) -> DataFrame:
    """Change between a holder's snapshots beside its net movement in the later one's block.

    ``whole_range`` takes the movements of all blocks since the earlier snapshot instead.
    """
    w = Window.partitionBy("holder_address").orderBy("block_number")
    steps = snapshots.select(F.col("holder_address").alias("pool_address"), "block_number", "balance", (F.col("balance") - F.lag("balance").over(w)).alias("observed_delta"), F.lag("block_number").over(w).alias("prev_block")).where("prev_block IS NOT NULL")
    net = net_by_address(movements, "block_number").withColumnsRenamed({"address": "pool_address", "net_amount": "_net"})
    if whole_range:
        net = net.withColumnRenamed("block_number", "_b")
        joined = steps.join(net, (steps["pool_address"] == net["pool_address"]) & (F.col("_b") > F.col("prev_block")) & (F.col("_b") <= F.col("block_number")), "left").drop(net["pool_address"])
        return joined.groupBy("pool_address", "block_number", "balance", "observed_delta", "prev_block").agg(F.coalesce(F.sum("_net"), F.lit(0)).alias("net_movement_amount"))
    return steps.join(net, ["pool_address", "block_number"], "left").withColumn("net_movement_amount", F.coalesce("_net", F.lit(0))).drop("_net")


def implementations(words: DataFrame) -> DataFrame:
    """proxy address to its implementation: the implementation slot, else the beacon slot, else null."""
    pick = lambda c: F.when(is_proxy_marker(c), word_to_address(c))
    return words.withColumn("implementation", F.coalesce(pick("implementation_slot"), pick("beacon_slot")))


def reserve_inflows(transfers: DataFrame, token: str, reserves: str) -> DataFrame:
    return transfers.where((F.col("token_address") == token) & (F.col("to_addr") == reserves))


def inflow_paths(inflows: DataFrame, frames: DataFrame) -> DataFrame:
    """``inflows`` with the callees on the way from the root to their frame, equal neighbours once."""
    steps = inflows.select("tx_hash", "trace_address", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("trace_address")), lambda n: F.slice("trace_address", F.lit(1), n))).alias("_i", "_prefix"))
    at = frames.select("tx_hash", F.col("trace_address").alias("_prefix"), F.lower("to_address").alias("_to"))
    way = steps.join(at, ["tx_hash", "_prefix"]).groupBy("tx_hash", "trace_address").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_to"))), lambda x: x["_to"]).alias("_way"))
    once = F.filter("_way", lambda x, i: (i == 0) | (x != F.get("_way", i - 1)))
    return inflows.join(way.select("tx_hash", "trace_address", once.alias("path")), ["tx_hash", "trace_address"], "left")


def inflow_per_transaction(inflows: DataFrame) -> DataFrame:
    return inflows.groupBy("tx_hash").agg(F.sum("amount").alias("inflow"))
