"""The model graph: raw tables to staging, intermediate, marts and analytics, as functions of tables.

``build`` runs the functions in the order of what they need. Tables given as input stand for the raw
layer and for decoded and reconciled data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.functions import ids
from tallywheel.functions.fixed import STATUSES, TOKEN, YEAR_SECONDS
from tallywheel.functions.portable import date_from_seconds, safe_divide, week_start
from tallywheel.operators.balances import pool_balance_deltas
from tallywheel.operators.blocks import canonical_blocks, on_canonical, shadow_blocks
from tallywheel.operators.yields import service

MODELS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...] | None, Callable]] = {}
STAKING_EVENTS = ("Staked", "UnstakeRequested", "Unstaked", "RewardClaimed", "RewardAdded", "Slashed", "Migrated", "PoolConfigChanged")
STAKING_METHODS = ("stake", "unstake", "claimReward", "migrate", "unbond")


def model(layer: str, *needs: str, key: tuple[str, ...] | None = None):
    """Register a function of the tables it needs; ``key`` marks a model that is merged by key."""

    def add(f: Callable) -> Callable:
        MODELS[f.__name__] = (layer, needs, key, f)
        return f

    return add


def _count(status: str):
    return F.count_if(F.col("status") == status)


@model("staging", "blocks")
def stg_canonical_blocks(blocks: DataFrame, depth: int = 64) -> DataFrame:
    return canonical_blocks(blocks, depth)


@model("staging", "blocks")
def stg_shadow_tip_blocks(blocks: DataFrame, depth: int = 64) -> DataFrame:
    return shadow_blocks(blocks, depth)


@model("staging", "decoded_events", "stg_canonical_blocks")
def stg_staking_events(events: DataFrame, canonical: DataFrame) -> DataFrame:
    return on_canonical(events.where(F.col("event_name").isin(*STAKING_EVENTS)), canonical)


@model("staging", "decoded_events", "stg_canonical_blocks")
def stg_link_transfers(events: DataFrame, canonical: DataFrame) -> DataFrame:
    return on_canonical(events.where((F.col("event_name") == "Transfer") & (F.lower("contract_address") == TOKEN)), canonical)


@model("staging", "decoded_trace_calls", "stg_canonical_blocks")
def stg_decoded_trace_calls(calls: DataFrame, canonical: DataFrame) -> DataFrame:
    return on_canonical(calls, canonical)


@model("staging", "stg_decoded_trace_calls")
def stg_staking_calls(calls: DataFrame) -> DataFrame:
    return calls.where((F.size("trace_address") == 0) & F.col("method_name").isin(*STAKING_METHODS))


@model("staging", "balance_snapshots")
def stg_balance_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumns({"token_address": F.lower("token_address"), "holder_address": F.lower("holder_address")})


@model("staging", "edges")
def stg_action_movement_edges(edges: DataFrame) -> DataFrame:
    return edges


@model("intermediate", "economic_actions", "stg_canonical_blocks", key=("action_id",))
def int_economic_actions(actions: DataFrame, canonical: DataFrame) -> DataFrame:
    return on_canonical(actions, canonical).withColumns({"contract_address": F.lower("contract_address"), "wallet": F.lower("wallet")})


@model("intermediate", "token_movements", key=("movement_id",))
def int_token_movements(movements: DataFrame) -> DataFrame:
    return movements.withColumns({c: F.lower(c) for c in ("token_address", "from_addr", "to_addr", "tx_hash")})


@model("intermediate", "stg_action_movement_edges", key=("tx_hash",))
def int_action_movement_recon(edges: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("status").isin("unmatched", "unexpected", "ambiguous"))
    status = F.when(bad > 0, "fail").when(_count("partial") > 0, "warn").otherwise("ok")
    return edges.groupBy("tx_hash", "chain_id", "block_number").agg(*[_count(s).alias(f"{s}_count") for s in STATUSES], F.count("*").alias("edge_count"), status.alias("overall_status"), F.max("run_partition_id").alias("run_partition_id"))


@model("intermediate", "stg_balance_snapshots", "int_token_movements", key=("pool_address", "block_number"))
def int_pool_balance_deltas(snapshots: DataFrame, movements: DataFrame) -> DataFrame:
    return pool_balance_deltas(snapshots.where(F.col("token_address") == TOKEN), movements)


@model("intermediate", "decode_results", key=("raw_id",))
def int_decode_failures(results: DataFrame) -> DataFrame:
    return results.where("NOT success")


@model("intermediate", "int_decode_failures")
def int_unknown_signatures(failures: DataFrame) -> DataFrame:
    """Unknown topics by contract, with the five least hashes of their transactions."""
    rows = failures.where("failure_reason = 'unknown_topic'")
    totals = rows.groupBy("contract_address", "topic0").agg(F.count("*").alias("occurrences"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))
    from pyspark.sql import Window

    least = rows.where("tx_hash IS NOT NULL").select("contract_address", "topic0", "tx_hash").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("contract_address", "topic0").orderBy("tx_hash"))).where("_n <= 5")
    samples = least.groupBy("contract_address", "topic0").agg(F.array_sort(F.collect_list("tx_hash")).alias("sample_tx_hashes"))
    return totals.join(samples, ["contract_address", "topic0"], "left")


@model("marts", "ledger", "stg_canonical_blocks", key=("entry_id",))
def ledger_entries(entries: DataFrame, canonical: DataFrame) -> DataFrame:
    return on_canonical(entries, canonical)


@model("marts", "int_economic_actions", "int_action_movement_recon", key=("event_id",))
def staking_link_flows(actions: DataFrame, recon: DataFrame) -> DataFrame:
    status = F.when(F.col("overall_status") == "ok", "exact").when(F.col("overall_status") == "warn", "partial").otherwise("unmatched")
    found = actions.where("wallet IS NOT NULL").join(recon.select("tx_hash", "overall_status"), "tx_hash", "left")
    return found.select(F.col("decoded_event_id").alias("event_id"), "wallet", F.col("kind").alias("flow_type"), "amount_link", "tx_hash", "block_number", status.alias("reconciliation_status"), "run_partition_id")


def dated(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows with the day of their block; by block number alone, as the marts do."""
    return rows.join(canonical.select("block_number", date_from_seconds("timestamp").alias("snapshot_date"), "timestamp"), "block_number")


def _sum_of(column: str, kind: str):
    return F.coalesce(F.sum(F.when(F.col(column) == kind, F.col("amount_link"))), F.lit(0))


def wallet_days(flows: DataFrame) -> DataFrame:
    net = F.when(F.col("flow_type") == "stake", -F.col("amount_link")).when(F.col("flow_type").isin("unstake_finalized", "reward_claimed"), F.col("amount_link")).otherwise(F.lit(0))
    return flows.groupBy("wallet", "snapshot_date").agg(_sum_of("flow_type", "stake").alias("total_staked"), _sum_of("flow_type", "reward_claimed").alias("total_claimed"), _sum_of("flow_type", "slashed").alias("total_slashed"), F.sum(net).alias("net_flow"), F.max("run_partition_id").alias("run_partition_id"))


@model("marts", "staking_link_flows", "stg_canonical_blocks", key=("wallet", "snapshot_date"))
def wallet_economics(flows: DataFrame, canonical: DataFrame) -> DataFrame:
    return wallet_days(dated(flows, canonical))


def pool_days(actions: DataFrame) -> DataFrame:
    return actions.groupBy(F.col("contract_address").alias("pool_address"), "snapshot_date").agg(_sum_of("kind", "reward_accrued").alias("rewards_distributed"), _sum_of("kind", "slashed").alias("slashes_applied"), F.max("run_partition_id").alias("run_partition_id"))


def pool_tops(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.col("token_address") == TOKEN).groupBy(F.col("holder_address").alias("pool_address")).agg(F.max("balance").alias("_top"))


def with_tops(days: DataFrame, tops: DataFrame) -> DataFrame:
    return days.join(tops, "pool_address", "left").withColumn("end_of_day_balance", F.coalesce("_top", F.lit(0))).drop("_top")


@model("marts", "int_economic_actions", "stg_balance_snapshots", "stg_canonical_blocks", key=("pool_address", "snapshot_date"))
def pool_economics(actions: DataFrame, snapshots: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rewards and slashes by pool and day; the balance is the highest snapshot of all time."""
    return with_tops(pool_days(dated(actions, canonical)), pool_tops(snapshots))


_ORDER = ("exact", "partial", "unmatched", "not_expected", "unexpected", "ambiguous")


def edge_counts(edges: DataFrame, *by) -> DataFrame:
    """Edges of each chain by status; finer counts can be summed by ``summed_counts``."""
    return edges.groupBy("chain_id", *by).agg(F.min("block_number").alias("block_range_start"), F.max("block_number").alias("block_range_end"), F.count("*").alias("_n"), *[_count(s).alias(f"_{s}") for s in _ORDER], F.max("run_partition_id").alias("run_partition_id"))


def summed_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("chain_id").agg(F.min("block_range_start").alias("block_range_start"), F.max("block_range_end").alias("block_range_end"), *[F.sum(c).alias(c) for c in ("_n", *(f"_{s}" for s in _ORDER))], F.max("run_partition_id").alias("run_partition_id"))


def status_of_counts(counts: DataFrame, canonical: DataFrame) -> DataFrame:
    text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{s}":'), F.col(f"_{s}").cast("string")) for s in _ORDER]), F.lit("}"))
    on = canonical.select("chain_id", F.col("block_number").alias("block_range_end"))
    return counts.join(on, ["chain_id", "block_range_end"], "left_semi").select(ids.surrogate_key("chain_id", "block_range_start", "block_range_end").alias("partition_id"), "chain_id", "block_range_start", "block_range_end", safe_divide(F.col("_exact") + F.col("_not_expected"), "_n").alias("pass_rate"), text.alias("counts_by_status"), "run_partition_id")


@model("marts", "stg_action_movement_edges", "stg_canonical_blocks", key=("partition_id",))
def reconciliation_status(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    return status_of_counts(edge_counts(edges), canonical)


@model("analytics", "staking_link_flows", "stg_canonical_blocks")
def apy_realized_by_pool(flows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Principal changes and rewards by day, and their ratio over a year; stakes and rewards of one time meet each other."""
    rows = dated(flows, canonical)
    delta = F.when(F.col("flow_type") == "stake", F.col("amount_link")).otherwise(-F.col("amount_link"))
    stakes = rows.where(F.col("flow_type").isin("stake", "unstake_finalized")).select("timestamp", delta.alias("principal_delta"))
    rewards = rows.where("flow_type = 'reward_claimed'").select("timestamp", F.col("amount_link").alias("reward"))
    agg = canonical.select("timestamp").join(stakes, "timestamp", "left").join(rewards, "timestamp", "left").groupBy(date_from_seconds("timestamp").alias("snapshot_date")).agg(F.coalesce(F.sum("principal_delta"), F.lit(0)).alias("net_principal_delta"), F.coalesce(F.sum("reward"), F.lit(0)).alias("rewards_distributed"))
    rate = F.try_divide(F.col("rewards_distributed").cast("double") * F.lit(float(YEAR_SECONDS)), F.col("net_principal_delta").cast("double"))
    return agg.withColumn("reward_yield_proxy_annualized", rate)


@model("analytics", "ledger_entries", "stg_canonical_blocks")
def fee_attribution_by_source(entries: DataFrame, canonical: DataFrame) -> DataFrame:
    rows = dated(entries.where((F.col("direction") == "debit") & F.col("account").startswith("service_contract:")), canonical)
    payer = F.regexp_replace("account", "^[^:]*:", "")
    return rows.groupBy("snapshot_date", service(payer).alias("service"), payer.alias("source_address")).agg(F.sum("amount_link").alias("inflow_link"), F.count_distinct("tx_hash").alias("tx_count"))


@model("analytics", "ledger_entries", "stg_canonical_blocks")
def staker_reward_sustainability(entries: DataFrame, canonical: DataFrame) -> DataFrame:
    credits = dated(entries.where("direction = 'credit'"), canonical)
    rewards = credits.where(F.col("account").endswith(":rewards")).groupBy("snapshot_date").agg(F.sum("amount_link").alias("_r"))
    reserves = credits.where(F.col("account").startswith("pa_reserves:")).groupBy("snapshot_date").agg(F.sum("amount_link").alias("_v"))
    both = rewards.join(reserves, "snapshot_date", "full_outer").select("snapshot_date", F.coalesce("_r", F.lit(0)).alias("rewards_distributed"), F.coalesce("_v", F.lit(0)).alias("reserves_inflow"))
    return both.withColumn("rewards_to_reserves_ratio", safe_divide("rewards_distributed", "reserves_inflow"))


@model("analytics", "ledger_entries", "stg_canonical_blocks")
def weekly_reserve_accumulation(entries: DataFrame, canonical: DataFrame) -> DataFrame:
    """Credits to the reserves by Monday week, and whether their transaction also touched the fee aggregator."""
    fee = entries.where(F.col("account").startswith("pa_fee_aggregator:")).select("tx_hash", F.lit(True).alias("_fee")).distinct()
    rows = dated(entries.where(F.col("account").startswith("pa_reserves:")), canonical).join(fee, "tx_hash", "left")
    return rows.groupBy(week_start("snapshot_date").alias("week_start"), F.when(F.col("_fee"), "pa_fee_inflow").otherwise("other_inflow").alias("inflow_source")).agg(F.coalesce(F.sum(F.when(F.col("direction") == "credit", F.col("amount_link"))), F.lit(0)).alias("link_inflow"), F.count_distinct("tx_hash").alias("tx_count"))


def order(wanted: list[str] | None = None) -> list[str]:
    """Names of the models so that each comes after those it needs."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in MODELS and name not in done:
            for n in MODELS[name][1]:
                visit(n)
            done.append(name)

    for name in wanted or list(MODELS):
        visit(name)
    return done


def build(inputs: dict[str, DataFrame], wanted: list[str] | None = None, depth: int = 64) -> dict[str, DataFrame]:
    """All models (or those wanted) over the input tables."""
    tables = dict(inputs)
    for name in order(wanted):
        _, needs, _, f = MODELS[name]
        if all(n in tables for n in needs):
            args = [tables[n] for n in needs]
            tables[name] = f(*args, depth) if needs == ("blocks",) else f(*args)
    return tables


def layering_problems() -> list[str]:
    """Analytics may read marts and canonical blocks only."""
    return [f"{name} reads {n}" for name, (layer, needs, _, _) in MODELS.items() if layer == "analytics" for n in needs if n != "stg_canonical_blocks" and MODELS.get(n, ("raw",))[0] != "marts"]


