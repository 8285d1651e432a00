"""Balanced debit and credit entries for actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywheel.functions import ids


def _posted(rows: DataFrame, debit: Column, credit: Column, amount: Column, entry_id, carry: tuple[str, ...]) -> DataFrame:
    side = lambda i, account, direction: F.struct(F.lit(i).alias("entry_index"), account.alias("account"), F.lit(direction).alias("direction"))
    sides = rows.withColumns({"_d": debit, "_c": credit, "_amount": amount}).where("_d IS NOT NULL AND _c IS NOT NULL AND _amount > 0")
    flat = sides.withColumn("_e", F.explode(F.array(side(0, F.col("_d"), "debit"), side(1, F.col("_c"), "credit"))))
    return flat.select(entry_id("action_id", F.col("_e.entry_index")).alias("entry_id"), "action_id", "_e.entry_index", "_e.account", "_e.direction", F.col("_amount").alias("amount_link"), "chain_id", "block_number", "tx_hash", *carry)


def staking_entries(actions: DataFrame, *carry: str) -> DataFrame:
    """Two entries for each staking action that moves tokens; none for an amount of zero. Columns named in ``carry`` go along."""
    of = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    role, pool = F.col("pool_role"), of(F.col("pool_role"), ":", F.col("contract_address"))
    wallet, rewards = of("wallet:", F.coalesce(F.nullif("wallet", F.lit("")), F.lit("unknown"))), of(F.col("pool_role"), ":rewards")
    old = role == "staking_pool_v01"
    kind = F.col("kind")
    debit = F.when(kind == "stake", wallet).when(kind == "unstake_finalized", pool).when(kind == "reward_claimed", rewards).when(kind == "reward_accrued", F.lit("reward_funder")).when(kind == "slashed", pool).when((kind == "migrated_from_v01") & old, pool).when(kind == "migrated_from_v01", F.lit("migration_proxy"))
    credit = F.when(kind == "stake", pool).when(kind == "unstake_finalized", wallet).when(kind == "reward_claimed", wallet).when(kind == "reward_accrued", rewards).when(kind == "slashed", of(role, ":forfeiture_sink")).when((kind == "migrated_from_v01") & old, F.lit("migration_proxy")).when(kind == "migrated_from_v01", pool)
    return _posted(actions, debit, credit, F.col("amount_link"), ids.ledger_entry_id, carry)


def payment_entries(actions: DataFrame, *carry: str) -> DataFrame:
    of = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    pool, other = of(F.col("contract_role"), ":", F.col("contract_address")), F.coalesce(F.nullif("counterparty", F.lit("")), F.lit("unknown"))
    token = F.coalesce(F.nullif("output_token", F.lit("")), F.lit("link")) if "output_token" in actions.columns else F.lit("link")
    kind = F.col("kind")
    debit = F.when(kind == "pa_fee_received", of("service_contract:", other)).when(kind == "pa_swap_executed", pool).when(kind == "pa_reserves_deposit", of("upstream:", other)).when(kind == "pa_service_fee_forwarded", pool)
    credit = F.when(kind == "pa_fee_received", pool).when(kind == "pa_swap_executed", of("pa_reserves:", token)).when(kind == "pa_reserves_deposit", pool).when(kind == "pa_service_fee_forwarded", of("forwarded_to:", other))
    either = F.when(F.col("output_amount") > 0, F.col("output_amount")).otherwise(F.col("source_amount"))
    amount = F.when(kind == "pa_swap_executed", F.col("output_amount")).when(kind == "pa_reserves_deposit", either).otherwise(F.col("source_amount"))
    return _posted(actions, debit, credit, amount, ids.pa_ledger_entry_id, carry)


def balance_by(entries: DataFrame, *keys: str) -> DataFrame:
    """Debits, credits and their difference by keys."""
    total = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount_link"))), F.lit(0))
    return entries.groupBy(*keys).agg(total("debit").alias("total_debit"), total("credit").alias("total_credit")).withColumn("delta", F.col("total_debit") - F.col("total_credit")).withColumn("is_balanced", F.col("delta") == 0)


def unbalanced(entries: DataFrame) -> DataFrame:
    return balance_by(entries, "chain_id", "tx_hash").where("delta <> 0")
