"""Decoded events as protocol actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywheel.functions import ids
from tallywheel.functions.fixed import AMOUNT_NAMES, FEE_AGGREGATOR, PA_KINDS, RESERVES, STAKING_KINDS, SWAP_AUTOMATOR, WALLET_NAMES
from tallywheel.functions.portable import first_by_name, first_of
from tallywheel.sources.registry import in_phase

_MAPS = ["indexed_params", "data_params"]


def lookup(names: dict[str, str], column) -> Column:
    """Value of a small fixed mapping; null for other keys."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(table, F.col(column) if isinstance(column, str) else column)


def staking_actions(events: DataFrame, roles: DataFrame) -> DataFrame:
    """No, one or two actions for each event: a migration has a half for the old pool as well.

    Contracts of the payment side (roles that begin with pa_) are left to ``payment_actions``.
    """
    known = events.drop("role").join(roles, F.lower("contract_address") == F.col("role_address")).where(~F.col("role").startswith("pa_"))
    kinds = known.withColumn("kind", lookup(STAKING_KINDS, "event_name")).where("kind IS NOT NULL")
    half = lambda key, role: F.struct(key.alias("action_id"), role.alias("pool_role"))
    base = half(ids.action_id("decoded_event_id", "kind"), F.col("role"))
    old = half(ids.action_id("decoded_event_id", F.lit("migrated_v01_debit")), F.lit("staking_pool_v01"))
    rows = kinds.withColumn("_a", F.explode(F.when(F.col("kind") == "migrated_from_v01", F.array(old, base)).otherwise(F.array(base))))
    amount = F.coalesce(first_of(_MAPS, AMOUNT_NAMES).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return rows.select("_a.action_id", "kind", "chain_id", "block_number", "tx_hash", "log_index", "contract_address", "_a.pool_role", F.lower(first_of(_MAPS, WALLET_NAMES)).alias("wallet"), amount.alias("amount_link"), F.col("event_signature").alias("source_event_signature"), "raw_log_id", "decoded_event_id")


def enrich(actions: DataFrame, phases: DataFrame) -> DataFrame:
    """Actions with their pool's address, its registered role and the ABI version in force."""
    found = in_phase(actions, phases.select("phase_address", "from_block", "to_block", "role", "abi_version"), "contract_address", "block_number")
    return found.select(*actions.columns, F.col("contract_address").alias("pool_address"), F.coalesce("role", "pool_role").alias("registered_role"), F.coalesce("abi_version", F.lit("unknown")).alias("contract_phase_version"))


def payment_actions(events: DataFrame, roles: DataFrame) -> DataFrame:
    known = events.drop("role").join(roles.where(F.col("role").startswith("pa_")), F.lower("contract_address") == F.col("role_address"))
    kinds = known.withColumn("kind", lookup(PA_KINDS, "event_name")).where("kind IS NOT NULL")
    amount = lambda *names: F.coalesce(first_by_name(_MAPS, list(names)).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    text = lambda *names: F.lower(first_by_name(_MAPS, list(names), skip_empty=True))
    rows = kinds.withColumns({"source_token": text("sourceToken", "tokenIn", "token"), "output_token": text("outputToken", "tokenOut", "linkToken"), "source_amount": amount("sourceAmount", "amountIn", "amount", "value"), "_out": amount("outputAmount", "amountOut", "linkAmount"), "counterparty": text("from", "sender", "to", "recipient", "depositor")})
    return rows.select(ids.pa_action_id("decoded_event_id", "kind").alias("action_id"), "kind", "chain_id", "block_number", "tx_hash", "log_index", "contract_address", F.col("role").alias("contract_role"), "source_token", "output_token", "source_amount", F.when(F.col("_out") == 0, F.col("source_amount")).otherwise(F.col("_out")).alias("output_amount"), "counterparty", F.col("event_signature").alias("source_event_signature"), "raw_log_id", "decoded_event_id")


def payment_actions_from_transfers(movements: DataFrame) -> DataFrame:
    """Payment actions told from where tokens went, for contracts whose events aren't in an ABI."""
    kinds = {RESERVES: "pa_reserves_deposit", FEE_AGGREGATOR: "pa_fee_received", SWAP_AUTOMATOR: "pa_service_fee_forwarded"}
    roles = {RESERVES: "pa_reserves", FEE_AGGREGATOR: "pa_fee_aggregator", SWAP_AUTOMATOR: "pa_swap_automator"}
    return movements.where((F.col("amount") > 0) & F.col("to_addr").isin(*kinds)).withColumns({"kind": lookup(kinds, "to_addr"), "contract_role": lookup(roles, "to_addr"), "contract_address": F.col("to_addr"), "counterparty": F.col("from_addr"), "source_amount": F.col("amount"), "output_amount": F.col("amount")})
