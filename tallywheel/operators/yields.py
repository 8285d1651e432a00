"""Yields, fees and reward distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.functions.fixed import SERVICES, YEAR_SECONDS
from tallywheel.operators.actions import lookup


def time_weighted_principal(stakes: DataFrame, snapshot: int, *keys: str) -> DataFrame:
    """Principal times seconds held until the snapshot, summed; an end of zero or null is open."""
    end = F.least(F.coalesce(F.nullif("end_unix", F.lit(0)), F.lit(snapshot)), F.lit(snapshot))
    held = end - F.col("start_unix")
    return stakes.where((held > 0) & (F.col("principal") > 0)).groupBy(*keys).agg(F.sum(F.col("principal").cast("decimal(28,0)") * held.cast("decimal(10,0)")).cast("decimal(38,0)").alias("principal_seconds"))


def realized_apy(stakes: DataFrame, rewards: DataFrame, snapshot: int, *keys: str) -> DataFrame:
    """Rewards up to the snapshot per year of principal, in double precision; 0 without principal."""
    held = time_weighted_principal(stakes, snapshot, *keys)
    paid = rewards.where(F.col("ts_unix") <= snapshot).groupBy(*keys).agg(F.sum("amount_link").alias("rewards"))
    both = held.join(paid, list(keys), "full_outer") if keys else held.crossJoin(paid)
    rate = F.when(F.col("principal_seconds") > 0, F.coalesce("rewards", F.lit(0)).cast("double") * YEAR_SECONDS / F.col("principal_seconds").cast("double")).otherwise(F.lit(0.0))
    return both.select(*keys, F.coalesce("principal_seconds", F.lit(0)).alias("principal_seconds"), F.coalesce("rewards", F.lit(0)).alias("rewards"), rate.alias("realized_apy"))


def service(address):
    return F.coalesce(lookup(SERVICES, F.lower(F.col(address) if isinstance(address, str) else address)), F.lit("other"))


def attribute_fees(actions: DataFrame) -> DataFrame:
    """Fees by service and payer, the largest first; actions without a payer are left out."""
    amount = F.coalesce("output_amount", "amount_link") if "amount_link" in actions.columns else F.col("output_amount")
    payer = F.lower("counterparty")
    return actions.where(F.coalesce(F.col("counterparty"), F.lit("")) != "").groupBy(service(payer).alias("service"), payer.alias("source_address")).agg(F.sum(amount).alias("amount"), F.count("*").alias("actions")).orderBy(F.desc("amount"), "service", "source_address")


def distribution(distributed: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """Distributed, claimed, their ratio (0 if nothing was distributed) and what is unclaimed."""
    d = distributed.groupBy(key).agg(F.sum("amount_link").alias("distributed"))
    c = claimed.groupBy(key).agg(F.sum("amount_link").alias("claimed"))
    both = d.join(c, key, "full_outer").withColumns({"distributed": F.coalesce("distributed", F.lit(0)), "claimed": F.coalesce("claimed", F.lit(0))})
    return both.withColumns({"efficiency": F.coalesce(F.try_divide(F.col("claimed").cast("double"), F.col("distributed").cast("double")), F.lit(0.0)), "unclaimed": F.col("distributed") - F.col("claimed")})
