"""Token movements from logs and from traces, and one set from both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywheel.functions import ids
from tallywheel.functions.fixed import TRANSFER_TOPIC

COLUMNS = ["movement_id", "chain_id", "block_number", "tx_hash", "token_address", "from_addr", "to_addr", "amount", "evidence_ids", "source_priority", "is_canonical", "position"]


def from_logs(events: DataFrame) -> DataFrame:
    """Movements of decoded transfer events: sides from the indexed parameters, the amount from the others, 0 where it has none."""
    pick = lambda params, *names: F.coalesce(*[F.try_element_at(F.col(params), F.lit(n)) for n in names], F.lit(""))
    amount = F.coalesce(F.nullif(pick("data_params", "value", "_value", "amount"), F.lit("")), F.lit("0")).try_cast("decimal(38,0)")
    sides = {side: F.lower(pick("indexed_params", *names)) for side, names in (("from_addr", ("from", "_from")), ("to_addr", ("to", "_to")))}
    rows = events.where(F.lower("event_signature") == TRANSFER_TOPIC).withColumns(sides | {"amount": amount})
    return rows.select(ids.movement_id("chain_id", "tx_hash", "from_addr", "to_addr", "amount", "log_index").alias("movement_id"), "chain_id", "block_number", "tx_hash", F.col("contract_address").alias("token_address"), "from_addr", "to_addr", "amount", F.array("raw_log_id").alias("evidence_ids"), F.lit("log").alias("source_priority"), F.lit(True).alias("is_canonical"), F.array(F.col("log_index").cast("int")).alias("position"))


def from_traces(transfers: DataFrame) -> DataFrame:
    """Movements of the transfer calls that ``token_transfer_calls`` found."""
    return transfers.select(ids.movement_id("chain_id", "tx_hash", "from_addr", "to_addr", "amount", ids.trace_occurrence("trace_address")).alias("movement_id"), "chain_id", "block_number", "tx_hash", "token_address", "from_addr", "to_addr", "amount", F.array("raw_trace_call_id").alias("evidence_ids"), F.lit("trace").alias("source_priority"), F.lit(True).alias("is_canonical"), F.col("trace_address").alias("position"))


def unify(movements: DataFrame, by_token: bool = False) -> DataFrame:
    """One movement for each that logs and traces both tell of.

    Rows with one id become one, the log's first. Then, in each transaction, rows with the same sides and
    amount are paired in order if as many come from logs as from traces; a pair keeps the log's row and
    the evidence of both. Where the numbers differ all rows stay.
    """
    once = movements.withColumn("_rank", F.row_number().over(Window.partitionBy("movement_id").orderBy("source_priority", "position")))
    evidence = movements.groupBy("movement_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_priority", "position", "evidence_ids"))), lambda x: x["evidence_ids"]))).alias("evidence_ids"))
    once = once.where("_rank = 1").drop("_rank", "evidence_ids").join(evidence, "movement_id").select(*COLUMNS)
    bucket = ["chain_id", "tx_hash", "from_addr", "to_addr", "amount", *(["token_address"] if by_token else [])]
    w = Window.partitionBy(*bucket)
    log = F.col("source_priority") == "log"
    ranked = once.withColumns({"_logs": F.count_if(log).over(w), "_traces": F.count_if(~log).over(w), "_n": F.row_number().over(Window.partitionBy(*bucket, "source_priority").orderBy("position"))})
    paired = (F.col("_logs") == F.col("_traces")) & (F.col("_logs") > 0)
    # the pair's other row is the next one when both are ordered by their number, the log's first
    beside = F.lead("evidence_ids").over(w.orderBy("_n", "source_priority"))
    joined = ranked.withColumn("_other", F.when(paired & log, beside))
    kept = joined.where(~(paired & ~log))
    return kept.withColumn("evidence_ids", F.when(F.col("_other").isNotNull(), F.array_distinct(F.concat("evidence_ids", "_other"))).otherwise(F.col("evidence_ids"))).select(*COLUMNS)


def net_by_address(movements: DataFrame, *keys: str) -> DataFrame:
    """Net amount that each address received, by further keys; a transfer to oneself nets zero."""
    sides = movements.select(*keys, F.inline(F.array(F.struct(F.lower("to_addr").alias("address"), F.col("amount").alias("_net")), F.struct(F.lower("from_addr").alias("address"), (-F.col("amount")).alias("_net")))))
    return sides.groupBy("address", *keys).agg(F.sum("_net").alias("net_amount"))


def balance_delta(movements: DataFrame, from_block: int, to_block: int) -> DataFrame:
    return net_by_address(movements.where(F.col("block_number").between(from_block, to_block)))
