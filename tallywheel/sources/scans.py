"""Reads of raw chain tables, with predicates that reach the file scan.

Raw columns are compared as they are stored (addresses and hashes in lower case), so filters are pushed
down; days are derived from block ranges by the caller where tables are partitioned by day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from tallywheel.functions.fixed import TRANSFER_FROM_SELECTOR, TRANSFER_SELECTOR, TRANSFER_TOPIC
from tallywheel.functions.hexes import topic_to_address
from tallywheel.sources.footers import scan_bytes


class CostError(RuntimeError):
    """A query whose inputs are larger than its budget."""


def guarded(df: DataFrame, most_bytes: int = 50 << 30) -> DataFrame:
    """``df``, or an error before anything of its tables but footers is read."""
    if (n := scan_bytes(df, enough=most_bytes)) > most_bytes:
        raise CostError(f"{n} bytes to read, over the limit of {most_bytes}")
    return df


def query(spark: SparkSession, sql: str, most_bytes: int = 50 << 30, **params) -> DataFrame:
    """SQL with named parameters, scalars or lists, under a size limit."""
    return guarded(spark.sql(sql, args={k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else v for k, v in params.items()}), most_bytes)


def _blocks(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(F.col("block_number").between(first, last))


def normal_logs(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"tx_hash": F.lower("tx_hash"), "address": F.lower("address"), "topics": F.coalesce("topics", F.array().cast("array<string>")), "data": F.coalesce("data", F.lit("0x"))})


def logs_by_address(logs: DataFrame, addresses: list[str], first: int, last: int, topic0: str | list[str] | None = None) -> DataFrame:
    rows = _blocks(logs, first, last).where(F.col("address").isin([a.lower() for a in addresses]))
    if topic0:
        rows = rows.where(F.get("topics", 0).isin([t.lower() for t in ([topic0] if isinstance(topic0, str) else topic0)]))
    return normal_logs(rows)


def transfer_logs(logs: DataFrame, token: str, counterparties: DataFrame | list[str], first: int, last: int) -> DataFrame:
    """Transfers of a token from or to counterparties, given as a list or, if there are many, a table (address)."""
    rows = _blocks(logs, first, last).where((F.col("address") == token.lower()) & (F.get("topics", 0) == TRANSFER_TOPIC))
    sides = [topic_to_address(F.get("topics", i)) for i in (1, 2)]
    if isinstance(counterparties, list):
        known = [c.lower() for c in counterparties]
        return normal_logs(rows.where(sides[0].isin(known) | sides[1].isin(known)))
    named = rows.withColumn("_sides", F.array_distinct(F.array(*sides))).withColumn("_side", F.explode("_sides"))
    hit = named.join(counterparties.select(F.lower("address").alias("_side")).distinct(), "_side", "left_semi")
    return normal_logs(hit.dropDuplicates(["chain_id", "block_number", "tx_hash", "log_index"]).select(*logs.columns))


def logs_of_transaction(logs: DataFrame, tx_hash: str, first_day: str | None = None) -> DataFrame:
    rows = logs.where(F.col("tx_hash") == tx_hash.lower())
    if first_day and "block_date" in logs.columns:
        rows = rows.where(F.col("block_date") >= F.lit(first_day).cast("date"))
    return normal_logs(rows).orderBy("log_index")


def traces_by_callee(traces: DataFrame, addresses: list[str], first: int, last: int, successful_only: bool = False) -> DataFrame:
    rows = _blocks(traces, first, last).where(F.col("to_address").isin([a.lower() for a in addresses]))
    rows = rows.where("status = 1") if successful_only else rows
    return rows.orderBy("block_number", "tx_hash", F.size("trace_address"), "trace_address")


def traces_of_transaction(traces: DataFrame, tx_hash: str) -> DataFrame:
    return traces.where(F.col("tx_hash") == tx_hash.lower()).orderBy(F.size("trace_address"), "trace_address")


def internal_transfers(traces: DataFrame, token: str, parents: list[str], first: int, last: int) -> DataFrame:
    """Successful token transfer frames of transactions whose root calls one of the parents."""
    rows = _blocks(traces, first, last)
    roots = rows.where((F.size("trace_address") == 0) & F.col("to_address").isin([p.lower() for p in parents])).select("tx_hash").distinct()
    moves = rows.where((F.col("to_address") == token.lower()) & (F.col("status") == 1) & (F.lower(F.substring("input", 1, 10)).isin(TRANSFER_SELECTOR, TRANSFER_FROM_SELECTOR)))
    return moves.join(roots, "tx_hash", "left_semi")


def transactions(table: DataFrame, first: int, last: int) -> DataFrame:
    return _blocks(table, first, last).orderBy("block_number", "tx_index")


def one_by_hash(table: DataFrame, column: str, value: str) -> DataFrame:
    return table.where(F.col(column) == value.lower()).limit(1)


def blocks(table: DataFrame, first: int, last: int) -> DataFrame:
    kind = dict(table.dtypes)["timestamp"]
    seconds = F.unix_seconds(F.col("timestamp").cast("timestamp")) if kind.startswith("timestamp") else F.col("timestamp").cast("long")
    return _blocks(table, first, last).withColumn("timestamp", seconds).orderBy("block_number")


def seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with declared types; quotes are doubled within quotes."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')


#: Columns of the eight seed files in their order; those of maps and lists are JSON text in the file. Fixed values.
SEEDS = {
    "seed_decoded_events": "raw_log_id string, decoded_event_id string, chain_id int, block_number bigint, block_hash string, tx_hash string, log_index int, contract_address string, event_name string, event_signature string, indexed_params map<string,string>, data_params map<string,string>, run_partition_id string",
    "seed_decoded_trace_calls": "raw_trace_call_id string, chain_id int, block_number bigint, tx_hash string, trace_address array<int>, contract_address string, method_name string, method_selector string, params map<string,string>, success boolean, parent_success boolean, run_partition_id string",
    "seed_link_transfers": "chain_id int, block_number bigint, block_hash string, tx_hash string, tx_index int, log_index int, address string, topics array<string>, data string, ingested_at bigint, run_partition_id string",
    "seed_canonical_blocks": "chain_id int, block_number bigint, block_hash string, parent_hash string, timestamp bigint, ingested_at bigint, run_partition_id string",
    "seed_economic_actions": "action_id string, kind string, chain_id int, block_number bigint, tx_hash string, log_index int, contract_address string, pool_role string, wallet string, amount_link decimal(38,0), source_event_signature string, raw_log_id string, decoded_event_id string, run_partition_id string",
    "seed_token_movements": "movement_id string, chain_id int, block_number bigint, tx_hash string, token_address string, from_addr string, to_addr string, amount decimal(38,0), evidence_ids array<string>, source_priority string, is_canonical boolean, run_partition_id string",
    "seed_action_movement_edges": "edge_id string, action_id string, movement_id string, allocated_amount decimal(38,0), status string, method string, reason string, chain_id int, block_number bigint, tx_hash string, run_partition_id string",
    "seed_ledger_entries": "entry_id string, action_id string, entry_index int, account string, direction string, amount_link decimal(38,0), chain_id int, block_number bigint, tx_hash string, run_partition_id string",
}


def read_seed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the eight seed files with its types; JSON text that doesn't fit is null, and so is an empty cell."""
    wanted = StructType.fromDDL(SEEDS[name])
    deep = {f.name: f.dataType for f in wanted if isinstance(f.dataType, (ArrayType, MapType))}
    plain = StructType([StructField(f.name, StringType() if f.name in deep else f.dataType) for f in wanted])
    rows = seed(spark, path, plain)
    return rows.withColumns({c: F.from_json(c, kind) for c, kind in deep.items()}) if deep else rows


def source_freshness(tables: dict[str, DataFrame], now: int, warn_after: int = 3600, error_after: int = 6 * 3600, column: str = "ingested_at") -> DataFrame:
    """source, latest, age_seconds and status (pass, warn, error) of each table; an empty one is an error. Only the one column is read."""
    age = F.lit(now) - F.col("latest")
    status = F.when(F.coalesce(age > error_after, F.lit(True)), "error").when(age > warn_after, "warn").otherwise("pass")
    each = [latest_ingest(t, column).select(F.lit(name).alias("source"), F.col("latest").cast("long").alias("latest")) for name, t in tables.items()]
    return reduce(DataFrame.unionAll, each).withColumns({"age_seconds": F.greatest(age, F.lit(0)), "status": status})


def latest_ingest(table: DataFrame, column: str = "ingested_at") -> DataFrame:
    return table.agg(F.max(column).alias("latest"))
