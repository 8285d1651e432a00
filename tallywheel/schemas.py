"""Schemas of the raw layer and of the tables that operators pass on; amounts are DECIMAL(38,0)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RAW = {
    "blocks": "chain_id int, block_number long, block_hash string, parent_hash string, timestamp long, miner string, base_fee decimal(38,0), ingested_at long, run_partition_id string",
    "transactions": "chain_id int, block_number long, tx_hash string, tx_index int, from_address string, to_address string, value decimal(38,0), input string, gas long, gas_price decimal(38,0), nonce long, ingested_at long, run_partition_id string",
    "receipts": "chain_id int, block_number long, tx_hash string, status int, gas_used long, logs_count int, ingested_at long, run_partition_id string",
    "logs": "chain_id int, block_number long, block_hash string, tx_hash string, tx_index int, log_index int, address string, topics array<string>, data string, ingested_at long, run_partition_id string",
    "traces": "chain_id int, block_number long, tx_hash string, trace_address array<int>, call_type string, from_address string, to_address string, value string, input string, output string, error string, revert_reason string, status int, subtraces int, ingested_at long, run_partition_id string",
    "balance_snapshots": "chain_id int, block_number long, token_address string, holder_address string, balance decimal(38,0), ingested_at long, run_partition_id string",
}
DERIVED = {
    "decoded_events": "raw_log_id string, decoded_event_id string, chain_id int, block_number long, tx_hash string, log_index int, contract_address string, event_name string, event_signature string, indexed_params map<string,string>, data_params map<string,string>, run_partition_id string",
    "decoded_trace_calls": "raw_trace_call_id string, chain_id int, block_number long, tx_hash string, trace_address array<int>, contract_address string, method_name string, method_selector string, params map<string,string>, success boolean, parent_success boolean, run_partition_id string",
    "economic_actions": "action_id string, kind string, chain_id int, block_number long, tx_hash string, log_index int, contract_address string, pool_role string, wallet string, amount_link decimal(38,0), source_event_signature string, raw_log_id string, decoded_event_id string, run_partition_id string",
    "token_movements": "movement_id string, chain_id int, block_number long, tx_hash string, token_address string, from_addr string, to_addr string, amount decimal(38,0), evidence_ids array<string>, source_priority string, is_canonical boolean, run_partition_id string",
    "edges": "edge_id string, action_id string, movement_id string, allocated_amount decimal(38,0), status string, method string, reason string, chain_id int, block_number long, tx_hash string, run_partition_id string",
    "ledger": "entry_id string, action_id string, entry_index int, account string, direction string, amount_link decimal(38,0), chain_id int, block_number long, tx_hash string, run_partition_id string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table without rows, for sources that aren't there yet."""
    return spark.createDataFrame([], (RAW | DERIVED)[name])


def register_views(tables: dict[str, DataFrame], prefix: str = "raw_") -> None:
    """Temporary views over the raw tables; log addresses are in lower case."""
    from pyspark.sql import functions as F

    for name, df in tables.items():
        (df.withColumn("address", F.lower("address")) if name == "logs" else df).createOrReplaceTempView(prefix + name)


def create_table(spark: SparkSession, name: str, json_schema: str, partition_by: tuple[str, ...] = ()) -> bool:
    """Create a Parquet table from a schema in JSON unless it exists; says whether it was created."""
    if spark.catalog.tableExists(name):
        return False
    schema = StructType.fromJson(json.loads(json_schema))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet{parts}")
    return True
