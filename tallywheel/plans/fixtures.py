"""The driver's generic tables read as chain data, so that the operators have rows to work on.

Events stand for logs: ten to a block, five to a transaction. Their type decides the kind of action,
their value in cents the amount, their user the wallet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.functions import ids
from tallywheel.functions.fixed import REASONS
from tallywheel.operators.actions import lookup

def _said(name: str, *values: str) -> str:
    """A reason as the inside of an SQL string, with values in its places."""
    return REASONS[name].format(*[f"' || ({v}) || '" for v in values])


KINDS = {"purchase": "stake", "signup": "unstake_finalized", "click": "reward_claimed", "view": "reward_accrued", "error": "slashed"}
EVENT_NAMES = {"purchase": "Staked", "signup": "Unstaked", "click": "RewardClaimed", "view": "RewardAdded", "error": "Slashed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hexed(x, digits: int):
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x)), digits, "0"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_of(table(spark, sf_dir, "events"))


def base_of(e: DataFrame) -> DataFrame:
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        F.lit(1).alias("chain_id"),
        F.expr("event_id div 10").alias("block_number"),
        (F.col("event_id") % 10).cast("int").alias("log_index"),
        hexed(F.expr("event_id div 5"), 64).alias("tx_hash"),
        hexed(F.col("user_id"), 40).alias("wallet"),
        hexed(F.col("user_id") % 7 + 4096, 40).alias("contract_address"),
        lookup(KINDS, "event_type").alias("kind"),
        F.coalesce(F.round(F.col("value") * 100), F.lit(0.0)).cast("long").alias("cents"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.lit("run-1").alias("run_partition_id"),
    )


#: The same in DuckDB.
BASE = """
    base AS (
        SELECT event_id, user_id, event_type, 1 AS chain_id, event_id // 10 AS block_number, CAST(event_id % 10 AS INTEGER) AS log_index,
            '0x' || lpad(lower(hex(event_id // 5)), 64, '0') AS tx_hash, '0x' || lpad(lower(hex(user_id)), 40, '0') AS wallet,
            '0x' || lpad(lower(hex(user_id % 7 + 4096)), 40, '0') AS contract_address,
            CASE event_type WHEN 'purchase' THEN 'stake' WHEN 'signup' THEN 'unstake_finalized' WHEN 'click' THEN 'reward_claimed' WHEN 'view' THEN 'reward_accrued' WHEN 'error' THEN 'slashed' END AS kind,
            CAST(coalesce(round(value * 100), 0) AS BIGINT) AS cents, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, 'run-1' AS run_partition_id
        FROM events),
    blocks AS (SELECT 1 AS chain_id, block_number, max(timestamp) AS timestamp FROM base GROUP BY block_number)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each block, with a hash."""
    b = base(spark, sf_dir).groupBy("chain_id", "block_number").agg(F.max("timestamp").alias("timestamp"))
    return b.withColumns({"block_hash": F.sha2(F.col("block_number").cast("string"), 256), "ingested_at": F.col("timestamp")})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded events, each with its amount and wallet as parameters."""
    b = base(spark, sf_dir)
    keys = ("chain_id", "block_number", "tx_hash", "log_index")
    return b.withColumns(
        {
            "raw_log_id": ids.raw_log_id(*keys),
            "decoded_event_id": ids.decoded_event_id(*keys),
            "event_name": lookup(EVENT_NAMES, "event_type"),
            "event_signature": F.sha2("event_type", 256),
            "indexed_params": F.create_map(F.lit("staker"), F.col("wallet")),
            "data_params": F.create_map(F.lit("amount"), F.col("cents").cast("string")),
        }
    )


def actions(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(ids.action_id("decoded_event_id", "kind").alias("action_id"), "kind", "chain_id", "block_number", "tx_hash", "log_index", "contract_address", F.lit("pool").alias("pool_role"), "wallet", F.col("cents").cast("decimal(38,0)").alias("amount_link"), "decoded_event_id", "run_partition_id", *carry)


ACTIONS = """
    actions AS (
        SELECT *, sha256('action|' || decoded_event_id || '|' || kind) AS action_id
        FROM (SELECT *, sha256('decoded_event|1|' || block_number || '|' || tx_hash || '|' || log_index) AS decoded_event_id FROM base))"""


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A movement for each event, of a few small amounts so that many are equal."""
    b = base(spark, sf_dir).withColumn("amount", (F.pmod("cents", F.lit(7)) + 1).cast("decimal(38,0)"))
    source = F.when(F.col("event_id") % 3 == 0, "trace").otherwise("log")
    return b.select(ids.movement_id("chain_id", "tx_hash", "wallet", "contract_address", "amount", "log_index").alias("movement_id"), "chain_id", "block_number", "tx_hash", F.lit("token").alias("token_address"), F.col("wallet").alias("from_addr"), F.col("contract_address").alias("to_addr"), "amount", F.array(F.col("event_id").cast("string")).alias("evidence_ids"), source.alias("source_priority"), F.lit(True).alias("is_canonical"), F.array("log_index").alias("position"), "run_partition_id")


MOVEMENTS = """
    movements AS (
        SELECT sha256('movement|1|' || tx_hash || '|' || wallet || '|' || contract_address || '|' || amount || '|' || log_index) AS movement_id, *,
            wallet AS from_addr, contract_address AS to_addr, CASE WHEN event_id % 3 = 0 THEN 'trace' ELSE 'log' END AS source_priority
        FROM (SELECT *, ((cents % 7) + 7) % 7 + 1 AS amount FROM base))"""


def small_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions with amounts that one, several or no movements of their transaction make up."""
    a = base(spark, sf_dir).withColumn("amount_link", (F.pmod("cents", F.lit(13)) + 1).cast("decimal(38,0)"))
    keys = ("chain_id", "block_number", "tx_hash", "log_index")
    return a.select(ids.action_id(ids.decoded_event_id(*keys), "kind").alias("action_id"), "kind", "chain_id", "block_number", "tx_hash", "amount_link")


SMALL_ACTIONS = f"""
    small AS (SELECT action_id, kind, block_number, tx_hash, ((cents % 13) + 13) % 13 + 1 AS amount_link FROM actions),
    ranked AS (
        SELECT s.*, m.movement_id, m.amount, m.source_priority, m.from_addr,
            row_number() OVER (PARTITION BY s.action_id ORDER BY m.source_priority, m.from_addr, m.movement_id) AS r,
            count(*) OVER (PARTITION BY s.action_id) AS n, count(*) FILTER (WHERE m.amount = s.amount_link) OVER (PARTITION BY s.action_id) AS equals
        FROM small s JOIN movements m USING (tx_hash) WHERE s.kind <> 'reward_accrued'),
    combos AS (
        SELECT action_id, amount_link, r AS last, 1 AS size, CAST(amount AS BIGINT) AS total, [r] AS path FROM ranked WHERE equals = 0
        UNION ALL
        SELECT c.action_id, c.amount_link, k.r, c.size + 1, c.total + k.amount, list_append(c.path, k.r)
        FROM combos c JOIN ranked k ON k.action_id = c.action_id AND k.r > c.last WHERE c.size < 6),
    best AS (SELECT action_id, first(path ORDER BY size, path) AS path FROM combos WHERE size >= 2 AND total = amount_link GROUP BY action_id),
    picks AS (
        SELECT action_id, NULL AS r, 'not_expected' AS status, 0 AS idx, '{_said("idle", "kind")}' AS reason FROM small WHERE kind = 'reward_accrued'
        UNION ALL SELECT action_id, r, 'exact', 0, '{REASONS["exact"]}' FROM ranked WHERE equals = 1 AND amount = amount_link
        UNION ALL SELECT action_id, min(r), 'ambiguous', 0, '{_said("ambiguous", "any_value(equals)")}' FROM ranked WHERE equals > 1 AND amount = amount_link GROUP BY action_id
        UNION ALL SELECT action_id, unnest(path), 'partial', unnest(range(len(path))), '{_said("partial", "unnest(range(len(path))) + 1", "len(path)")}' FROM best
        UNION ALL SELECT action_id, NULL, 'unmatched', 0, '{_said("no_sum", "any_value(n)", "any_value(amount_link)")}' FROM ranked WHERE equals = 0 AND action_id NOT IN (SELECT action_id FROM best) GROUP BY action_id),
    edges AS (
        SELECT p.action_id, k.movement_id, coalesce(k.amount, 0) AS allocated, p.status, p.idx, s.tx_hash, s.block_number, k.source_priority AS source, p.reason
        FROM picks p JOIN small s ON s.action_id = p.action_id LEFT JOIN ranked k ON k.action_id = p.action_id AND k.r = p.r)"""
