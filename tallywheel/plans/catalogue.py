"""Queries over the driver's tables, by name, and the DuckDB SQL that each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.functions import hexes, ids
from tallywheel.functions.fixed import SERVICES
from tallywheel.functions.portable import account_kind, account_owner, date_from_seconds
from tallywheel.operators import actions as A
from tallywheel.operators import balances, decode, ledger, matching, quality, traces, yields
from tallywheel.operators import blocks as B
from tallywheel.operators import movements as M
from tallywheel.plans import fixtures as X
from tallywheel.plans import marts
from tallywheel.session import shared_folder
from tallywheel.sources import scans
from tallywheel.sources.registry import Phase, Registry, in_phase
from tallywheel.sources.store import merged, save_bucketed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def _span(spark: SparkSession, d: str) -> tuple[int, int]:
    """The table's lowest and highest block."""
    r = X.base(spark, d).agg(F.min("block_number"), F.max("block_number")).first()
    return (r[0] or 0, r[1] or 0)


_SPAN = "BETWEEN (SELECT min(block_number) FROM base) AND (SELECT max(block_number) FROM base)"
_LATER = "BETWEEN (SELECT min(block_number) + 1 FROM base) AND (SELECT max(block_number) FROM base)"


def _long(df: DataFrame, *columns: str) -> DataFrame:
    """Sums as BIGINT, and days as text, so that they compare alike."""
    days = [c for c, kind in df.dtypes if kind == "date"]
    return df.withColumns({c: F.col(c).cast("long") for c in columns} | {c: F.col(c).cast("string") for c in days})


# Identities


@query(_with(X.BASE) + " SELECT event_id, sha256('raw_log|1|' || block_number || '|' || tx_hash || '|' || log_index) AS raw_log_id, sha256('decoded_event|1|' || block_number || '|' || tx_hash || '|' || log_index) AS decoded_event_id FROM base")
def event_ids(spark, d):
    return X.events(spark, d).select("event_id", "raw_log_id", "decoded_event_id")


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS) + " SELECT a.action_id, m.movement_id, sha256('ledger_entry|' || a.action_id || '|0') AS debit_id FROM actions a JOIN movements m USING (event_id)")
def action_and_movement_ids(spark, d):
    keys = ("chain_id", "block_number", "tx_hash", "log_index")
    b = X.base(spark, d).withColumn("amount", F.pmod("cents", F.lit(7)) + 1)
    return b.select(ids.action_id(ids.decoded_event_id(*keys), "kind").alias("action_id"), ids.movement_id("chain_id", "tx_hash", "wallet", "contract_address", "amount", "log_index").alias("movement_id")).withColumn("debit_id", ids.ledger_entry_id("action_id", F.lit(0)))


@query("SELECT c_custkey, sha256(c_custkey || '|' || coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, '') || '|' || c_nationkey) AS key FROM customer")
def surrogate_keys(spark, d):
    c = X.table(spark, d, "customer").withColumn("seg", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", ids.surrogate_key("c_custkey", "seg", "c_nationkey").alias("key"))


# Blocks


@query(_with(X.BASE) + ", v AS (SELECT block_number, event_id, timestamp FROM base), w AS (SELECT max(block_number) - 64 AS w FROM v) SELECT block_number, max(timestamp) AS ingested_at, arg_max(event_id, (timestamp, event_id)) AS event_id FROM v, w WHERE block_number <= w GROUP BY block_number")
def canonical_blocks(spark, d):
    b = X.base(spark, d).withColumns({"ingested_at": F.col("timestamp"), "block_hash": F.lpad(F.col("event_id").cast("string"), 20, "0")})
    return B.canonical_blocks(b).select("block_number", "ingested_at", "event_id")


@query(_with(X.BASE) + " SELECT event_id, block_number FROM base WHERE block_number > (SELECT max(block_number) - 64 FROM base)")
def shadow_blocks(spark, d):
    return B.shadow_blocks(X.base(spark, d)).select("event_id", "block_number")


@query("SELECT * FROM (SELECT o_custkey AS block_number, lead(o_custkey) OVER (ORDER BY o_custkey) AS next_block, lead(o_custkey) OVER (ORDER BY o_custkey) - o_custkey - 1 AS missing FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE next_block - block_number > 1")
def block_gaps(spark, d):
    o = X.table(spark, d, "orders").select(F.lit(1).alias("chain_id"), F.col("o_custkey").alias("block_number")).distinct()
    return B.block_gaps(o).drop("chain_id")


@query(_with(X.BASE) + " SELECT block_number, count(*) AS n FROM base WHERE block_number > (SELECT max(block_number) * 7 // 10 FROM base) - 50 GROUP BY block_number")
def incremental_overlap(spark, d):
    """What a run reads again whose target has seven tenths of the blocks."""
    return B.since_last_run(X.base(spark, d), _span(spark, d)[1] * 7 // 10).groupBy("block_number").agg(F.count("*").alias("n"))


@query(_with(X.BASE) + " SELECT block_number, sha256(CAST(block_number AS VARCHAR)) AS old_hash, sha256(block_number || 'x') AS new_hash FROM blocks WHERE block_number % 9 = 0")
def reorg_conflicts(spark, d):
    b = X.blocks(spark, d)
    seen = b.withColumn("block_hash", F.when(F.col("block_number") % 9 == 0, F.sha2(F.concat(F.col("block_number").cast("string"), F.lit("x")), 256)).otherwise(F.col("block_hash")))
    return B.reorg_conflicts(b, seen).drop("chain_id")


@query(_with(X.BASE) + " SELECT 1 AS chain_id, max(block_number) AS tip, max(block_number) - greatest(0, max(block_number) - 12) AS depth FROM blocks")
def reorg_depth(spark, d):
    b = X.blocks(spark, d)
    top = b.agg(F.max("block_number").alias("_top"))
    seen = b.crossJoin(top).withColumn("block_hash", F.when(F.col("block_number") > F.col("_top") - 12, F.lit("other")).otherwise(F.col("block_hash")))
    return B.reorg_depth(b, seen)


# Hex text


@query("SELECT event_id, '0x' || lpad(lower(hex(event_id * 7919)), 40, '0') AS address, '0x' || substr(lpad(lower(hex(event_id * 7919)), 64, '0'), 1, 8) AS selector, CAST(event_id AS BIGINT) * 7919 AS amount FROM events")
def hex_words(spark, d):
    w = F.lpad(F.lower(F.hex(F.col("event_id") * 7919)), 64, "0")
    e = X.table(spark, d, "events").select("event_id", F.concat(F.lit("0x"), w).alias("w"))
    return e.select("event_id", hexes.topic_to_address("w").alias("address"), hexes.method_selector("w").alias("selector"), hexes.word_to_decimal(hexes.bare("w")).cast("long").alias("amount"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '0x' || lpad(lower(hex(event_id + 1)), 40, '0') WHEN event_id % 3 = 1 THEN '0x' || lpad(lower(hex(event_id + 2)), 40, '0') END AS implementation FROM events")
def proxy_implementations(spark, d):
    slot = lambda on, n: F.when(on, X.hexed(F.col("event_id") + n, 64)).otherwise(F.lit("0x" + "0" * 64))
    e = X.table(spark, d, "events").select("event_id", slot(F.col("event_id") % 3 == 0, 1).alias("implementation_slot"), slot(F.col("event_id") % 3 == 1, 2).alias("beacon_slot"))
    return balances.implementations(e).select("event_id", "implementation")


# Decoding


def _registry() -> Registry:
    staked = {"type": "event", "name": "Staked", "inputs": [{"name": "staker", "type": "address", "indexed": True}, {"name": "amount", "type": "uint256", "indexed": False}, {"name": "flag", "type": "bool", "indexed": False}]}
    stake = {"type": "function", "name": "stake", "inputs": [{"name": "amount", "type": "uint256"}]}
    phases = [Phase("0x" + format(4096 + k, "040x"), "pool", f"v{v}", a, b, "pool.json") for k in range(5) for v, a, b in ((1, 0, 299), (2, 400, None))]
    return Registry.of(phases, {"pool.json": [staked, stake]})


def _logs(spark, d) -> DataFrame:
    from tallywheel.functions.keccak import topic0

    key = F.lit(topic0("Staked(address,uint256,bool)"))
    b = X.base(spark, d)
    topics = F.when(F.col("event_id") % 11 == 0, F.array(F.lit("0x" + "ab" * 32))).when(F.col("event_id") % 13 == 0, F.array(key)).otherwise(F.array(key, X.hexed(F.col("user_id"), 64)))
    flag = F.when(F.col("event_id") % 19 == 0, 2).otherwise(1)
    data = F.when(F.col("event_id") % 17 == 0, F.lit("0x00")).otherwise(F.concat(X.hexed(F.abs("cents"), 64), F.lpad(F.hex(flag), 64, "0")))
    return b.select("event_id", "chain_id", "block_number", "tx_hash", "log_index", F.col("contract_address").alias("address"), topics.alias("topics"), data.alias("data"))


_REASON = "CASE WHEN user_id % 7 >= 5 OR block_number BETWEEN 300 AND 399 THEN 'unregistered_contract' WHEN event_id % 11 = 0 THEN 'unknown_topic' WHEN event_id % 13 = 0 THEN 'abi_mismatch' WHEN event_id % 17 = 0 THEN 'malformed_data' WHEN event_id % 19 = 0 THEN 'abi_mismatch' END"


@query(_with(X.BASE) + f", r AS (SELECT *, {_REASON} AS failure_reason FROM base) SELECT event_id, failure_reason, CASE WHEN failure_reason IS NULL THEN wallet END AS staker, CASE WHEN failure_reason IS NULL THEN CAST(abs(cents) AS VARCHAR) END AS amount FROM r")
def decode_logs(spark, d):
    r = decode.decode_logs(_logs(spark, d), _registry())
    return r.select("event_id", "failure_reason", F.try_element_at("indexed_params", F.lit("staker")).alias("staker"), F.try_element_at("data_params", F.lit("amount")).alias("amount"))


@query(_with(X.BASE) + f", r AS (SELECT contract_address, block_number, tx_hash FROM base WHERE {_REASON} = 'unknown_topic') SELECT contract_address, count(*) AS occurrences, min(block_number) AS first_block, max(block_number) AS last_block, array_to_string(list_sort(list(DISTINCT tx_hash))[1:5], ',') AS samples FROM r GROUP BY contract_address")
def unknown_signatures(spark, d):
    r = decode.decode_logs(_logs(spark, d), _registry())
    failed = r.withColumn("topic0", F.get("topics", 0))
    return marts.int_unknown_signatures(marts.int_decode_failures(failed)).select("contract_address", "occurrences", "first_block", "last_block", F.array_join("sample_tx_hashes", ",").alias("samples"))


_METHOD = "SELECT event_id, event_id % 6 AS k, user_id % 7 < 5 AND NOT block_number BETWEEN 300 AND 399 AS known FROM base"


@query(_with(X.BASE) + f", m AS ({_METHOD}) SELECT event_id, CASE WHEN k = 0 THEN 'transfer' WHEN k = 1 THEN 'transferFrom' WHEN k = 2 AND known THEN 'stake' ELSE '<unknown>' END AS method_name, CASE WHEN k < 2 OR k = 2 AND known THEN CAST(event_id AS VARCHAR) END AS amount, CASE WHEN NOT known OR k IN (0, 1, 4) THEN 'unknown_topic' WHEN k = 3 THEN 'malformed_data' WHEN k = 5 THEN 'abi_mismatch' END AS failure_reason FROM m")
def decode_calldata(spark, d):
    """Calls to registered and other contracts: token transfers, a method of the ABI whole, cut off and without its value, and an unknown one."""
    from tallywheel.functions.keccak import selector

    w = lambda n: F.lpad(F.lower(F.hex(F.col("event_id") + n)), 64, "0")
    k, stake = F.col("event_id") % 6, F.lit(selector("stake(uint256)"))
    data = F.when(k == 0, F.concat(F.lit("0xa9059cbb"), w(1), w(0))).when(k == 1, F.concat(F.lit("0x23b872dd"), w(1), w(2), w(0))).when(k == 2, F.concat(stake, w(0))).when(k == 3, F.concat(stake, F.lit("00ff"))).when(k == 4, F.lit("0x12345678")).otherwise(stake)
    calls = X.base(spark, d).select("event_id", F.col("contract_address").alias("to_address"), "block_number", data.alias("input"))
    return decode.decode_calldata(calls, _registry()).select("event_id", "method_name", F.try_element_at("params", F.lit("amount")).alias("amount"), "failure_reason")


@query(_with(X.BASE) + " SELECT event_id, CASE WHEN user_id % 7 < 5 AND block_number < 300 THEN 'v1' WHEN user_id % 7 < 5 AND block_number >= 400 THEN 'v2' END AS abi_version FROM base")
def abi_phase_join(spark, d):
    return in_phase(X.base(spark, d), _registry().phase_table(spark).select("phase_address", "from_block", "to_block", "abi_version"), "contract_address", "block_number").select("event_id", "abi_version")


# Traces


def _frames(spark, d) -> DataFrame:
    """Five frames to a transaction: a root, two children, and two below the first child."""
    b = X.base(spark, d)
    k = F.col("event_id") % 5
    path = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(0))).when(k == 2, F.array(F.lit(1))).when(k == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    return b.select("event_id", "chain_id", "block_number", "tx_hash", path.alias("trace_address"), F.when(F.col("event_id") % 7 == 0, "reverted").alias("error"), F.col("contract_address").alias("to_address"), (F.col("event_id") % 7 != 0).cast("int").alias("status"), F.lit("0xa9059cbb").alias("input"))


@query("SELECT event_id, event_id % 7 <> 0 AS success, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN (event_id - 1) % 7 <> 0 WHEN 2 THEN (event_id - 2) % 7 <> 0 WHEN 3 THEN (event_id - 3) % 7 <> 0 AND (event_id - 2) % 7 <> 0 ELSE (event_id - 4) % 7 <> 0 AND (event_id - 3) % 7 <> 0 END AS parent_success FROM events")
def ancestor_success(spark, d):
    return traces.with_ancestor_success(_frames(spark, d)).select("event_id", "success", "parent_success")


@query(_with(X.BASE) + ", f AS (SELECT * FROM base), r AS (SELECT DISTINCT tx_hash FROM f WHERE event_id % 5 = 0 AND user_id % 7 = 1) SELECT event_id FROM f JOIN r USING (tx_hash) WHERE user_id % 7 = 2 AND event_id % 7 <> 0 AND block_number " + _SPAN)
def internal_transfers(spark, d):
    at = lambda n: "0x" + format(4096 + n, "040x")
    return scans.internal_transfers(_frames(spark, d), at(2), [at(1)], *_span(spark, d)).select("event_id")


@query(_with(X.BASE) + " SELECT event_id, block_number FROM base WHERE user_id % 7 IN (0, 3) AND event_id % 11 <> 0 AND block_number " + _SPAN)
def logs_by_address(spark, d):
    from tallywheel.functions.keccak import topic0

    addresses = ["0x" + format(4096 + n, "040x") for n in (0, 3)]
    return scans.logs_by_address(_logs(spark, d), addresses, *_span(spark, d), topic0("Staked(address,uint256,bool)")).select("event_id", "block_number")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN a0 WHEN 1 THEN a0 || CASE WHEN a1 <> a0 THEN ',' || a1 ELSE '' END WHEN 2 THEN a0 || CASE WHEN a2 <> a0 THEN ',' || a2 ELSE '' END WHEN 3 THEN a0 || CASE WHEN a1 <> a0 THEN ',' || a1 ELSE '' END || CASE WHEN a3 <> a1 THEN ',' || a3 ELSE '' END ELSE a0 || CASE WHEN a1 <> a0 THEN ',' || a1 ELSE '' END || CASE WHEN a4 <> a1 THEN ',' || a4 ELSE '' END END AS path FROM (SELECT event_id, " + ", ".join(f"max(CASE WHEN k = {k} THEN '0x' || lpad(lower(hex(user_id % 7 + 4096)), 40, '0') END) OVER (PARTITION BY event_id // 5) AS a{k}" for k in range(5)) + " FROM (SELECT *, event_id % 5 AS k FROM events))")
def inflow_paths(spark, d):
    f = _frames(spark, d)
    return balances.inflow_paths(f.select("event_id", "tx_hash", "trace_address"), f).select("event_id", F.array_join("path", ",").alias("path"))


@query()
def flatten_traces(spark, d):
    """Nested call traces of two levels through the table function; a test holds it against plain Python."""
    b = X.base(spark, d).groupBy("tx_hash").agg(F.min("wallet").alias("wallet"), F.min("contract_address").alias("contract_address"))
    leaf = F.struct(F.lit("CALL").alias("type"), F.col("wallet").alias("from"), F.col("contract_address").alias("to"), F.lit("0x1").alias("value"))
    text = F.to_json(F.struct(F.lit("CALL").alias("type"), F.col("wallet").alias("from"), F.col("contract_address").alias("to"), F.lit("0x0").alias("value"), F.array(leaf, leaf).alias("calls")))
    spark.udtf.register("flatten_call_trace", traces.flatten_call_trace())
    rows = b.select("tx_hash", text.alias("js"))
    return spark.sql("SELECT tx_hash, t.* FROM {rows}, LATERAL flatten_call_trace(js) t", rows=rows)


# Actions and ledger


@query(_with(X.BASE, X.ACTIONS) + " SELECT action_id, kind, wallet, cents AS amount FROM actions")
def staking_actions(spark, d):
    roles = spark.createDataFrame([("0x" + format(4096 + k, "040x"), "pool") for k in range(7)], "role_address string, role string")
    return A.staking_actions(X.events(spark, d), roles).select("action_id", "kind", "wallet", F.col("amount_link").cast("long").alias("amount"))


@query(_with(X.BASE, X.ACTIONS) + ", p AS (SELECT *, sha256('pa_action|' || decoded_event_id || '|pa_fee_received') AS pid FROM actions WHERE cents > 0) SELECT sha256('pa_ledger_entry|' || pid || '|' || i) AS entry_id, CASE i WHEN 0 THEN 'service_contract:' || wallet ELSE 'pa_fee_aggregator:' || contract_address END AS account, CASE i WHEN 0 THEN 'debit' ELSE 'credit' END AS direction, cents AS amount FROM p, range(2) AS s(i)")
def payment_ledger(spark, d):
    roles = spark.createDataFrame([("0x" + format(4096 + k, "040x"), "pa_fee_aggregator") for k in range(7)], "role_address string, role string")
    e = X.events(spark, d).withColumns({"event_name": F.lit("FeeReceived"), "indexed_params": F.create_map(F.lit("sender"), F.col("wallet"))})
    return ledger.payment_entries(A.payment_actions(e, roles)).select("entry_id", "account", "direction", F.col("amount_link").cast("long").alias("amount"))


_POSTED = """
    posted AS (
        SELECT a.*, i, sha256('ledger_entry|' || action_id || '|' || i) AS entry_id, CASE i WHEN 0 THEN 'debit' ELSE 'credit' END AS direction,
            CASE WHEN i = 0 THEN CASE kind WHEN 'stake' THEN 'wallet:' || wallet WHEN 'unstake_finalized' THEN 'pool:' || contract_address WHEN 'reward_claimed' THEN 'pool:rewards' WHEN 'reward_accrued' THEN 'reward_funder' ELSE 'pool:' || contract_address END
                 ELSE CASE kind WHEN 'stake' THEN 'pool:' || contract_address WHEN 'unstake_finalized' THEN 'wallet:' || wallet WHEN 'reward_claimed' THEN 'wallet:' || wallet WHEN 'reward_accrued' THEN 'pool:rewards' ELSE 'pool:forfeiture_sink' END END AS account
        FROM actions a, range(2) AS s(i) WHERE cents > 0)"""


@query(_with(X.BASE, X.ACTIONS, _POSTED) + " SELECT entry_id, action_id, CAST(i AS INTEGER) AS entry_index, account, direction, cents AS amount FROM posted")
def double_entry_postings(spark, d):
    return ledger.staking_entries(X.actions(spark, d)).select("entry_id", "action_id", "entry_index", "account", "direction", F.col("amount_link").cast("long").alias("amount"))


@query(_with(X.BASE, X.ACTIONS, _POSTED) + " SELECT CAST(CAST(to_timestamp(timestamp) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, count(*) AS entries, CAST(sum(CASE WHEN direction = 'debit' THEN cents ELSE 0 END) AS BIGINT) AS total_debit, CAST(sum(CASE WHEN direction = 'credit' THEN cents ELSE 0 END) AS BIGINT) AS total_credit, max(entry_id) AS last_id FROM posted GROUP BY day")
def daily_ledger_balance(spark, d):
    entries = ledger.staking_entries(X.actions(spark, d, "timestamp"), "timestamp").withColumn("day", date_from_seconds("timestamp"))
    total = lambda x: F.sum(F.when(F.col("direction") == x, F.col("amount_link")).otherwise(0)).cast("long")
    return entries.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("entries"), total("debit").alias("total_debit"), total("credit").alias("total_credit"), F.max("entry_id").alias("last_id"))


@query(_with(X.BASE, X.ACTIONS, _POSTED) + " SELECT tx_hash, CAST(sum(CASE WHEN direction = 'debit' THEN cents WHEN event_id % 4 = 0 THEN -cents - 1 ELSE -cents END) AS BIGINT) AS delta FROM posted GROUP BY tx_hash HAVING delta <> 0")
def unbalanced_transactions(spark, d):
    off = F.when((F.col("direction") == "credit") & (F.col("event_id") % 4 == 0), 1).otherwise(0)
    broken = ledger.staking_entries(X.actions(spark, d, "event_id"), "event_id").withColumn("amount_link", F.col("amount_link") + off)
    return _long(ledger.unbalanced(broken).select("tx_hash", "delta"), "delta")


@query(_with(X.BASE, X.ACTIONS, _POSTED) + " SELECT split_part(account, ':', 1) AS kind, CASE WHEN contains(account, ':') THEN substr(account, strpos(account, ':') + 1) ELSE account END AS owner, CAST(sum(cents) AS BIGINT) AS amount FROM posted GROUP BY ALL")
def account_totals(spark, d):
    e = ledger.staking_entries(X.actions(spark, d))
    return e.groupBy(account_kind("account").alias("kind"), account_owner("account").alias("owner")).agg(F.sum("amount_link").cast("long").alias("amount"))


# Matching


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS) + " SELECT sha256('edge|' || action_id || '|' || coalesce(movement_id, '') || '|' || status || '|' || idx) AS edge_id, action_id, movement_id, CAST(allocated AS BIGINT) AS allocated, status, CASE source WHEN 'log' THEN 'event_log' WHEN 'trace' THEN 'trace' END AS method, reason FROM edges")
def match_actions(spark, d):
    e = matching.match_actions(X.small_actions(spark, d), X.movements(spark, d))
    return e.select("edge_id", "action_id", "movement_id", F.col("allocated_amount").cast("long").alias("allocated"), "status", "method", "reason")


@query(ORACLE["match_actions"])
def bucketed_matching(spark, d):
    """Matching over tables that are bucketed by transaction; it shuffles nothing more."""
    at, name = shared_folder(spark, "bucketed"), f"tallywheel_{uuid.uuid4().hex}"
    a = save_bucketed(X.small_actions(spark, d), f"{name}_actions", ["tx_hash"], 16, f"{at}/actions")
    m = save_bucketed(X.movements(spark, d).drop("position", "evidence_ids"), f"{name}_movements", ["tx_hash"], 16, f"{at}/movements")
    e = matching.match_actions(a, m, lowered=True)
    return e.select("edge_id", "action_id", "movement_id", F.col("allocated_amount").cast("long").alias("allocated"), "status", "method", "reason")


_WORST = "['unmatched', 'unexpected', 'ambiguous', 'partial', 'not_expected', 'exact']"
_ALL_EDGES = """
    every AS (
        SELECT tx_hash, status FROM edges
        UNION ALL SELECT tx_hash, 'unexpected' FROM movements WHERE movement_id NOT IN (SELECT movement_id FROM edges WHERE movement_id IS NOT NULL))"""


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS, _ALL_EDGES) + f" SELECT tx_hash, {_WORST}[min(list_position({_WORST}, status))] AS overall_status, count(*) AS edge_count FROM every GROUP BY tx_hash")
def transaction_status(spark, d):
    e = matching.match_transactions(X.small_actions(spark, d), X.movements(spark, d))
    return matching.transaction_status(e).select("tx_hash", "overall_status", "edge_count")


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS) + " SELECT movement_id, tx_hash FROM movements WHERE movement_id NOT IN (SELECT movement_id FROM edges WHERE movement_id IS NOT NULL)")
def unexpected_movements(spark, d):
    m = X.movements(spark, d)
    return matching.unexpected(matching.match_actions(X.small_actions(spark, d), m), m).select("movement_id", "tx_hash")


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS, "c AS (SELECT count(*) AS n, min(block_number) AS a, max(block_number) AS b, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("exact", "partial", "unmatched", "not_expected", "unexpected", "ambiguous")) + " FROM edges)") + " SELECT sha256('1|' || a || '|' || b) AS partition_id, (exact + not_expected) / n AS pass_rate, '{\"exact\":' || exact || ',\"partial\":' || partial || ',\"unmatched\":' || unmatched || ',\"not_expected\":' || not_expected || ',\"unexpected\":' || unexpected || ',\"ambiguous\":' || ambiguous || '}' AS counts_by_status FROM c")
def reconciliation_status(spark, d):
    e = matching.match_actions(X.small_actions(spark, d), X.movements(spark, d)).withColumn("run_partition_id", F.lit("run-1"))
    return marts.reconciliation_status(e, X.blocks(spark, d)).select("partition_id", "pass_rate", "counts_by_status")


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS) + " SELECT tx_hash, count(*) FILTER (WHERE status = 'exact') AS exact_count, count(*) AS edge_count, CASE WHEN count(*) FILTER (WHERE status IN ('unmatched', 'unexpected', 'ambiguous')) > 0 THEN 'fail' WHEN count(*) FILTER (WHERE status = 'partial') > 0 THEN 'warn' ELSE 'ok' END AS overall_status FROM edges GROUP BY tx_hash")
def action_movement_recon(spark, d):
    e = matching.match_actions(X.small_actions(spark, d), X.movements(spark, d)).withColumn("run_partition_id", F.lit("run-1"))
    return marts.int_action_movement_recon(e).select("tx_hash", "exact_count", "edge_count", "overall_status")


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS) + ", f AS (SELECT s.action_id, first(m.movement_id ORDER BY m.source_priority, m.from_addr, m.movement_id) AS movement_id FROM small s LEFT JOIN movements m ON m.tx_hash = s.tx_hash AND m.amount = s.amount_link GROUP BY s.action_id) SELECT action_id, movement_id, CASE WHEN movement_id IS NULL THEN 'unmatched' ELSE 'exact' END AS status FROM f")
def match_payment_actions(spark, d):
    a = X.small_actions(spark, d).withColumns({"kind": F.lit("pa_fee_received"), "output_amount": F.col("amount_link"), "source_amount": F.col("amount_link")})
    return matching.match_payment_actions(a, X.movements(spark, d)).select("action_id", "movement_id", "status")


# Movements and balances


@query(_with(X.BASE, X.MOVEMENTS) + ", k AS (SELECT *, count(*) FILTER (WHERE source_priority = 'log') OVER w AS logs, count(*) FILTER (WHERE source_priority = 'trace') OVER w AS traces, row_number() OVER (PARTITION BY tx_hash, from_key, to_key, amount, source_priority ORDER BY log_index) AS n FROM (SELECT *, '' AS from_key, '' AS to_key FROM movements) WINDOW w AS (PARTITION BY tx_hash, amount)) SELECT a.movement_id, a.event_id || coalesce(',' || b.event_id, '') AS evidence FROM k a LEFT JOIN k b ON a.source_priority = 'log' AND b.source_priority = 'trace' AND a.tx_hash = b.tx_hash AND a.amount = b.amount AND a.n = b.n AND a.logs = a.traces WHERE NOT (a.source_priority = 'trace' AND a.logs = a.traces)")
def unify_movements(spark, d):
    m = X.movements(spark, d).withColumns({"from_addr": F.lit(""), "to_addr": F.lit("")})
    return M.unify(m).select("movement_id", F.array_join("evidence_ids", ",").alias("evidence"))


@query(_with(X.BASE, X.MOVEMENTS) + " SELECT address, CAST(sum(net) AS BIGINT) AS net FROM (SELECT to_addr AS address, amount AS net FROM movements WHERE block_number " + _SPAN + " UNION ALL SELECT from_addr, -amount FROM movements WHERE block_number " + _SPAN + ") GROUP BY address")
def net_by_address(spark, d):
    return M.balance_delta(X.movements(spark, d), *_span(spark, d)).select("address", F.col("net_amount").cast("long").alias("net"))


_SNAPS = "snaps AS (SELECT contract_address AS pool, block_number, max(cents) AS balance FROM base GROUP BY ALL)"


@query(_with(X.BASE, X.MOVEMENTS, _SNAPS, "net AS (SELECT a, block_number, sum(x) AS x FROM (SELECT to_addr AS a, block_number, amount AS x FROM movements UNION ALL SELECT from_addr, block_number, -amount FROM movements) GROUP BY ALL)", "steps AS (SELECT pool, block_number, balance, balance - lag(balance) OVER w AS observed, lag(block_number) OVER w AS prev FROM snaps WINDOW w AS (PARTITION BY pool ORDER BY block_number))") + " SELECT pool AS pool_address, s.block_number, observed AS observed_delta, prev AS prev_block, CAST(coalesce(x, 0) AS BIGINT) AS net FROM steps s LEFT JOIN net n ON n.a = s.pool AND n.block_number = s.block_number WHERE prev IS NOT NULL")
def pool_balance_deltas(spark, d):
    snaps = X.base(spark, d).groupBy(F.col("contract_address").alias("holder_address"), "block_number").agg(F.max("cents").alias("balance"))
    r = balances.pool_balance_deltas(snaps, X.movements(spark, d))
    return r.select("pool_address", "block_number", "observed_delta", "prev_block", F.col("net_movement_amount").cast("long").alias("net"))


# Marts and analytics


def _tables(spark, d) -> dict[str, DataFrame]:
    acts = X.actions(spark, d)
    edges = matching.match_actions(acts, X.movements(spark, d)).withColumn("run_partition_id", F.lit("run-1"))
    canonical = X.blocks(spark, d)
    return {"stg_canonical_blocks": canonical, "int_economic_actions": acts, "int_action_movement_recon": marts.int_action_movement_recon(edges), "ledger_entries": ledger.staking_entries(acts)}


def _flows(spark, d) -> DataFrame:
    return X.actions(spark, d).select("wallet", F.col("kind").alias("flow_type"), "amount_link", "tx_hash", "block_number", "run_partition_id")


_DAY = "CAST(CAST(to_timestamp(b.timestamp) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR)"


@query(_with(X.BASE) + f" SELECT wallet, {_DAY} AS snapshot_date, CAST(sum(CASE WHEN kind = 'stake' THEN cents ELSE 0 END) AS BIGINT) AS total_staked, CAST(sum(CASE WHEN kind = 'reward_claimed' THEN cents ELSE 0 END) AS BIGINT) AS total_claimed, CAST(sum(CASE WHEN kind = 'slashed' THEN cents ELSE 0 END) AS BIGINT) AS total_slashed, CAST(sum(CASE WHEN kind = 'stake' THEN -cents WHEN kind IN ('unstake_finalized', 'reward_claimed') THEN cents ELSE 0 END) AS BIGINT) AS net_flow FROM base JOIN blocks b USING (block_number) GROUP BY wallet, snapshot_date")
def wallet_economics(spark, d):
    return _long(marts.wallet_economics(_flows(spark, d), X.blocks(spark, d)).drop("run_partition_id"), "total_staked", "total_claimed", "total_slashed", "net_flow")


@query(_with(X.BASE) + f" SELECT contract_address AS pool_address, {_DAY} AS snapshot_date, CAST(sum(CASE WHEN kind = 'reward_accrued' THEN cents ELSE 0 END) AS BIGINT) AS rewards_distributed, CAST(sum(CASE WHEN kind = 'slashed' THEN cents ELSE 0 END) AS BIGINT) AS slashes_applied, max(max(cents)) OVER (PARTITION BY contract_address) AS end_of_day_balance FROM base JOIN blocks b USING (block_number) GROUP BY contract_address, snapshot_date")
def pool_economics(spark, d):
    from tallywheel.functions.fixed import TOKEN

    snaps = X.base(spark, d).select(F.lit(TOKEN).alias("token_address"), F.col("contract_address").alias("holder_address"), F.col("cents").alias("balance"))
    return _long(marts.pool_economics(X.actions(spark, d), snaps, X.blocks(spark, d)).drop("run_partition_id"), "rewards_distributed", "slashes_applied", "end_of_day_balance")


@query(_with(X.BASE, X.ACTIONS) + ", r AS (SELECT CASE WHEN min(event_id) % 7 = 5 THEN tx_hash || 'x' ELSE tx_hash END AS tx_hash, CASE min(event_id) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'unmatched' END AS s FROM base GROUP BY base.tx_hash) SELECT decoded_event_id AS event_id, wallet, kind AS flow_type, cents AS amount, coalesce(s, 'unmatched') AS reconciliation_status FROM actions LEFT JOIN r USING (tx_hash)")
def staking_link_flows(spark, d):
    known = F.when(F.col("m") % 7 == 5, F.concat("tx_hash", F.lit("x"))).otherwise(F.col("tx_hash"))  # some transactions have no reconciliation
    recon = X.base(spark, d).groupBy("tx_hash").agg(F.min("event_id").alias("m")).select(known.alias("tx_hash"), F.when(F.col("m") % 3 == 0, "ok").when(F.col("m") % 3 == 1, "warn").otherwise("fail").alias("overall_status"))
    return marts.staking_link_flows(X.actions(spark, d), recon).select("event_id", "wallet", "flow_type", F.col("amount_link").cast("long").alias("amount"), "reconciliation_status")


@query(_with(X.BASE, "st AS (SELECT b.timestamp AS t, CASE kind WHEN 'stake' THEN cents ELSE -cents END AS x FROM base JOIN blocks b USING (block_number) WHERE kind IN ('stake', 'unstake_finalized'))", "rw AS (SELECT b.timestamp AS t, cents AS y FROM base JOIN blocks b USING (block_number) WHERE kind = 'reward_claimed')", f"g AS (SELECT {_DAY} AS snapshot_date, CAST(coalesce(sum(x), 0) AS BIGINT) AS net_principal_delta, CAST(coalesce(sum(y), 0) AS BIGINT) AS rewards_distributed FROM blocks b LEFT JOIN st ON st.t = b.timestamp LEFT JOIN rw ON rw.t = b.timestamp GROUP BY 1)") + " SELECT *, CASE WHEN net_principal_delta <> 0 THEN round(CAST(rewards_distributed AS DOUBLE) * 31536000 / net_principal_delta, 4) END AS yield_proxy FROM g")
def apy_realized_by_pool(spark, d):
    r = marts.apy_realized_by_pool(_flows(spark, d), X.blocks(spark, d))
    return _long(r.withColumn("yield_proxy", F.round("reward_yield_proxy_annualized", 4)).drop("reward_yield_proxy_annualized"), "net_principal_delta", "rewards_distributed")


def _fee_entries(spark, d) -> DataFrame:
    return _fee_entries_of(X.base(spark, d))


def _fee_entries_of(b: DataFrame) -> DataFrame:
    known = F.array(*[F.lit(a) for a in SERVICES])
    payer = F.when(F.col("user_id") % 6 < 4, F.get(known, (F.col("user_id") % 6).cast("int"))).otherwise(F.col("wallet"))
    account = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("service_contract:"), payer)).when(F.col("event_id") % 3 == 1, F.lit("pa_reserves:link")).otherwise(F.when(F.col("event_id") % 4 == 0, F.lit("pa_fee_aggregator:x")).otherwise(F.lit("pool:rewards")))
    return b.select(F.col("event_id").alias("entry_id"), account.alias("account"), F.when(F.col("event_id") % 3 == 0, "debit").otherwise("credit").alias("direction"), F.col("cents").cast("decimal(38,0)").alias("amount_link"), "chain_id", "block_number", "tx_hash")


_SERVICE_LIST = "[" + ", ".join(f"'{a}'" for a in SERVICES) + "]"
_NAME_LIST = "[" + ", ".join(f"'{s}'" for s in SERVICES.values()) + "]"
_FEES = f"""
    fees AS (SELECT *, CASE WHEN user_id % 6 < 4 THEN {_SERVICE_LIST}[user_id % 6 + 1] ELSE wallet END AS payer, CASE WHEN user_id % 6 < 4 THEN {_NAME_LIST}[user_id % 6 + 1] ELSE 'other' END AS service,
        CASE WHEN event_id % 3 = 0 THEN 'service' WHEN event_id % 3 = 1 THEN 'reserves' WHEN event_id % 4 = 0 THEN 'aggregator' ELSE 'rewards' END AS side FROM base)"""


@query(_with(X.BASE, _FEES) + f" SELECT {_DAY} AS snapshot_date, service, payer AS source_address, CAST(sum(cents) AS BIGINT) AS inflow, count(DISTINCT tx_hash) AS tx_count FROM fees JOIN blocks b USING (block_number) WHERE side = 'service' GROUP BY ALL")
def fee_attribution_by_source(spark, d):
    r = marts.fee_attribution_by_source(_fee_entries(spark, d), X.blocks(spark, d))
    return _long(r.select("snapshot_date", "service", "source_address", F.col("inflow_link").alias("inflow"), "tx_count"), "inflow")


@query(_with(X.BASE, _FEES, f"g AS (SELECT {_DAY} AS snapshot_date, CAST(coalesce(sum(cents) FILTER (WHERE side = 'rewards'), 0) AS BIGINT) AS rewards_distributed, CAST(coalesce(sum(cents) FILTER (WHERE side = 'reserves'), 0) AS BIGINT) AS reserves_inflow FROM fees JOIN blocks b USING (block_number) WHERE side IN ('rewards', 'reserves') GROUP BY 1)") + " SELECT *, CASE WHEN reserves_inflow <> 0 THEN round(rewards_distributed / reserves_inflow, 8) END AS ratio FROM g")
def staker_reward_sustainability(spark, d):
    r = marts.staker_reward_sustainability(_fee_entries(spark, d), X.blocks(spark, d))
    return _long(r.withColumn("ratio", F.round("rewards_to_reserves_ratio", 8)).drop("rewards_to_reserves_ratio"), "rewards_distributed", "reserves_inflow")


@query(_with(X.BASE, _FEES) + f" SELECT CAST(CAST(date_trunc('week', CAST({_DAY} AS DATE)) AS DATE) AS VARCHAR) AS week_start, CASE WHEN tx_hash IN (SELECT tx_hash FROM fees WHERE side = 'aggregator') THEN 'pa_fee_inflow' ELSE 'other_inflow' END AS inflow_source, CAST(sum(cents) AS BIGINT) AS link_inflow, count(DISTINCT tx_hash) AS tx_count FROM fees JOIN blocks b USING (block_number) WHERE side = 'reserves' GROUP BY ALL")
def weekly_reserve_accumulation(spark, d):
    return _long(marts.weekly_reserve_accumulation(_fee_entries(spark, d), X.blocks(spark, d)), "link_inflow")


@query(_with(X.BASE) + " SELECT wallet, CAST(sum(cents * (least(CASE WHEN event_id % 4 = 0 THEN 1706000000 ELSE timestamp + 86400 END, 1706000000) - timestamp)) AS BIGINT) AS principal_seconds FROM base WHERE cents > 0 AND least(CASE WHEN event_id % 4 = 0 THEN 1706000000 ELSE timestamp + 86400 END, 1706000000) > timestamp GROUP BY wallet")
def time_weighted_principal(spark, d):
    s = X.base(spark, d).select("wallet", F.col("cents").alias("principal"), F.col("timestamp").alias("start_unix"), F.when(F.col("event_id") % 4 == 0, F.lit(0)).otherwise(F.col("timestamp") + 86400).alias("end_unix"))
    return _long(yields.time_weighted_principal(s, 1706000000, "wallet"), "principal_seconds")


@query(_with(X.BASE) + ", g AS (SELECT contract_address, CAST(coalesce(sum(cents) FILTER (WHERE kind = 'reward_accrued'), 0) AS BIGINT) AS distributed, CAST(coalesce(sum(cents) FILTER (WHERE kind = 'reward_claimed'), 0) AS BIGINT) AS claimed FROM base WHERE kind IN ('reward_accrued', 'reward_claimed') GROUP BY 1) SELECT *, distributed - claimed AS unclaimed, CASE WHEN distributed <> 0 THEN round(claimed / distributed, 8) ELSE 0 END AS efficiency FROM g")
def reward_distribution(spark, d):
    a = X.actions(spark, d)
    r = yields.distribution(a.where("kind = 'reward_accrued'"), a.where("kind = 'reward_claimed'"), "contract_address")
    return _long(r.withColumn("efficiency", F.round("efficiency", 8)), "distributed", "claimed", "unclaimed")


# Checks


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_combination(spark, d):
    return quality.not_unique(X.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def accepted_values(spark, d):
    return quality.not_accepted(X.table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders)")
def orphan_events(spark, d):
    return quality.orphans(X.table(spark, d, "events").select("event_id"), X.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), ["event_id"])


@query("SELECT count(*) AS left_rows, count(*) AS right_rows, CAST(sum(a) AS BIGINT) AS left_amount, CAST(sum(b) AS BIGINT) AS right_amount, count(*) FILTER (WHERE a <> b) AS only_left, count(*) FILTER (WHERE a <> b) AS only_right FROM (SELECT o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS a, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS b FROM orders)")
def parity(spark, d):
    """Two versions of the orders that differ in some amounts."""
    o = X.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    version = lambda n: o.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % n == 0, 1).otherwise(0))
    return quality.parity(version(10), version(7), "o_custkey", ["o_orderkey"])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def merge_by_key(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return merged(c.drop("c_acctbal"), c.where("c_acctbal > 5000").select("c_custkey", F.lit("new").alias("segment")), ["c_custkey"])


# Further scans and operators


@query(_with(X.BASE) + " SELECT event_id, block_number FROM base WHERE user_id % 7 IN (1, 4) AND event_id % 7 <> 0 AND block_number " + _SPAN)
def traces_by_callee(spark, d):
    addresses = ["0x" + format(4096 + n, "040x") for n in (1, 4)]
    return scans.traces_by_callee(_frames(spark, d), addresses, *_span(spark, d), successful_only=True).select("event_id", "block_number")


@query(_with(X.BASE) + " SELECT event_id FROM base WHERE user_id % 7 = 3 AND (user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR (event_id % 150) IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AND block_number " + _SPAN)
def transfer_logs(spark, d):
    from tallywheel.functions.fixed import TRANSFER_TOPIC

    logs = X.base(spark, d).select("event_id", "chain_id", "block_number", "tx_hash", "log_index", F.col("contract_address").alias("address"), F.array(F.lit(TRANSFER_TOPIC), X.hexed(F.col("user_id"), 64), X.hexed(F.col("event_id") % 150, 64)).alias("topics"), F.lit("0x").alias("data"))
    sides = X.table(spark, d, "customer").where("c_nationkey = 3").select(X.hexed(F.col("c_custkey"), 40).alias("address"))
    return scans.transfer_logs(logs, "0x" + format(4099, "040x"), sides, *_span(spark, d)).select("event_id")


@query(_with(X.BASE) + " SELECT tx_hash, block_number, log_index, event_id FROM base WHERE block_number " + _SPAN)
def transactions_in_range(spark, d):
    b = X.base(spark, d).withColumn("tx_index", F.col("log_index"))
    return scans.transactions(b, *_span(spark, d)).select("tx_hash", "block_number", "log_index", "event_id")


@query(_with(X.BASE) + ", p AS (SELECT *, event_id % 3 AS k FROM base WHERE cents > 0 AND event_id % 4 < 3) SELECT ['pa_reserves', 'pa_fee_aggregator', 'pa_swap_automator'][event_id % 4 + 1] AS contract_role, ['pa_reserves_deposit', 'pa_fee_received', 'pa_service_fee_forwarded'][event_id % 4 + 1] AS kind, count(*) AS n, CAST(sum(cents) AS BIGINT) AS amount FROM p GROUP BY event_id % 4")
def payment_actions_from_transfers(spark, d):
    from tallywheel.functions.fixed import PA_ROLES

    to = F.coalesce(F.get(F.array(*[F.lit(a) for a in PA_ROLES]), (F.col("event_id") % 4).cast("int")), F.lit("0x00"))
    m = X.base(spark, d).select(to.alias("to_addr"), F.col("wallet").alias("from_addr"), F.col("cents").cast("decimal(38,0)").alias("amount"))
    return A.payment_actions_from_transfers(m).groupBy("contract_role", "kind").agg(F.count("*").alias("n"), F.sum("amount").cast("long").alias("amount"))


@query(_with(X.BASE, _FEES) + ", g AS (SELECT service, payer AS source_address, CAST(sum(cents) AS BIGINT) AS amount, count(*) AS actions FROM fees GROUP BY ALL) SELECT * FROM g")
def attribute_fees(spark, d):
    known = F.array(*[F.lit(a) for a in SERVICES])
    payer = F.when(F.col("user_id") % 6 < 4, F.get(known, (F.col("user_id") % 6).cast("int"))).otherwise(F.col("wallet"))
    return _long(yields.attribute_fees(X.base(spark, d).select(payer.alias("counterparty"), F.col("cents").cast("decimal(38,0)").alias("output_amount"))), "amount")


@query(_with(X.BASE, "h AS (SELECT contract_address AS pool, CAST(sum(cents * 86400) FILTER (WHERE cents > 0) AS BIGINT) AS ps, CAST(coalesce(sum(cents) FILTER (WHERE kind = 'reward_claimed'), 0) AS BIGINT) AS rewards FROM base GROUP BY 1)") + " SELECT pool, ps AS principal_seconds, rewards, round(rewards * 31536000.0 / ps, 6) AS apy FROM h")
def realized_apy(spark, d):
    b = X.base(spark, d).withColumn("pool", F.col("contract_address"))
    stakes = b.select("pool", F.col("cents").alias("principal"), F.col("timestamp").alias("start_unix"), (F.col("timestamp") + 86400).alias("end_unix"))
    rewards = b.where("kind = 'reward_claimed'").select("pool", F.col("timestamp").alias("ts_unix"), F.col("cents").cast("decimal(38,0)").alias("amount_link"))
    r = yields.realized_apy(stakes, rewards, 2_000_000_000, "pool")
    return _long(r.select("pool", "principal_seconds", "rewards", F.round("realized_apy", 6).alias("apy")), "principal_seconds", "rewards")


_POOLS = (
    "ends AS (SELECT min(block_number) AS lo, max(block_number) AS hi FROM base)",
    "s AS (SELECT contract_address AS pool, max(cents) FILTER (WHERE block_number = lo) AS a, max(cents) FILTER (WHERE block_number = hi) AS b FROM base, ends WHERE block_number IN (lo, hi) GROUP BY 1)",
    f"n AS (SELECT pool, sum(x) AS x FROM (SELECT to_addr AS pool, amount AS x FROM movements WHERE block_number {_LATER} UNION ALL SELECT from_addr, -amount FROM movements WHERE block_number {_LATER}) GROUP BY 1)",
    "pools AS (SELECT pool, b - a AS observed_delta, CAST(coalesce(x, 0) AS BIGINT) AS net_amount, CAST(b - a - coalesce(x, 0) AS BIGINT) AS difference FROM s LEFT JOIN n USING (pool))",
)


@query(_with(X.BASE, X.MOVEMENTS, *_POOLS) + " SELECT pool AS holder_address, observed_delta, net_amount, difference FROM pools")
def reconcile_pools(spark, d):
    """Movements of all blocks after the first, against the change between the first block's and the last block's snapshots."""
    lo, hi = _span(spark, d)
    snaps = X.base(spark, d).groupBy(F.col("contract_address").alias("holder_address"), "block_number").agg(F.max("cents").alias("balance"))
    return _long(balances.reconcile_pools(snaps, X.movements(spark, d), lo + 1, hi), "net_amount", "difference")


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS, _ALL_EDGES, f"t AS (SELECT tx_hash, {_WORST}[min(list_position({_WORST}, status))] AS s FROM every GROUP BY tx_hash)") + " SELECT count(*) AS tx_count, count(*) FILTER (WHERE s = 'exact') AS exact, count(*) FILTER (WHERE s = 'unmatched') AS unmatched, count(*) FILTER (WHERE s = 'unexpected') AS unexpected, round(count(*) FILTER (WHERE s IN ('exact', 'not_expected')) / count(*), 9) AS pass_rate FROM t")
def partition_status(spark, d):
    a, m = X.small_actions(spark, d), X.movements(spark, d)
    r = matching.partition_status(matching.match_transactions(a, m), a.select("tx_hash").unionAll(m.select("tx_hash")), 1, 0, 10**9)
    n = lambda s: F.try_element_at("counts_by_status", F.lit(s)).alias(s)
    return r.select("tx_count", n("exact"), n("unmatched"), n("unexpected"), F.round("pass_rate", 9).alias("pass_rate"))


@query(_with(X.BASE) + " SELECT event_id, '0x' || lpad(lower(hex(event_id)), 40, '0') AS address, CAST(event_id AS BIGINT) AS n, sha256('raw_log|1|' || block_number || '|' || tx_hash || '|' || log_index) AS id FROM base")
def sql_functions(spark, d):
    """The SQL functions, called from SQL."""
    from tallywheel.functions import sql

    sql.register(spark)
    b = X.base(spark, d).withColumn("w", F.lpad(F.lower(F.hex("event_id")), 64, "0"))
    return spark.sql("SELECT event_id, topic_to_address('0x' || w) AS address, CAST(word_to_decimal(w) AS BIGINT) AS n, raw_log_id(chain_id, block_number, tx_hash, log_index) AS id FROM {b}", b=b)


_STATUS_OF_TX = f"t AS (SELECT tx_hash, {_WORST}[min(list_position({_WORST}, status))] AS s FROM every GROUP BY tx_hash)"


def _partition(spark, d) -> DataFrame:
    """Status of all transactions with an action or a movement."""
    a, m = X.small_actions(spark, d), X.movements(spark, d)
    return matching.partition_status(matching.match_transactions(a, m), a.select("tx_hash").unionAll(m.select("tx_hash")), 1, 0, 10**9)


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS, _ALL_EDGES, _STATUS_OF_TX, f"r AS (SELECT {_REASON} AS reason FROM base)") + " SELECT 'decode_failure_rate' AS metric, round(count(reason) * 100.0 / count(*), 6) AS value FROM r UNION ALL SELECT 'reorg_events', count(*) FROM blocks WHERE block_number % 9 = 0 UNION ALL SELECT 'reconciliation_pass_rate', round(count(*) FILTER (WHERE s IN ('exact', 'not_expected')) / count(*), 6) FROM t UNION ALL SELECT 'unknown_signatures', count(DISTINCT reason) FROM r WHERE reason = 'unknown_topic'")
def metrics(spark, d):
    decoded = decode.decode_logs(_logs(spark, d), _registry())
    return quality.metrics(decoded, _partition(spark, d), reorg_conflicts(spark, d)).select("metric", F.round("value", 6).alias("value"))


_CHECKS = """
    SELECT 'no_duplicate_event_ids' AS name, count(l_orderkey) = count(DISTINCT l_orderkey) AS passed, CAST(count(l_orderkey) - count(DISTINCT l_orderkey) AS DOUBLE) AS metric_value FROM lineitem
    UNION ALL SELECT 'freshness', CAST(floor(epoch(max(ts))) AS BIGINT) >= 1706745600 - 1800, greatest(1706745600 - floor(epoch(max(ts))), 0) FROM events
    UNION ALL SELECT 'ledger_balanced_per_tx', count(*) = 0, count(*) FROM (SELECT tx_hash FROM posted GROUP BY tx_hash HAVING sum(CASE WHEN direction = 'debit' THEN cents WHEN event_id % 40 = 0 THEN -cents - 1 ELSE -cents END) <> 0)
    UNION ALL SELECT 'no_unmatched_economic_actions', count(*) = 0, count(*) FROM t WHERE s = 'unmatched'
    UNION ALL SELECT 'pass_rate', count(*) FILTER (WHERE s IN ('exact', 'not_expected')) / count(*) >= 0.95, round(count(*) FILTER (WHERE s IN ('exact', 'not_expected')) / count(*), 6) FROM t
    UNION ALL SELECT 'unknown_signatures', count(*) FILTER (WHERE reason = 'unknown_topic') * 100.0 / count(*) <= 0.5, round(count(*) FILTER (WHERE reason = 'unknown_topic') * 100.0 / count(*), 6) FROM r
    UNION ALL SELECT 'balance_consistency', count(*) FILTER (WHERE abs(difference) > 0) = 0, coalesce(max(abs(difference)), 0) FROM pools"""


@query(_with(X.BASE, X.ACTIONS, _POSTED, X.MOVEMENTS, X.SMALL_ACTIONS, _ALL_EDGES, _STATUS_OF_TX, f"r AS (SELECT {_REASON} AS reason FROM base)", *_POOLS) + _CHECKS)
def checks(spark, d):
    """All seven checks; every fortieth event's credit is off by one."""
    off = F.when((F.col("direction") == "credit") & (F.col("event_id") % 40 == 0), 1).otherwise(0)
    entries = ledger.staking_entries(X.actions(spark, d, "event_id"), "event_id").withColumn("amount_link", F.col("amount_link") + off)
    partition = _partition(spark, d)
    found = quality.all_checks(
        quality.no_duplicate_ids(X.table(spark, d, "lineitem"), "l_orderkey"),
        quality.freshness(X.base(spark, d), 1706745600),
        quality.ledger_balanced(entries),
        quality.partition_checks(partition),
        quality.unknown_signatures(decode.decode_logs(_logs(spark, d), _registry())),
        quality.balance_consistency(reconcile_pools(spark, d)),
    )
    return found.select("name", "passed", F.round("metric_value", 6).alias("metric_value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tallywheel.plans import models  # noqa: F401  adds its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tallywheel.plans import models  # noqa: F401

    return dict(ORACLE)
