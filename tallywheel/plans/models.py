"""Queries over the models of the staging, intermediate and mart layers, and over single steps of the pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywheel.functions.fixed import TOKEN, TRANSFER_TOPIC
from tallywheel.functions.keccak import selector
from tallywheel.operators import actions as A
from tallywheel.operators import balances, ledger, matching, quality, traces
from tallywheel.operators import blocks as B
from tallywheel.operators import movements as M
from tallywheel.operators.decode import decode_calldata, decode_logs
from tallywheel.plans import fixtures as X
from tallywheel.plans import marts
from tallywheel.plans.incremental import Incremental
from tallywheel.plans.catalogue import _DAY, _FEES, _REASON, _fee_entries_of, _frames, _logs, _registry, _with, query
from tallywheel.session import shared_folder
from tallywheel.sources import scans
from tallywheel.sources.registry import Phase, Registry, in_phase_by_bins
from tallywheel.streaming import stateful

_FINAL = "block_number <= (SELECT max(block_number) - 64 FROM base)"
_TOKEN_UPPER = TOKEN.upper().replace("X", "x")


def _canonical(spark, d) -> DataFrame:
    return B.canonical_blocks(X.blocks(spark, d))


def _totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("account", "direction", "entry_index").agg(F.count("*").alias("n"), F.sum("amount_link").cast("long").alias("amount"))


# Staging


@query(_with(X.BASE, X.ACTIONS) + f" SELECT decoded_event_id, block_number FROM actions WHERE event_type <> 'view' AND {_FINAL}")
def stg_staking_events(spark, d):
    e = X.events(spark, d).withColumn("event_name", F.when(F.col("event_type") == "view", "Other").otherwise(F.col("event_name")))
    return marts.stg_staking_events(e, _canonical(spark, d)).select("decoded_event_id", "block_number")


@query(_with(X.BASE) + f" SELECT event_id FROM base WHERE event_id % 4 = 0 AND event_id % 3 <> 0 AND {_FINAL}")
def stg_link_transfers(spark, d):
    """Transfers by any token; a third is of another one."""
    at = F.when(F.col("event_id") % 3 == 0, F.col("contract_address")).when(F.col("event_id") % 3 == 1, F.lit(TOKEN)).otherwise(F.lit(_TOKEN_UPPER))
    e = X.events(spark, d).withColumns({"event_name": F.when(F.col("event_id") % 4 == 0, "Transfer").otherwise("Approval"), "contract_address": at})
    return marts.stg_link_transfers(e, _canonical(spark, d)).select("event_id")


def _calls(spark, d) -> DataFrame:
    """Decoded calls of all frames; roots call a staking method."""
    word = F.lpad(F.lower(F.hex("event_id")), 64, "0")
    frames = _frames(spark, d).withColumn("input", F.concat(F.lit(selector("stake(uint256)")), word))
    return traces.decode_trace_calls(frames, _registry())


_KNOWN = "user_id % 7 < 5 AND NOT block_number BETWEEN 300 AND 399"
_PARENTS = "CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN (event_id - 1) % 7 <> 0 WHEN 2 THEN (event_id - 2) % 7 <> 0 WHEN 3 THEN (event_id - 3) % 7 <> 0 AND (event_id - 2) % 7 <> 0 ELSE (event_id - 4) % 7 <> 0 AND (event_id - 3) % 7 <> 0 END"


@query(_with(X.BASE) + f" SELECT event_id, CASE WHEN {_KNOWN} THEN 'stake' ELSE '<unknown>' END AS method_name, CASE WHEN {_KNOWN} THEN CAST(event_id AS VARCHAR) END AS amount, event_id % 7 <> 0 AS success, {_PARENTS} AS parent_success FROM base WHERE {_FINAL}")
def stg_decoded_trace_calls(spark, d):
    found = marts.stg_decoded_trace_calls(_calls(spark, d), _canonical(spark, d))
    return found.select("event_id", "method_name", F.try_element_at("params", F.lit("amount")).alias("amount"), "success", "parent_success")


@query(_with(X.BASE) + f" SELECT event_id FROM base WHERE event_id % 5 = 0 AND {_KNOWN} AND {_FINAL}")
def stg_staking_calls(spark, d):
    return marts.stg_staking_calls(marts.stg_decoded_trace_calls(_calls(spark, d), _canonical(spark, d))).select("event_id")


@query("SELECT event_id, '0x' || lpad(lower(hex(user_id)), 40, '0') AS holder_address, 'token' AS token_address FROM events")
def stg_balance_snapshots(spark, d):
    s = X.base(spark, d).select("event_id", F.upper("wallet").alias("holder_address"), F.lit("TOKEN").alias("token_address"))
    return marts.stg_balance_snapshots(s.withColumn("holder_address", F.regexp_replace("holder_address", "^0X", "0x")))


@query(_with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS) + " SELECT status, count(*) AS n, CAST(sum(allocated) AS BIGINT) AS allocated FROM edges GROUP BY status")
def stg_action_movement_edges(spark, d):
    e = marts.stg_action_movement_edges(matching.match_actions(X.small_actions(spark, d), X.movements(spark, d)))
    return e.groupBy("status").agg(F.count("*").alias("n"), F.sum("allocated_amount").cast("long").alias("allocated"))


# Intermediate and marts


@query(_with(X.BASE, X.ACTIONS) + f" SELECT action_id, contract_address, wallet FROM actions WHERE {_FINAL}")
def int_economic_actions(spark, d):
    a = X.actions(spark, d).withColumns({"contract_address": F.upper("contract_address"), "wallet": F.upper("wallet")})
    return marts.int_economic_actions(a, _canonical(spark, d)).select("action_id", "contract_address", "wallet")


@query(_with(X.BASE, X.MOVEMENTS) + " SELECT movement_id, from_addr, to_addr, tx_hash FROM movements")
def int_token_movements(spark, d):
    m = X.movements(spark, d).withColumns({c: F.upper(c) for c in ("from_addr", "to_addr", "tx_hash")})
    return marts.int_token_movements(m).select("movement_id", "from_addr", "to_addr", "tx_hash")


@query(_with(X.BASE, X.ACTIONS) + f", p AS (SELECT * FROM actions WHERE cents > 0 AND {_FINAL}) SELECT sha256('ledger_entry|' || action_id || '|' || i) AS entry_id, cents AS amount, block_number FROM p, range(2) AS s(i)")
def ledger_entries(spark, d):
    e = marts.ledger_entries(ledger.staking_entries(X.actions(spark, d)), _canonical(spark, d))
    return e.select("entry_id", F.col("amount_link").cast("long").alias("amount"), "block_number")


# Incremental runs


def growing_inputs(spark, d) -> dict[str, DataFrame]:
    """All inputs of the keyed models; balances are the highest amounts of a pool's block."""
    edges = matching.match_actions(X.small_actions(spark, d), X.movements(spark, d)).withColumn("run_partition_id", F.lit("run-1"))
    snapshots = X.base(spark, d).groupBy("block_number", F.col("contract_address").alias("holder_address")).agg(F.max("cents").cast("decimal(38,0)").alias("balance")).withColumn("token_address", F.lit(TOKEN))
    actions = X.actions(spark, d)
    failures = X.events(spark, d).select(F.col("raw_log_id").alias("raw_id"), "block_number", (F.col("event_type") != "error").alias("success"))
    return {"blocks": X.blocks(spark, d), "economic_actions": actions, "token_movements": X.movements(spark, d), "edges": edges, "ledger": ledger.staking_entries(actions), "balance_snapshots": snapshots, "decode_results": failures}


def caught_up(spark, d, root: str | None = None) -> tuple[Incremental, dict[str, int], dict[str, int]]:
    """Models over all blocks but the last tenth, and then brought up to date; rows written by both runs."""
    inputs = growing_inputs(spark, d)
    top = X.base(spark, d).agg(F.max("block_number")).first()[0] or 0
    state = Incremental(spark, root or shared_folder(spark, "incremental"), span=max(1, top // 20))
    whole = dict(state.run({k: v.where(F.col("block_number") <= top - top // 10) for k, v in inputs.items()}))
    return state, whole, dict(state.run(inputs))


_MODEL_TOTALS = _with(X.BASE, X.ACTIONS, X.MOVEMENTS, X.SMALL_ACTIONS) + f"""
    , f AS (SELECT a.*, {_DAY} AS snapshot_date FROM actions a JOIN blocks b USING (block_number) WHERE a.{_FINAL}),
    p AS (SELECT contract_address AS pool, block_number, max(cents) AS balance FROM base GROUP BY ALL),
    s AS (SELECT balance - lag(balance) OVER (PARTITION BY pool ORDER BY block_number) AS step FROM p)
    SELECT 'int_economic_actions' AS model, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM f
    UNION ALL SELECT 'int_token_movements', count(*), CAST(sum(amount) AS BIGINT) FROM movements
    UNION ALL SELECT 'int_action_movement_recon', count(DISTINCT tx_hash), count(*) FROM edges
    UNION ALL SELECT 'int_pool_balance_deltas', count(*), CAST(sum(step) AS BIGINT) FROM s WHERE step IS NOT NULL
    UNION ALL SELECT 'int_decode_failures', count(*), CAST(sum(block_number) AS BIGINT) FROM base WHERE event_type = 'error'
    UNION ALL SELECT 'ledger_entries', 2 * count(*), CAST(2 * sum(cents) AS BIGINT) FROM f WHERE cents > 0
    UNION ALL SELECT 'staking_link_flows', count(*), CAST(sum(cents) AS BIGINT) FROM f
    UNION ALL SELECT 'wallet_economics', count(*), CAST(sum(x) AS BIGINT) FROM (SELECT sum(CASE WHEN kind = 'stake' THEN -cents WHEN kind IN ('unstake_finalized', 'reward_claimed') THEN cents ELSE 0 END) AS x FROM f GROUP BY wallet, snapshot_date)
    UNION ALL SELECT 'pool_economics', count(*), CAST(sum(top) AS BIGINT) FROM (SELECT DISTINCT contract_address, snapshot_date FROM f) JOIN (SELECT pool, max(balance) AS top FROM p GROUP BY pool) ON pool = contract_address
"""


@query(_MODEL_TOTALS)
def incremental_models(spark, d):
    """Rows and a sum of each keyed model after two runs, the second over the last tenth of the blocks."""
    state, _, _ = caught_up(spark, d)
    amounts = {"int_economic_actions": "amount_link", "int_token_movements": "amount", "int_action_movement_recon": "edge_count", "int_pool_balance_deltas": "observed_delta", "int_decode_failures": "block_number", "ledger_entries": "amount_link", "staking_link_flows": "amount_link", "wallet_economics": "net_flow", "pool_economics": "end_of_day_balance"}
    totals = [state.read(m).agg(F.lit(m).alias("model"), F.count("*").alias("n"), F.sum(x).cast("long").alias("total")) for m, x in amounts.items()]
    return reduce(DataFrame.unionAll, totals)


# Hostile rows, failures and freshness

_K = "event_id % 12"


@query(
    f"""SELECT event_id, CASE {_K}
            WHEN 0 THEN CASE WHEN event_id % 300 < 256 THEN CAST(event_id % 300 AS VARCHAR) END WHEN 1 THEN 'hi' WHEN 5 THEN '0xdeadbeef' WHEN 7 THEN CAST(event_id % 100 - 32768 AS VARCHAR)
            WHEN 9 THEN '115792089237316195423570985008687907853269984665640564039457584007913129639935' WHEN 10 THEN CASE WHEN event_id % 300 < 256 THEN '[1,' || event_id % 300 || ']' END END AS v,
        CASE WHEN {_K} IN (2, 3, 4, 6, 8, 11) OR {_K} IN (0, 10) AND event_id % 300 >= 256 THEN 'abi_mismatch' END AS failure_reason
        FROM events"""
)
def decode_hostile(spark, d):
    """Calldata with numbers beyond their type, bad text, padding and places, of plain and nested types."""
    kinds = ("uint8", "string", "bytes4", "int16", "uint256", "uint8[]")
    abi = [{"type": "function", "name": f"f{i}", "inputs": [{"name": "v", "type": k}]} for i, k in enumerate(kinds)]
    phases = [Phase("0x" + format(4096 + k, "040x"), "pool", "v1", 0, None, "hostile.json") for k in range(7)]
    sel = [selector(f"f{i}({k})") for i, k in enumerate(kinds)]
    word = lambda x: F.lpad(F.lower(F.hex(x)), 64, "0")
    n = lambda x: word(F.lit(x))
    of = F.col("event_id") % 300
    datas = [
        (0, [word(of)]), (1, [n(32), n(2), F.lit("6869" + "0" * 60)]), (1, [n(32), n(1), F.lit("ff" + "0" * 62)]), (1, [n(2**30), n(1)]), (1, [n(32), n(2**31), n(0)]), (2, [F.lit("deadbeef" + "0" * 56)]),
        (2, [F.lit("deadbeef" + "0" * 55 + "1")]), (3, [F.concat(F.lit("f" * 60), F.lower(F.hex(F.col("event_id") % 100 + 0x8000)))]), (3, [n(0x8000)]), (4, [F.lit("f" * 64)]), (5, [n(32), n(2), n(1), word(of)]), (5, [n(32), n(2**40), n(1)]),
    ]
    data = F.get(F.array(*[F.concat(F.lit(sel[i]), *words) for i, words in datas]), (F.col("event_id") % 12).cast("int"))
    calls = X.base(spark, d).select("event_id", "block_number", F.col("contract_address").alias("to_address"), data.alias("input"))
    found = decode_calldata(calls, Registry.of(phases, {"hostile.json": abi}))
    return found.select("event_id", F.try_element_at("params", F.lit("v")).alias("v"), "failure_reason")


@query(_with(X.BASE) + f", r AS (SELECT {_REASON} AS reason FROM base) SELECT count(*) AS total_failures, count(*) FILTER (WHERE reason = 'unknown_topic') AS unknown_topic_count FROM r WHERE reason IS NOT NULL HAVING count(*) > 0 AND count(*) FILTER (WHERE reason = 'unknown_topic') * 100.0 / count(*) > 0.5")
def unknown_signature_share(spark, d):
    return quality.unknown_share(marts.int_decode_failures(decode_logs(_logs(spark, d), _registry())))


@query("SELECT source, CAST(t AS BIGINT) AS latest, 1706400000 - CAST(t AS BIGINT) AS age_seconds, CASE WHEN 1706400000 - t > 21600 THEN 'error' WHEN 1706400000 - t > 3600 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT event_type AS source, max(least(floor(epoch(ts)), 1706400000 - CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 7200 ELSE 90000 END)) AS t FROM events GROUP BY event_type)")
def source_freshness(spark, d):
    """Each type of event as a source of its own, ingested up to now, two hours or more than a day ago."""
    b = X.base(spark, d)
    lag = {"view": 0, "click": 7200}
    tables = {t: b.where(F.col("event_type") == t).select(F.least("timestamp", F.lit(1706400000 - lag.get(t, 90000))).alias("ingested_at")) for t in X.KINDS}
    return scans.source_freshness(tables, 1706400000)


# Large tables


@query("SELECT count(*) AS left_rows, count(*) AS right_rows, CAST(sum(a) AS BIGINT) AS left_amount, CAST(sum(b) AS BIGINT) AS right_amount, count(*) FILTER (WHERE a <> b) AS only_left, count(*) FILTER (WHERE a <> b) AS only_right FROM (SELECT l_suppkey AS a, l_suppkey + CASE WHEN l_orderkey % 997 = 5 THEN 1 ELSE 0 END AS b FROM lineitem)")
def parity_by_digests(spark, d):
    """Two versions of the line items of which one in a thousand differs; keys repeat."""
    rows = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    changed = rows.withColumn("l_suppkey", F.col("l_suppkey") + F.when(F.col("l_orderkey") % 997 == 5, 1).otherwise(0))
    return quality.parity_by_digests(rows, changed, "l_suppkey", ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query(_with(X.BASE) + " SELECT event_id, CASE WHEN user_id % 7 < 5 AND block_number < 300 THEN 'v1' WHEN user_id % 7 < 5 AND block_number >= 400 THEN 'v2' END AS abi_version FROM base")
def abi_phase_bins(spark, d):
    phases = _registry().phase_table(spark).select("phase_address", "from_block", "to_block", "abi_version")
    return in_phase_by_bins(X.base(spark, d), phases, "contract_address", "block_number", 50).select("event_id", "abi_version")


# Streams over the given tables


def _streamed(spark, d) -> DataFrame:
    """The base rows of ``events`` as a stream."""
    schema = X.table(spark, d, "events").schema
    return X.base_of(spark.readStream.schema(schema).parquet(f"{d}/events*.parquet"))


@query(_with(X.BASE) + " SELECT block_number, sha256(CAST(block_number AS VARCHAR)) AS old_hash, sha256(block_number || 'x') AS new_hash FROM base WHERE block_number % 9 = 0 GROUP BY block_number HAVING count(*) > 1")
def stream_reorgs(spark, d):
    """Headers, one with each event; the last event of some blocks sees another hash."""
    b = _streamed(spark, d)
    other = (F.col("block_number") % 9 == 0) & (F.col("log_index") == 9)
    text = F.concat(F.col("block_number").cast("string"), F.when(other, "x").otherwise(""))
    headers = b.select("chain_id", "block_number", F.sha2(text, 256).alias("block_hash"), F.col("event_id").alias("ingested_at"))
    return stateful.drained(stateful.changed_hashes(headers), shared_folder(spark, "reorgs"))[0].select("block_number", "old_hash", "new_hash")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark, d):
    """Each event comes twice."""
    b = _streamed(spark, d).unionAll(_streamed(spark, d)).withColumn("at", F.timestamp_seconds("timestamp"))
    found, _ = stateful.drained(stateful.deduplicated(b, ["event_id"], "at", "40 days"), shared_folder(spark, "deduplicated"))
    return found.select("event_id", "user_id", "event_type")


_WEEK = "date_trunc('week', to_timestamp(b.timestamp) AT TIME ZONE 'UTC')"


@query(_with(X.BASE, _FEES) + f", w AS (SELECT *, {_WEEK} AS week, to_timestamp(b.timestamp) AT TIME ZONE 'UTC' AS posted FROM fees JOIN blocks b USING (block_number) WHERE side IN ('reserves', 'aggregator')) SELECT CAST(CAST(week AS DATE) AS VARCHAR) AS week_start, CASE WHEN tx_hash IN (SELECT tx_hash FROM fees WHERE side = 'aggregator') THEN 'pa_fee_inflow' ELSE 'other_inflow' END AS inflow_source, CAST(sum(cents) AS BIGINT) AS link_inflow, count(DISTINCT tx_hash) AS tx_count FROM w WHERE side = 'reserves' AND week + INTERVAL 7 DAY <= (SELECT max(posted) FROM w) - INTERVAL 2 DAY GROUP BY ALL")
def stream_weeks(spark, d):
    """Inflow of the reserves by week, for the weeks that ended two days before the last posting."""
    entries = _fee_entries_of(_streamed(spark, d)).join(X.blocks(spark, d).select("block_number", F.timestamp_seconds("timestamp").alias("block_time")), "block_number")
    found, _ = stateful.drained(stateful.closed_weeks(entries, "2 days"), shared_folder(spark, "weeks"))
    return found.select(F.col("week_start").cast("string").alias("week_start"), "inflow_source", F.col("link_inflow").cast("long").alias("link_inflow"), "tx_count")


# Movements


@query(_with(X.BASE, X.ACTIONS) + ", m AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 0 ELSE abs(cents) END AS amount FROM actions WHERE event_id % 4 < 3) SELECT sha256('movement|1|' || tx_hash || '|' || wallet || '|' || contract_address || '|' || amount || '|' || log_index) AS movement_id, wallet AS from_addr, contract_address AS to_addr, CAST(amount AS BIGINT) AS amount, sha256('raw_log|1|' || block_number || '|' || tx_hash || '|' || log_index) AS evidence FROM m")
def movements_from_logs(spark, d):
    """Transfers whose parameters go by one of the usual names, some without an amount; a quarter of the events is no transfer."""
    k = F.col("event_id") % 3
    either = lambda a, b: F.when(k == 0, F.lit(a)).otherwise(F.lit(b))
    amount = F.when(F.col("event_id") % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.when(k == 0, "value").when(k == 1, "_value").otherwise("amount"), F.abs("cents").cast("string")))
    e = X.events(spark, d).withColumns({"event_signature": F.when(F.col("event_id") % 4 < 3, F.lit(TRANSFER_TOPIC)).otherwise("0x00"), "indexed_params": F.create_map(either("from", "_from"), F.upper("wallet"), either("to", "_to"), F.col("contract_address")), "data_params": amount})
    m = M.from_logs(e.withColumn("indexed_params", F.transform_values("indexed_params", lambda n, v: F.lower(v))))
    return m.select("movement_id", "from_addr", "to_addr", F.col("amount").cast("long").alias("amount"), F.get("evidence_ids", 0).alias("evidence"))


@query(_with(X.BASE) + f", m AS (SELECT *, wallet AS from_addr, '0x' || lpad(lower(hex(event_id)), 40, '0') AS to_addr, CASE event_id % 5 WHEN 2 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS occurrence FROM base WHERE event_id % 3 = 0 AND event_id % 7 <> 0 AND (event_id // 5) % 4 <> 0 AND {_PARENTS}) SELECT sha256('movement|1|' || tx_hash || '|' || from_addr || '|' || to_addr || '|' || event_id || '|' || occurrence) AS movement_id, from_addr, to_addr, event_id AS amount FROM m")
def movements_from_traces(spark, d):
    """Transfer calls that took effect: no frame above them failed, and neither did the transaction."""
    word = F.lpad(F.lower(F.hex("event_id")), 64, "0")
    frames = _frames(spark, d).withColumns({"to_address": F.when(F.col("event_id") % 3 == 0, F.lit(_TOKEN_UPPER)).otherwise(F.col("to_address")), "input": F.concat(F.lit("0xa9059cbb"), word, word)})
    frames = frames.join(X.base(spark, d).select("event_id", F.col("wallet").alias("from_address")), "event_id")
    receipts = X.base(spark, d).select("tx_hash", (F.expr("event_id div 5") % 4 != 0).cast("int").alias("status")).distinct()
    found = traces.token_transfer_calls(traces.decode_trace_calls(frames, _registry()), TOKEN, receipts, fill_caller=True)
    return M.from_traces(found).select("movement_id", "from_addr", "to_addr", F.col("amount").cast("long").alias("amount"))


_FLAT = _with(X.BASE) + " SELECT tx_hash, p.path AS trace_address, 'CALL' AS call_type, CASE WHEN p.path = '' THEN wallet ELSE contract_address END AS from_address, contract_address AS to_address, CASE WHEN p.path = '' THEN 0 ELSE 1 END AS status_below FROM (SELECT tx_hash, min(wallet) AS wallet, min(contract_address) AS contract_address FROM base GROUP BY tx_hash), (VALUES (''), ('0'), ('1')) AS p(path)"


def _nested(spark, d) -> DataFrame:
    """tx_hash and the JSON of a root with two calls."""
    b = X.base(spark, d).groupBy("tx_hash").agg(F.min("wallet").alias("wallet"), F.min("contract_address").alias("contract_address"))
    leaf = F.struct(F.lit("CALL").alias("type"), F.col("contract_address").alias("from"), F.col("contract_address").alias("to"), F.lit("0x1").alias("value"))
    text = F.to_json(F.struct(F.lit("CALL").alias("type"), F.upper("wallet").alias("from"), F.col("contract_address").alias("to"), F.lit("0x0").alias("value"), F.array(leaf, leaf).alias("calls")))
    return b.select("tx_hash", text.alias("js"))


def _flat(frames: DataFrame) -> DataFrame:
    return frames.select("tx_hash", F.array_join("trace_address", ",").alias("trace_address"), "call_type", "from_address", "to_address", F.col("value").cast("int").alias("status_below"))


@query(_FLAT)
def flattened_frames(spark, d):
    """Nested traces of a root and two calls through the table function."""
    spark.udtf.register("flatten_call_trace", traces.flatten_call_trace())
    return _flat(spark.sql("SELECT tx_hash, t.* FROM {rows}, LATERAL flatten_call_trace(js) t", rows=_nested(spark, d)))


@query(_FLAT)
def flattened_levels(spark, d):
    """The same, level by level in the JVM."""
    return _flat(traces.flatten_trace_json(_nested(spark, d), "js"))


# Actions, postings and balances


@query(_with(X.BASE, X.ACTIONS) + " SELECT action_id, contract_address AS pool_address, 'pool' AS registered_role, CASE WHEN user_id % 7 < 5 AND block_number < 300 THEN 'v1' WHEN user_id % 7 < 5 AND block_number >= 400 THEN 'v2' ELSE 'unknown' END AS contract_phase_version FROM actions")
def enriched_actions(spark, d):
    return A.enrich(X.actions(spark, d), _registry().phase_table(spark)).select("action_id", "pool_address", "registered_role", "contract_phase_version")


@query(_with(X.BASE) + ", m AS (SELECT * FROM base WHERE event_id % 3 = 0 AND cents > 0), e AS (SELECT 'staking_pool_v01:' || contract_address AS account, 'debit' AS direction, 0 AS entry_index, cents FROM m UNION ALL SELECT 'migration_proxy', 'credit', 1, cents FROM m UNION ALL SELECT 'migration_proxy', 'debit', 0, cents FROM m UNION ALL SELECT 'pool:' || contract_address, 'credit', 1, cents FROM m) SELECT account, direction, entry_index, count(*) AS n, CAST(sum(cents) AS BIGINT) AS amount FROM e GROUP BY ALL")
def migration_postings(spark, d):
    """A migration is two actions: out of the old pool, and into the new one."""
    roles = spark.createDataFrame([("0x" + format(4096 + k, "040x"), "pool") for k in range(7)], "role_address string, role string")
    e = X.events(spark, d).withColumn("event_name", F.when(F.col("event_id") % 3 == 0, "Migrated").otherwise("Transfer"))
    return _totals(ledger.staking_entries(A.staking_actions(e, roles)))


@query(_with(X.BASE) + ", k AS (SELECT *, event_id % 5 AS k, CASE WHEN event_id % 5 IN (0, 3) THEN cents WHEN event_id % 5 = 1 OR cents + 1 <> 0 THEN cents + 1 ELSE cents END AS amount FROM base WHERE event_id % 5 < 4), e AS (SELECT CASE k WHEN 0 THEN 'service_contract:' || wallet WHEN 2 THEN 'upstream:' || wallet ELSE 'pa_x:' || contract_address END AS account, 'debit' AS direction, 0 AS entry_index, amount FROM k UNION ALL SELECT CASE k WHEN 1 THEN 'pa_reserves:link' WHEN 3 THEN 'forwarded_to:' || wallet ELSE 'pa_x:' || contract_address END, 'credit', 1, amount FROM k) SELECT account, direction, entry_index, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM e WHERE amount > 0 GROUP BY ALL")
def payment_postings(spark, d):
    """The four kinds of payment actions that are booked, and one that isn't."""
    roles = spark.createDataFrame([("0x" + format(4096 + k, "040x"), "pa_x") for k in range(7)], "role_address string, role string")
    name = F.get(F.array(*[F.lit(n) for n in ("FeeReceived", "SwapExecuted", "Deposited", "Forwarded", "ConfigSet")]), (F.col("event_id") % 5).cast("int"))
    e = X.events(spark, d).withColumns({"event_name": name, "indexed_params": F.create_map(F.lit("sender"), F.col("wallet")), "data_params": F.create_map(F.lit("amountIn"), F.col("cents").cast("string"), F.lit("amountOut"), (F.col("cents") + 1).cast("string"))})
    return _totals(ledger.payment_entries(A.payment_actions(e, roles)))


@query(_with(X.BASE) + ", s AS (SELECT contract_address AS h, block_number AS b, max(cents) AS x FROM base GROUP BY ALL), e AS (SELECT h, b, b - 1 AS p FROM s) SELECT e.h AS holder_address, e.b AS block_number, now.x - old.x AS observed_delta, now.x - old.x - 5 AS difference, now.x - old.x - 5 = 0 AS is_consistent FROM e LEFT JOIN s now ON now.h = e.h AND now.b = e.b LEFT JOIN s old ON old.h = e.h AND old.b = e.p")
def verified_balances(spark, d):
    """Each pool's change since the block before, where it has a snapshot there, against an expected one."""
    s = X.base(spark, d).groupBy(F.col("contract_address").alias("holder_address"), "block_number").agg(F.max("cents").alias("balance"))
    expected = s.select("holder_address", "block_number", (F.col("block_number") - 1).alias("prior_block"), F.lit(5).alias("expected_delta"))
    return balances.verify_balance(s, expected).select("holder_address", "block_number", "observed_delta", "difference", "is_consistent")
