"""From logs and traces to ledger and marts, on rows of a real staking transaction and on small made-up ones."""

import itertools
import json
import random
import time
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywheel.functions import hexes
from tallywheel.functions.fixed import TOKEN, TRANSFER_TOPIC
from tallywheel.operators import actions, balances, decode, ledger, matching, movements, quality, traces
from tallywheel.plans import marts
from tallywheel.sources import rpc, scans, store
from tallywheel.sources.registry import Phase, Registry, in_phase, in_phase_by_bins, validate

TX = "0x08c2902756cb2808c056499225d6dbd40c3e656a3b53fe9d31679fcb8dc15e96"
A, B, C = "0x3feb1e09b4bb0e7f0387cee092a52e85797ab889", "0xedf03cd5075f93174614febf9c6789a3e7581d4c", "0xbc10f2e862ed4502144c7d632a3459f49dfcdb5e"
TRANSFER = {"type": "event", "name": "Transfer", "inputs": [{"name": "from", "type": "address", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]}
REGISTRY = Registry.of([Phase(TOKEN, "link_token", "v1", 0, None, "token.json")], {"token.json": [TRANSFER]})
LOG = "chain_id int, block_number long, tx_hash string, log_index int, address string, topics array<string>, data string"


def padded(address):
    return "0x" + "0" * 24 + address[2:]


def word(n):
    return format(n, "064x")


@pytest.fixture(scope="module")
def logs(spark):
    t = [TRANSFER_TOPIC]
    return spark.createDataFrame(
        [
            (1, 18671459, TX, 138, TOKEN, [*t, padded(A), padded(B)], "0x" + word(146492534952176000000)),
            (1, 18671459, TX, 140, TOKEN.upper().replace("X", "x"), [*t, padded(B), padded(C)], "0x" + word(146 * 10**18)),
            (1, 18671459, TX, 141, C, [*t, padded(B), padded(C)], "0x" + word(1)),
            (1, 18671459, TX, 142, TOKEN, ["0x" + "11" * 32], "0x"),
            (1, 18671459, TX, 143, TOKEN, [], "0x"),
            (1, 18671459, TX, 144, TOKEN, [*t, padded(A)], "0x" + word(1)),
            (1, 18671459, TX, 145, TOKEN, [*t, padded(A), padded(B)], "0x"),
            (1, 18671459, TX, 146, TOKEN, [*t, padded(A), padded(B)], "0x123"),
            (1, 18671459, TX, 147, TOKEN, [*t, padded(A), padded(B)], "0x" + "f" * 64),
        ],
        LOG,
    )


def test_decode_ladder(spark, logs):
    got = {r["log_index"]: r["failure_reason"] for r in decode.decode_logs(logs, REGISTRY).collect()}
    assert got == {138: None, 140: None, 141: "unregistered_contract", 142: "unknown_topic", 143: "unknown_topic", 144: "abi_mismatch", 145: "malformed_data", 146: "malformed_data", 147: None}
    row = decode.decode_logs(logs, REGISTRY).where("log_index = 147").first()
    assert row["data_params"] == {"value": str(2**256 - 1)} and movements.from_logs(decode.decode_logs(logs, REGISTRY).where("log_index = 147")).first()["amount"] is None


def test_movements_of_the_staking_transaction(spark, logs):
    found = movements.from_logs(decode.decode_logs(logs, REGISTRY).where("success"))
    assert {r["movement_id"] for r in found.where("amount IS NOT NULL").collect()} == {"df44807deef23a67a68c34bc9e35e1bd7afd084c39b764b8c9ccd5b88539941f", "c517c54fbd534d793483205479969eee2b7098bcd21113647596fcad0aa7431d"}


def test_dynamic_and_signed_values(spark):
    abi = [{"type": "event", "name": "E", "inputs": [{"name": "s", "type": "string"}, {"name": "n", "type": "int256"}, {"name": "b", "type": "bytes4"}]}]
    reg = Registry.of([Phase(C, "r", "v", 0, None, "e")], {"e": abi})
    topic = reg._items("event")[0][1]
    data = "0x" + word(96) + format(2**256 - 5, "064x") + "deadbeef" + "0" * 56 + word(2) + "6869" + "0" * 60
    row = decode.decode_logs(spark.createDataFrame([(1, 1, TX, 0, C, [topic], data)], LOG), reg).first()
    assert row["data_params"] == {"s": "hi", "n": "-5", "b": "0xdeadbeef"}


def test_numbers_of_all_sizes(spark):
    rnd = random.Random(1)
    numbers = [0, 1, 10**9 - 1, 10**9, 10**38 - 1, 10**38, 2**128 - 1, 2**128, 2**255 - 1, 2**255, 2**256 - 1, *(rnd.getrandbits(rnd.randint(100, 256)) for _ in range(40))]
    rows = spark.createDataFrame([(format(n, "064x"),) for n in numbers], "w string")
    got = rows.select(hexes.word_to_text("w"), decode._signed(F.col("w"))).collect()
    assert [r[0] for r in got] == [str(n) for n in numbers]
    assert [r[1] for r in got] == [str(n - 2**256 if n >> 255 else n) for n in numbers]
    assert spark.createDataFrame([("12",), (None,), ("g" * 64,)], "w string").select(hexes.word_to_text("w")).distinct().collect() == [(None,)]


def test_arrays_tuples_and_anonymous_events(spark):
    pair = {"name": "p", "type": "tuple[]", "components": [{"name": "x", "type": "uint256"}, {"name": "y", "type": "string"}]}
    abi = [
        {"type": "event", "name": "Many", "inputs": [{"name": "who", "type": "address", "indexed": True}, {"name": "ns", "type": "uint256[]"}, {"name": "fixed", "type": "int8[2]"}, {"name": "ok", "type": "bool"}, pair]},
        {"type": "event", "name": "Quiet", "anonymous": True, "inputs": [{"name": "n", "type": "uint256"}]},
        {"type": "event", "name": "Other", "anonymous": True, "inputs": []},
        {"type": "function", "name": "send", "inputs": [{"name": "to", "type": "address[]"}, {"name": "note", "type": "string"}]},
    ]
    reg = Registry.of([Phase(C, "r", "v", 0, None, "e")], {"e": abi})
    topic = next(key for _, key, name, _ in reg._items("event") if name == "Many")
    head = word(160) + word(1) + format(2**256 - 2, "064x") + word(1) + word(256)
    arrays = word(2) + word(7) + word(2**200)
    tuples = word(1) + word(32) + word(5) + word(64) + word(2) + "6869" + "0" * 60
    data = "0x" + head + arrays + tuples
    rows = [(0, [topic, padded(A)], data), (1, [topic, padded(A)], data[:-64]), (2, [], "0x" + word(9)), (3, None, "0x" + word(9)), (4, [], "0x"), (5, [topic], data), (6, [topic, padded(A)], "0x" + word(2**255) * 9)]
    logs = spark.createDataFrame([(1, 1, TX, i, C, t, d) for i, t, d in rows], LOG)
    got = {r["log_index"]: r for r in decode.decode_logs(logs, reg).collect()}
    assert got[0]["indexed_params"] == {"who": A} and got[0]["data_params"] == {"ns": f"[7,{2**200}]", "fixed": "[1,-2]", "ok": "true", "p": '[[5,"hi"]]'}
    assert {i: r["failure_reason"] for i, r in got.items()} == {0: None, 1: "abi_mismatch", 2: None, 3: None, 4: "malformed_data", 5: "abi_mismatch", 6: "abi_mismatch"}
    assert got[2]["event_name"] == "Quiet" and got[2]["event_signature"] == "" and got[3]["data_params"] == {"n": "9"}
    body = word(64) + word(160) + word(2) + "0" * 24 + A[2:] + "0" * 24 + B[2:] + word(2) + "6869" + "0" * 60
    key = reg._items("function")[0][1]
    calls = spark.createDataFrame([(1, C, key + body), (1, C, key + body[:128])], "block_number long, to_address string, input string")
    a, b = decode.decode_calldata(calls, reg).collect()
    assert a["method_name"] == "send" and a["params"] == {"to": f'["{A}","{B}"]', "note": "hi"} and b["failure_reason"] == "abi_mismatch"


HOSTILE = {
    "uint8": ("uint8", [word(255), word(256), "f" * 64], ["255", None, None]),
    "int8": ("int8", [word(127), word(128), "f" * 62 + "80", "f" * 62 + "7f"], ["127", None, "-128", None]),
    "bytes2": ("bytes2", ["abcd" + "0" * 60, "abcd" + "0" * 59 + "1"], ["0xabcd", None]),
    "address": ("address", ["0" * 23 + "1" + "0" * 40], [None]),
    "bool": ("bool", [word(2)], [None]),
    "string": (
        "string",
        [word(32) + word(2) + "6869" + "0" * 60, word(32) + word(1) + "ff" + "0" * 62, word(32) + word(2) + "6869" + "1" * 60, word(32) + word(2**30) + word(0), word(2**30) + word(1), word(2**31) + word(1), word(2**62) + word(1), "f" * 64, word(32) + "f" * 64, word(32) + word(0), word(64) + word(0)],
        ["hi", None, None, None, None, None, None, None, None, "", None],
    ),
    "bytes": ("bytes", [word(32) + word(1) + "ff" + "0" * 62, word(32) + word(33) + word(1)], ["0xff", None]),
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
@pytest.mark.parametrize("nested", [False, True])
def test_hostile_values(spark, name, nested):
    """Data that doesn't fit its type is a failure with a reason, in the JVM as beside an array in Python."""
    kind, datas, want = HOSTILE[name]
    inputs = [{"name": "v", "type": kind}] + ([{"name": "none", "type": "uint256[0]"}] if nested else [])
    abi = [{"type": "function", "name": "f", "inputs": inputs}]
    reg = Registry.of([Phase(C, "r", "v", 0, None, "e")], {"e": abi})
    sel = reg._items("function")[0][1]
    calls = spark.createDataFrame([(i, 1, C, sel + d) for i, d in enumerate(datas)], "i int, block_number long, to_address string, input string")
    got = {r["i"]: r for r in decode.decode_calldata(calls, reg).collect()}
    assert [got[i]["params"].get("v") for i in range(len(datas))] == want
    assert [got[i]["failure_reason"] for i in range(len(datas))] == [None if v is not None else "abi_mismatch" for v in want]


def test_hostile_traces(spark):
    spark.udtf.register("flatten_call_trace", traces.flatten_call_trace())
    deep = {"type": "CALL", "value": "0x" + "f" * 64}
    for n in range(120):
        deep = {"type": "CALL", "from": A.upper(), "to": "" if n % 3 else B, "gas": "0x5", "gasUsed": 7, "error": "out of gas" if n == 60 else None, "revertReason": "", "calls": [{"input": "0x", "output": "0x1"}, deep]}
    texts = ["{", "[1]", "null", '{"type": "CALL", "value": "0x"}', '{"value": 7, "calls": [5, {"from": 3, "value": "0xg"}]}', "", None, '{"calls": {"type": "CALL"}}', "[" * 100000, json.dumps(deep), json.dumps(TRACE), '{"calls": null, "value": "0x' + "1" * 65 + '"}', '{"error": {"b": 1, "a": []}, "calls": []}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, js string")
    both = spark.sql("SELECT i, t.* FROM {rows}, LATERAL flatten_call_trace(js) t", rows=rows), traces.flatten_trace_json(rows, "js")
    assert both[0].columns == both[1].columns
    table, levels = ([str(tuple(r)) for r in df.orderBy("i", "trace_address").collect()] for df in both)
    assert table == levels
    got = [(r["i"], list(r["trace_address"]), r["value"], r["problem"]) for r in both[0].collect() if r["i"] not in (9, 10)]
    assert sorted(got) == [(0, [], None, "malformed_json"), (1, [], None, "malformed_frame"), (2, [], None, "malformed_frame"), (3, [], None, "malformed_value"), (4, [], None, "malformed_value"), (4, [0], None, "malformed_frame"), (4, [1], None, "malformed_value"), (7, [], "0", "malformed_calls"), (8, [], None, "malformed_json"), (11, [], None, "malformed_value"), (12, [], "0", None)]
    assert "Python" not in both[1]._jdf.queryExecution().executedPlan().toString()


def test_amounts_beyond_38_digits_in_transfer_calls(spark):
    frames = spark.createDataFrame([(1, 5, TX, [], A, TOKEN, "0xa9059cbb" + padded(C)[2:] + "f" * 64, None)], "chain_id int, block_number long, tx_hash string, trace_address array<int>, from_address string, to_address string, input string, error string")
    got = traces.token_transfer_calls(traces.decode_trace_calls(frames, REGISTRY), TOKEN, spark.createDataFrame([(TX, 1)], "tx_hash string, status int")).first()
    assert got["amount"] is None and got["params"]["amount"] == str(2**256 - 1)


def test_ancestors_by_one_pass(spark):
    """Random trees, a chain of a thousand frames, twin paths and frames without a transaction against a look at each prefix."""
    rnd, rows = random.Random(3), []
    for t in range(40):
        paths = [[]]
        for _ in range(rnd.randint(0, 60)):
            above = rnd.choice(paths)
            paths.append([*above, sum(len(p) == len(above) + 1 and p[:-1] == above for p in paths)])
        rows += [(f"t{t}", p, "x" if rnd.random() < 0.1 else None) for p in paths]
    rows += [("deep", [0] * n, "x" if n == 700 else None) for n in range(1000)] + [("deep", [0] * 700 + [1], None), ("deep", [1], None)]
    rows += [("twin", [0], "x"), ("twin", [0], "x"), ("twin", [0], None), ("twin", [0, 3], None), (None, [0], "x"), (None, [0, 1], None), ("top", [], "x"), ("top", [2**31 - 2], None)]
    frames = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tx_hash string, trace_address array<int>, error string")
    failed = {(t, tuple(p)) for t, p, e in rows if e and t is not None}
    found = traces.with_ancestor_success(frames)
    got = {r["i"]: r["parent_success"] for r in found.collect()}
    assert got == {i: not any((t, tuple(p[:n])) in failed for n in range(len(p))) for i, (t, p, _) in enumerate(rows)}
    plan = traces.with_ancestor_success(frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_fast_transfer(spark):
    data = "0xa9059cbb" + "0" * 24 + A[2:] + word(7) + "ff"
    r = spark.createDataFrame([(data,), (data[:100],), ("0x",)], "d string").select(decode.fast_transfer(F.col("d")).alias("x")).collect()
    assert [x["x"]["method"] for x in r] == ["transfer", None, None] and r[0]["x"]["params"] == {"from": None, "to": A, "amount": "7"}


TRACE = {"type": "CALL", "from": A, "to": B, "value": "0x0", "calls": [{"type": "CALL", "from": B, "to": TOKEN, "value": "0x0", "input": "0xa9059cbb" + "0" * 24 + C[2:] + word(5)}, {"type": "CALL", "from": B, "to": C, "error": "reverted", "calls": [{"type": "CALL", "from": C, "to": TOKEN, "value": "0x1", "input": "0xa9059cbb" + "0" * 24 + A[2:] + word(9)}]}]}


def test_traces_to_movements(spark):
    spark.udtf.register("flatten_call_trace", traces.flatten_call_trace())
    rows = spark.createDataFrame([(1, 5, TX, json.dumps(TRACE))], "chain_id int, block_number long, tx_hash string, js string")
    frames = spark.sql("SELECT chain_id, block_number, tx_hash, t.* FROM {rows}, LATERAL flatten_call_trace(js) t", rows=rows)
    assert [(list(r["trace_address"]), r["status"]) for r in traces.preorder(frames).collect()] == [([], 1), ([0], 1), ([1], 0), ([1, 0], 0)]
    assert traces.trace_problems(frames).count() == 0
    calls = traces.decode_trace_calls(frames, REGISTRY)
    receipts = spark.createDataFrame([(TX, 1)], "tx_hash string, status int")
    got = traces.token_transfer_calls(calls, TOKEN, receipts, fill_caller=True)
    assert [(r["from_addr"], r["to_addr"], int(r["amount"])) for r in got.collect()] == [(B, C, 5)]
    assert traces.token_transfer_calls(calls, TOKEN, receipts.withColumn("status", F.lit(0))).count() == 0
    assert movements.from_traces(got).first()["source_priority"] == "trace"
    path = balances.inflow_paths(got.select("tx_hash", "trace_address"), frames).first()["path"]
    assert path == [B, TOKEN]


def test_malformed_trees(spark):
    f = spark.createDataFrame([("a", [0]), ("b", []), ("b", []), ("c", []), ("c", [0, 1])], "tx_hash string, trace_address array<int>")
    assert {tuple(r) for r in traces.trace_problems(f).collect()} == {("a", "no_root"), ("a", "missing_parent"), ("b", "duplicate_path"), ("c", "missing_parent")}


MOVE = "movement_id string, chain_id int, block_number long, tx_hash string, token_address string, from_addr string, to_addr string, amount decimal(38,0), evidence_ids array<string>, source_priority string, is_canonical boolean, position array<int>"


def move(i, source, amount=5, tx="t", at=0):
    return (i, 1, 1, tx, TOKEN, A, B, Decimal(amount), [i], source, True, [at])


def test_unify(spark):
    m = spark.createDataFrame([move("l1", "log", at=1), move("l2", "log", at=2), move("t1", "trace", at=0), move("t2", "trace", at=1), move("l3", "log", 9), move("t3", "trace", 8), move("t4", "trace", 8, at=1), move("l4", "log", 8), move("same", "log", 7), move("same", "trace", 7)], MOVE)
    got = {r["movement_id"]: r["evidence_ids"] for r in movements.unify(m).collect()}
    assert got == {"l1": ["l1", "t1"], "l2": ["l2", "t2"], "l3": ["l3"], "t3": ["t3"], "t4": ["t4"], "l4": ["l4"], "same": ["same"]}


ACTION = "action_id string, kind string, chain_id int, block_number long, tx_hash string, amount_link decimal(38,0)"


@pytest.mark.parametrize("amounts, target, kind, expected", [([100], 100, "stake", ["exact"]), ([60, 40], 100, "stake", ["partial", "partial"]), ([50], 100, "stake", ["unmatched"]), ([100, 100], 100, "stake", ["ambiguous"]), ([], 100, "stake", ["unmatched"]), ([0], 0, "stake", ["unmatched"]), ([100], 100, "reward_accrued", ["not_expected"])])
def test_matching(spark, amounts, target, kind, expected):
    a = spark.createDataFrame([("a", kind, 1, 1, "T", Decimal(target))], ACTION)
    m = spark.createDataFrame([move(f"m{i}", "log", x, "t", i) for i, x in enumerate(amounts)], MOVE)
    assert sorted(r["status"] for r in matching.match_actions(a, m).collect()) == expected


def test_first_batch_is_the_first_by_size_and_order():
    assert matching.first_batch([1, 2, 3, 4], 5) == [0, 3]
    assert matching.first_batch([1] * 7, 6) == [0, 1, 2, 3, 4, 5] and matching.first_batch([1] * 7, 7) is None and matching.first_batch([1, -1], 0) is None


def test_first_batch_against_all_combinations():
    rnd = random.Random(2)
    for _ in range(300):
        amounts = [rnd.randint(1, 30) for _ in range(rnd.randint(0, 9))]
        target = rnd.randint(1, 90)
        every = (list(c) for size in range(2, 7) for c in itertools.combinations(range(len(amounts)), size) if sum(amounts[i] for i in c) == target)
        assert matching.first_batch(amounts, target) == next(every, None)
    many = [2 * rnd.randint(10**6, 10**9) for _ in range(60)]
    assert matching.first_batch(many, 10**9 + 1) is None  # all amounts are even
    assert sum(many[i] for i in matching.first_batch(many, sum(many[7:13]))) == sum(many[7:13])


def test_first_batch_of_large_transactions():
    """Wide tables, met by remainders and in parts, against all combinations, and a thousand movements in seconds."""
    rnd = random.Random(12)
    for k in range(6):
        amounts = [rnd.randint(1, 10**30) for _ in range(90)]
        amounts[5] = amounts[4]
        pick = sorted(rnd.sample(range(90), 2 + k % 5)) if k else [4, 5, 20]
        target = sum(amounts[p] for p in pick)
        whole = matching.first_batch(amounts, target)
        assert whole is not None and sum(amounts[p] for p in whole) == target and (len(whole), whole) <= (len(pick), pick)
        split = [x for x in (matching.first_batch(amounts, target, part=p, parts=7) for p in range(7)) if x]
        assert min(split, key=lambda x: (len(x), x)) == whole
    small = [rnd.randint(1, 40) for _ in range(100)]
    few = [2 * x for x in small[:12]]
    assert matching.first_batch([*few, *[10**9] * 90], 10**6) is None
    assert matching.first_batch([*[10**9 + k for k in range(90)], 3, 4, 5, 6, 7, 8], 33) == [90, 91, 92, 93, 94, 95]
    many = [2 * rnd.randint(10**20, 10**24) for _ in range(200)]
    began = time.perf_counter()
    assert matching.first_batch(many, sum(many[:6]) + 1) is None and time.perf_counter() - began < 4
    many = [rnd.randint(10**20, 10**24) for _ in range(1000)]
    began = time.perf_counter()
    matching.first_batch(many, sum(many[10:16]), part=3, parts=500)
    assert time.perf_counter() - began < 4


def test_dealt_actions_match_alike(spark):
    rnd = random.Random(3)
    m = spark.createDataFrame([move(f"m{t}-{i:03}", "log", rnd.randint(1, 10**9), f"t{t}", i) for t in range(3) for i in range(100)], MOVE)
    amounts = [int(r["amount"]) for r in m.where("tx_hash = 't1'").orderBy("movement_id").collect()]
    a = spark.createDataFrame([(f"a{k}", "stake", 1, 1, "t1", Decimal(sum(amounts[3 * k : 3 * k + k])) if k else Decimal(7)) for k in range(7)] + [("b", "stake", 1, 1, "t2", Decimal(11))], ACTION)
    plain, dealt = (sorted(str(tuple(r)) for r in matching.match_actions(a, m, **how).collect()) for how in ({}, {"deal_above": 50, "parts": 5}))
    assert plain == dealt and sum("partial" in r for r in plain) == 2 + 3 + 4 + 5 + 6


def test_reasons_and_methods_of_edges(spark):
    a = spark.createDataFrame([("a", "stake", 1, 1, "T", Decimal(9)), ("b", "reward_accrued", 1, 1, None, None), ("c", "stake", 1, 1, "t", None), ("d", None, 1, 1, "t", Decimal(4)), ("e", "stake", 1, 1, None, Decimal(1)), ("f", "slashed", 1, 1, "t", Decimal(100))], ACTION)
    m = spark.createDataFrame([move("m1", "log", 4), move("m2", "trace", 5)], MOVE)
    got = {(r["action_id"], r["movement_id"]): (r["status"], r["method"], r["reason"]) for r in matching.match_actions(a, m).collect()}
    assert got == {
        ("a", "m1"): ("partial", "event_log", "batched movement 1/2"),
        ("a", "m2"): ("partial", "trace", "batched movement 2/2"),
        ("b", None): ("not_expected", None, "reward_accrued has no expected token movement"),
        ("c", None): ("unmatched", None, "no movements in tx for this action"),
        ("d", "m1"): ("exact", "event_log", "exact amount match"),
        ("e", None): ("unmatched", None, "no movements in tx for this action"),
        ("f", None): ("unmatched", None, "no subset of 2 movements sums to 100"),
    }


def test_transfer_parameters(spark):
    rows = [("a", {"_from": A, "to": B}, {"_value": "5", "from": C}), ("b", {"from": A}, {"to": B}), ("c", {"from": A, "value": "1"}, {"value": "2"}), ("d", {}, None)]
    e = spark.createDataFrame([(f"d{i}", i, 1, 1, "t", 0, C, "Transfer", TRANSFER_TOPIC.upper().replace("X", "x"), x, y) for i, x, y in rows], EVENT)
    got = {r["evidence_ids"][0]: (r["from_addr"], r["to_addr"], int(r["amount"])) for r in movements.from_logs(e).collect()}
    assert got == {"a": (A, B, 5), "b": (A, "", 0), "c": (A, "", 2), "d": ("", "", 0)}


def test_gaps_over_stretches(spark):
    from tallywheel.operators import blocks

    rows = [(1, n) for n in [*range(0, 25), *range(31, 60), 95, 200]] + [(2, 5)]
    b = spark.createDataFrame(rows, "chain_id int, block_number long")
    for span in (7, 10, 1000):
        got = {(r["block_number"], r["next_block"], r["missing"]) for r in blocks.block_gaps(b, span).collect()}
        assert got == {(24, 31, 6), (59, 95, 35), (95, 200, 104)}


def test_unbalanced_transactions_are_named(spark):
    e = spark.createDataFrame([(f"t{i:02}", "debit", Decimal(1)) for i in range(40)], "tx_hash string, direction string, amount_link decimal(38,0)")
    r = quality.ledger_balanced(e).first()
    assert not r["passed"] and r["metric_value"] == 40 and r["detail"] == "40 unbalanced: " + ", ".join(f"t{i:02}" for i in range(10))
    assert quality.ledger_balanced(e.limit(0)).first()["passed"]


def test_sql_ids_agree_with_the_columns(spark):
    from tallywheel.functions import ids, sql

    sql.register(spark)
    rows = spark.createDataFrame([(1, 5, "0xAB", 2), (None, 5, None, 2), (1, None, "x", None), (None, None, None, None)], "c int, b long, t string, i int")
    for name in ("raw_log_id", "decoded_event_id"):
        a = [r[0] for r in spark.sql(f"SELECT {name}(c, b, t, i) FROM {{rows}}", rows=rows).collect()]
        assert a == [r[0] for r in rows.select(getattr(ids, name)("c", "b", "t", "i")).collect()]


def test_merge_of_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", 0), (None, "n", 0), (3, "c", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2), (None, "m", 1), (4, "d", 1), (4, "d", 1)], "k int, v string, at int")
    got = Counter(tuple(r) for r in store.merged(old, new, ["k"], by=["at"]).collect())
    assert got == Counter([(1, "y", 3), (None, "m", 1), (3, "c", 0), (4, "d", 1)])


def test_table_by_ranges_of_blocks(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ["block_number", "i"], by_block="block_number", span=10)
    rows = lambda *x: spark.createDataFrame(x, "block_number long, i int, v string")
    t.merge(rows((1, 0, "a"), (11, 0, "b"), (12, 0, "c")))
    before = t.folders()
    got = t.merge(rows((12, 0, "C"), (25, 1, "d"), (None, 1, "e")))
    assert sorted((r["block_number"] or 0, r["v"]) for r in got.collect()) == [(0, "e"), (1, "a"), (11, "b"), (12, "C"), (25, "d")]
    after = t.folders()
    assert after["0"] == before["0"] and after["1"] != before["1"] and set(after) == {"0", "1", "2", "-1"}
    t.vacuum()
    assert t.read().count() == 5 and not (tmp_path / "t" / before["1"]).exists()
    t.replace(rows((99, 0, "z")))
    assert t.read().count() == 1
    t.replace(rows((1, 0, "a")).limit(0))
    assert t.read() is None


def test_replay_of_reorgs(spark, tmp_path):
    from tallywheel.streaming.microbatch import replay_reorgs

    known = spark.createDataFrame([(1, n, f"h{n}") for n in range(10)], "chain_id int, block_number long, block_hash string")
    seen = known.withColumn("block_hash", F.when(F.col("block_number").isin(4, 7), "other").otherwise(F.col("block_hash")))
    check = store.Checkpoint(str(tmp_path / "cp.json"))
    assert replay_reorgs(known, seen, check, 1, "logs") == 2 and check.pending_replays(1, "logs") == [(4, 7)]
    assert replay_reorgs(known, known, check, 1, "blocks") == 0 and check.pending_replays(1, "blocks") == []


def test_partition(spark):
    a = spark.createDataFrame([("a", "stake", 1, 1, "t1", Decimal(5)), ("b", "stake", 1, 1, "t2", Decimal(5))], ACTION)
    m = spark.createDataFrame([move("x", "log", 5, "t1"), move("y", "log", 1, "t3")], MOVE)
    e = matching.match_transactions(a, m)
    txs = a.select("tx_hash").union(m.select("tx_hash"))
    r = matching.partition_status(e, txs, 1, 1, 1).first()
    assert r["tx_count"] == 3 and r["counts_by_status"] == {"exact": 1, "partial": 0, "unmatched": 1, "ambiguous": 0, "not_expected": 0, "unexpected": 1} and r["pass_rate"] == pytest.approx(1 / 3)
    assert matching.partition_status(e.limit(0), txs.limit(0), 1, 1, 1).first()["pass_rate"] == 1.0


EVENT = "decoded_event_id string, raw_log_id string, chain_id int, block_number long, tx_hash string, log_index int, contract_address string, event_name string, event_signature string, indexed_params map<string,string>, data_params map<string,string>"


def test_actions_and_postings(spark):
    names = ["Staked", "Unstaked", "RewardClaimed", "RewardAdded", "Slashed", "Migrated", "UnstakeRequested", "Other"]
    e = spark.createDataFrame([(f"d{i}", f"r{i}", 1, 1, "t", i, C, n, "s", {"staker": A.upper().replace("X", "x")}, {"amount": "10"}) for i, n in enumerate(names)], EVENT)
    roles = spark.createDataFrame([(C, "pool")], "role_address string, role string")
    acts = actions.staking_actions(e, roles)
    assert sorted((r["kind"], r["pool_role"]) for r in acts.collect() if r["kind"].startswith("migrated")) == [("migrated_from_v01", "pool"), ("migrated_from_v01", "staking_pool_v01")]
    entries = ledger.staking_entries(acts)
    assert entries.count() == 14 and ledger.unbalanced(entries).count() == 0
    got = {(r["account"], r["direction"]) for r in entries.collect()}
    assert {(f"wallet:{A}", "debit"), (f"pool:{C}", "credit"), ("pool:rewards", "debit"), ("reward_funder", "debit"), ("pool:forfeiture_sink", "credit"), ("migration_proxy", "debit"), (f"staking_pool_v01:{C}", "debit")} <= got
    pay = spark.createDataFrame([(f"d{i}", f"r{i}", 1, 1, "t", i, C, n, "s", {"sender": A}, {"amountIn": "3", "amountOut": out}) for i, (n, out) in enumerate([("FeeReceived", "0"), ("SwapExecuted", "9"), ("Deposited", "0"), ("Forwarded", "0"), ("ConfigSet", "0")])], EVENT)
    made = actions.payment_actions(pay, spark.createDataFrame([(C, "pa_x")], "role_address string, role string"))
    booked = ledger.payment_entries(made)
    assert sorted((r["account"], int(r["amount_link"])) for r in booked.where("direction = 'debit'").collect()) == sorted([(f"service_contract:{A}", 3), (f"pa_x:{C}", 9), (f"upstream:{A}", 3), (f"pa_x:{C}", 3)])
    assert actions.staking_actions(pay, spark.createDataFrame([(C, "pa_x")], "role_address string, role string")).count() == 0


def test_registry_rejects_overlaps():
    with pytest.raises(ValueError):
        validate([Phase(C, "r", "a", 0, None), Phase(C, "r", "b", 10, 20)])
    r = Registry.of([Phase(C, "r", "a", 0, 9), Phase(C, "r", "b", 10, None)], {})
    assert r.phase(C.upper().replace("X", "x"), 9).abi_version == "a" and r.phase(C, 10).abi_version == "b" and r.list_active(3) == [C]
    with pytest.raises(KeyError):
        r.phase(A, 1)


def test_graph():
    assert marts.layering_problems() == []
    names = marts.order()
    assert names.index("stg_canonical_blocks") < names.index("ledger_entries") < names.index("weekly_reserve_accumulation")


def test_build(spark):
    blocks = spark.createDataFrame([(1, 5, "h", "p", 1701190703, 1)], "chain_id int, block_number long, block_hash string, parent_hash string, timestamp long, ingested_at long")
    entries = spark.createDataFrame([("e", "a", 1, "pa_reserves:link", "credit", Decimal(7), 1, 5, "t", "run")], "entry_id string, action_id string, entry_index int, account string, direction string, amount_link decimal(38,0), chain_id int, block_number long, tx_hash string, run_partition_id string")
    got = marts.build({"blocks": blocks, "ledger": entries}, ["weekly_reserve_accumulation", "fee_attribution_by_source"], depth=0)
    r = got["weekly_reserve_accumulation"].first()
    assert (str(r["week_start"]), r["inflow_source"], int(r["link_inflow"]), r["tx_count"]) == ("2023-11-27", "other_inflow", 7, 1)
    assert got["fee_attribution_by_source"].count() == 0


def test_checks(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",)], "decoded_event_id string")
    got = quality.all_checks(quality.no_duplicate_ids(ids), quality.unknown_signatures(ids.withColumn("failure_reason", F.lit("unknown_topic")), 0.5, 1000)).collect()
    assert [(r["passed"], r["metric_value"]) for r in got] == [(False, 1.0), (True, 0.3)]
    assert quality.alert_text(got[0]).startswith("[CRITICAL] no_duplicate_event_ids")


def test_seed_files(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    columns = [f.split(" ")[0] for f in scans.SEEDS["seed_token_movements"].replace("(38,0)", "").split(", ")]
    with open(path, "w") as f:
        f.write(",".join(columns) + "\n" + 'm1,1,5,t,tok,,b,12345678901234567890123456789,"[""a"",""b""]",trace,true,run\nm2,1,5,t,tok,a,b,1,not json,log,false,run\n')
    a, b = scans.read_seed(spark, path, "seed_token_movements").orderBy("movement_id").collect()
    assert a["from_addr"] is None and a["evidence_ids"] == ["a", "b"] and a["amount"] == Decimal("12345678901234567890123456789") and a["is_canonical"] is True
    assert b["evidence_ids"] is None
    assert len(scans.SEEDS) == 8 and all(spark.createDataFrame([], ddl).columns for ddl in scans.SEEDS.values())


def test_freshness_by_source(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "ingested_at long")
    got = {r["source"]: (r["age_seconds"], r["status"]) for r in scans.source_freshness({"a": t(1, 10_000), "b": t(6399), "c": t(None), "d": t(20_000), "e": t(10_000 - 6 * 3600 + 1)}, 10_000).collect()}
    assert got["a"] == (0, "pass") and got["b"] == (3601, "warn") and got["c"][1] == "error" and got["d"] == (0, "pass")
    assert scans.source_freshness({"b": t(1)}, 6 * 3600 + 2).first()["status"] == "error"


def test_unknown_share(spark):
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "failure_reason string")
    assert quality.unknown_share(f("unknown_topic", "abi_mismatch"), 50.0).count() == 0 and quality.unknown_share(f("unknown_topic", "abi_mismatch")).first()["total_failures"] == 2
    assert quality.unknown_share(f("x").limit(0)).count() == 0


def test_parity_by_digests(spark):
    """Same figures as by rows, with nulls, repeats and empty tables; only rows near differences are compared."""
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, "x", "y"]), rnd.randint(0, 5)) for i in range(3000)] * 2
    left = spark.createDataFrame(rows, "i long, s string, a long")
    for other in (rows, rows[:-1], [*rows, rows[7]], [(i, s, a + (i == 1234)) for i, s, a in rows], [], [(None, None, None)]):
        right = spark.createDataFrame(other, "i long, s string, a long")
        for x, y in ((left, right), (right, left)):
            assert quality.parity_by_digests(x, y, "a", ["i", "s"], 64).first().asDict() == quality.parity(x, y, "a", ["i", "s"]).fillna({"only_left": 0, "only_right": 0}).first().asDict()
    _, compared = quality.differing_rows(left, left.withColumn("a", F.when(F.col("i") == 1234, 99).otherwise(F.col("a"))), "a", ["i", "s"], 64)
    assert {r["i"] for r in compared.collect()} >= {1234} and compared.count() < 100


def test_phases_by_bins(spark):
    rnd = random.Random(6)
    phases = [(f"p{k % 7}", 100 * (k // 7), 100 * (k // 7) + rnd.choice([99, 99, 40]), f"v{k}") for k in range(70)] + [("open", 30, None, "o"), ("later", 10**6, None, "l")]
    p = spark.createDataFrame(phases, "phase_address string, from_block long, to_block long, abi_version string")
    rows = spark.createDataFrame([(i, rnd.choice(["P1", "p2", "p6", "Open", "later", "none", None]), rnd.choice([rnd.randint(0, 1100), 29, 30, 99, 100, None])) for i in range(500)], "i int, address string, b long")
    for found in (in_phase_by_bins(rows, p, "address", "b", 64), in_phase_by_bins(rows.where("i < 0"), p, "address", "b")):
        want = in_phase(rows.where("i < 0") if found.count() == 0 else rows, p, "address", "b")
        assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_store(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ["k"])
    t.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    once = sorted(map(tuple, t.merge(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")).collect()))
    again = sorted(map(tuple, t.merge(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")).collect()))
    assert once == again == [(1, "a"), (2, "c"), (3, "d")]
    c = store.Checkpoint(str(tmp_path / "c.json"))
    c.advance(1, "logs", 10, "h")
    c.advance(1, "logs", 5, "x")
    c.mark_replay(1, "logs", 2, 3)
    again = store.Checkpoint(str(tmp_path / "c.json"))
    assert again.last_block(1, "logs") == 10 and again.pending_replays(1, "logs") == [(2, 3)]
    again.clear_replay(1, "logs", 2, 3)
    assert store.Checkpoint(str(tmp_path / "c.json")).pending_replays(1, "logs") == []
    m = store.Manifest("m", "run", "logs", ["f"], {"a": 2, "b": 3})
    assert store.Manifest.load(m.save(str(tmp_path))).total_rows == 5
    runs = store.Runs(str(tmp_path / "runs"))
    runs.record("r", "dag", 1, "running")
    runs.record("r", "dag", 1, "success")
    assert runs.get("r")["status"] == "success"
    with pytest.raises(FileNotFoundError):
        runs.get("none")
    rows = spark.createDataFrame([(1, 1701190703, "x")], "chain_id int, timestamp long, v string")
    for _ in range(2):
        path = store.write_dataset(rows, str(tmp_path / "lake"), "raw", "logs", "run", ingested_at=1)
    assert spark.read.parquet(path).count() == 1
    assert store.write_dataset(rows.limit(0), str(tmp_path), "raw", "none", "run") is None


def test_windows():
    calls = []

    def get(a, b):
        calls.append((a, b))
        if b - a + 1 > 64:
            raise RuntimeError("too wide")
        return [b - a + 1]

    assert sum(x[0] for x in rpc.fetch(get, 1, 300, 256)) == 300
    with pytest.raises(RuntimeError):
        list(rpc.fetch(lambda a, b: get(1, 100), 1, 100))
    assert list(rpc.windows(1, 10, 4)) == [(1, 4), (5, 8), (9, 10)]


def test_cost_guard(spark):
    with pytest.raises(scans.CostError):
        scans.guarded(spark.range(10**6), 10)


def test_stream(spark, tmp_path):
    from tallywheel.streaming.microbatch import finality_sink, start

    src = tmp_path / "in"
    schema = "chain_id int, block_number long, v string"
    spark.createDataFrame([(1, n, "x") for n in range(100)], schema).write.parquet(str(src))
    final, shadow = store.Table(spark, str(tmp_path / "final"), ["block_number"]), store.Table(spark, str(tmp_path / "shadow"), ["block_number"])
    check = store.Checkpoint(str(tmp_path / "cp.json"))
    sink = finality_sink(final, shadow, lambda b: b, check, 1, "logs", depth=10)
    start(spark.readStream.schema(schema).parquet(str(src)), sink, str(tmp_path / "offsets")).awaitTermination()
    assert final.read().count() == 90 and check.last_block(1, "logs") == 89
    spark.createDataFrame([(1, n, "y") for n in range(100, 120)], schema).write.mode("append").parquet(str(src))
    start(spark.readStream.schema(schema).parquet(str(src)), sink, str(tmp_path / "offsets")).awaitTermination()
    assert final.read().count() == 110 and check.last_block(1, "logs") == 109
    assert sorted(r["block_number"] for r in shadow.read().collect()) == list(range(110, 120))
    assert len([f for f in (tmp_path / "final").iterdir() if f.is_dir()]) == 2  # the version before stays for its readers


def test_schemas(spark):
    from tallywheel import schemas

    assert schemas.empty(spark, "logs").columns[:3] == ["chain_id", "block_number", "block_hash"]
    text = spark.range(1).schema.json()
    spark.sql("DROP TABLE IF EXISTS made_once")
    assert schemas.create_table(spark, "made_once", text) and not schemas.create_table(spark, "made_once", text)
    spark.sql("DROP TABLE made_once")
    schemas.register_views({"logs": schemas.empty(spark, "logs")})
    assert spark.table("raw_logs").count() == 0


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_metrics_decode_once(spark):
    logs = spark.createDataFrame([(True, None, ["0x1"]), (False, "unknown_topic", ["0x2"]), (False, "unknown_topic", ["0x2"]), (False, "unknown_topic", []), (False, "abi_mismatch", ["0x1"])], "success boolean, failure_reason string, topics array<string>")
    partition, reorgs = spark.createDataFrame([(0.25,)], "pass_rate double"), spark.createDataFrame([(1,), (2,)], "block_number int")
    got = quality.metrics(logs, partition, reorgs)
    assert {r["metric"]: r["value"] for r in got.collect()} == {"decode_failure_rate": 80.0, "reconciliation_pass_rate": 0.25, "reorg_events": 2.0, "unknown_signatures": 1.0}
    assert leaves(got) == 3
    none = quality.metrics(logs.where("false"), partition, reorgs)
    assert {r["metric"]: r["value"] for r in none.collect()}["decode_failure_rate"] == 0.0


def test_partition_checks_match_once(spark):
    partition = spark.createDataFrame([({"unmatched": 3}, 0.5)], "counts_by_status map<string,long>, pass_rate double")
    both = quality.partition_checks(partition)
    assert sorted(both.collect()) == sorted(quality.no_unmatched_actions(partition).unionAll(quality.pass_rate(partition)).collect())
    assert leaves(both) == 1


def test_a_few_amounts_need_no_tables(monkeypatch):
    amounts = [[5, 3, 2, 3, 1], [1, 1, 1, 1, 1, 1, 1], [9, -4, 0, 7, 10**30, 2], [4, 4]]
    tried = [(a, t) for a in amounts for t in (2, 6, 8, 14, 10**30 + 9)]
    monkeypatch.setattr(matching, "_FEW", 0, raising=False)
    by_tables = [matching.first_batch(a, t) for a, t in tried]
    monkeypatch.undo()
    monkeypatch.setattr(matching, "_meeting", None)
    assert [matching.first_batch(a, t) for a, t in tried] == by_tables
    assert matching.first_batch([5, 3, 2, 3, 1], 6) == [0, 4]
    assert matching.first_batch([5, 3, 2, 3, 1], 6, part=1, parts=2) is None
