"""Streams with state against what plain Python makes of the same rows, over several batches, restarts and late rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from tallywheel.sources import store
from tallywheel.streaming import stateful
from tallywheel.streaming.microbatch import finality_sink, start

HEADER = "chain_id int, block_number long, block_hash string, ingested_at long"
ENTRY = "account string, direction string, amount_link decimal(38,0), tx_hash string, block_time timestamp"


def feed(spark, folder, schema, batches):
    """A stream that takes one batch of rows after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part={k:03}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def conflicts_by_hand(batches, depth):
    known, head, out = defaultdict(dict), {}, []
    for rows in batches:
        by = defaultdict(lambda: defaultdict(list))
        for chain, block, h, at in rows:
            if None not in (chain, block, h):
                by[chain][block].append((at or 0, h))
        for chain, blocks in by.items():
            before = head.get(chain)
            for block, sights in sorted(blocks.items()):
                at, new = max(sights)
                old, seen = known[chain].get(block, (min(sights)[1], -1))
                if before is not None and block <= before - depth or block in known[chain] and seen > at:
                    continue
                if old != new:
                    out.append((chain, block, old, new))
                known[chain][block] = (new, at)
            head[chain] = max([*blocks, *([] if before is None else [before])])
            known[chain] = {b: v for b, v in known[chain].items() if b > head[chain] - depth}
    return sorted(out)


def test_changed_hashes(spark, tmp_path):
    rnd, batches, clock = random.Random(4), [], 0
    for k in range(6):
        rows = []
        for _ in range(60):
            clock += 1
            block = max(0, 10 * k + rnd.randint(-14, 12))
            rows.append((rnd.choice([1, 1, 7]), block, f"h{block}-{rnd.choice([0, 0, 0, 1, 2])}", rnd.choice([clock, clock, clock - 40, None])))
        batches.append([*rows, (1, None, "x", 1), (None, 3, "x", 1), (1, 3, None, 1)])
    want = conflicts_by_hand(batches, 8)
    stream = stateful.changed_hashes(feed(spark, tmp_path / "in", HEADER, batches[:4]), depth=8)
    stateful.drained(stream, str(tmp_path / "out"))
    stream = stateful.changed_hashes(spark.readStream.schema(HEADER).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), depth=8)
    for k, rows in enumerate(batches[4:], 4):  # the query is started again and goes on with its state
        spark.createDataFrame(rows, HEADER).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k:03}"))
    found, _ = stateful.drained(stream, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 20


def test_a_chain_is_no_task(spark, tmp_path):
    """Changes of one chain come from several tasks, and a block that its share never saw is final by the chain's head."""
    seen = [[(1, n, h, k) for n in range(0, 400) for k, h in enumerate((f"a{n}", f"b{n}"))], [(1, n, f"c{n}", 5) for n in (100, 391, 395, 401)] + [(1, 150, "d", 9), (1, 401, "x", 9)]]
    stream = stateful.changed_hashes(feed(spark, tmp_path / "in", HEADER, seen), depth=10).withColumn("task", F.spark_partition_id())
    found = stateful.drained(stream, str(tmp_path / "out"))[0].collect()
    assert len({r["task"] for r in found}) > 1
    assert sorted(tuple(r)[:4] for r in found) == conflicts_by_hand(seen, 10) and len(found) == 403


def test_marked_replays(spark, tmp_path):
    check = store.Checkpoint(str(tmp_path / "cp.json"))
    seen = [[(c, n, f"a{n}", n) for c in (1, 2) for n in range(20)], [(1, n, f"b{n}", 50) for n in (15, 17)] + [(2, 3, "b", 60), (2, 19, "b19", 60)]]
    stream = stateful.changed_hashes(feed(spark, tmp_path / "in", HEADER, seen), depth=10)
    stateful.mark_replays(stream, check, "logs", str(tmp_path / "side"), str(tmp_path / "state")).awaitTermination()
    assert check.pending_replays(1, "logs") == [(15, 17)] and check.pending_replays(2, "logs") == [(19, 19)]  # block 3 was final
    assert spark.read.parquet(str(tmp_path / "side")).count() == 3


def test_sink_with_hashes(spark, tmp_path):
    """Waiting rows of a replaced block go, its range is marked, and the checkpoint has the hash of the last final block."""
    schema = "chain_id int, block_number long, log_index int, block_hash string"
    final, shadow = (store.Table(spark, str(tmp_path / n), ["block_number", "log_index"]) for n in ("final", "shadow"))
    check = store.Checkpoint(str(tmp_path / "cp.json"))
    sink = finality_sink(final, shadow, lambda b: b, check, 1, "logs", depth=10)
    old = [(1, n, i, f"a{n}") for n in range(30) for i in range(2)]
    new = [(1, n, 0, f"b{n}") for n in range(25, 31)]
    stream = feed(spark, tmp_path / "in", schema, [old, new])
    start(stream, sink, str(tmp_path / "offsets")).awaitTermination()
    assert check.last_block(1, "logs") == 20 and check.last_hash(1, "logs") == "a20" and check.pending_replays(1, "logs") == [(25, 29)]
    assert final.read().count() == 42
    assert sorted((r["block_number"], r["log_index"], r["block_hash"]) for r in shadow.read().collect()) == [(n, i, f"a{n}") for n in range(21, 25) for i in range(2)] + [(n, 0, f"b{n}") for n in range(25, 31)]


def test_deduplication(spark, tmp_path):
    """Shuffled repeats within the delay leave each key once; a row beyond it is dropped and counted."""
    rnd, t0 = random.Random(6), datetime(2024, 1, 1, tzinfo=timezone.utc)
    keys = [(f"k{i}", t0 + timedelta(minutes=i)) for i in range(200)]
    rows = [k for k in keys for _ in range(3)]
    rnd.shuffle(rows)
    late = [("late", t0 - timedelta(days=3))]
    stream = feed(spark, tmp_path / "in", "k string, at timestamp", [rows[:300], rows[300:], late])
    found, query = stateful.drained(stateful.deduplicated(stream, ["k"], "at", "12 hours"), str(tmp_path / "out"))
    assert sorted(r["k"] for r in found.collect()) == sorted(k for k, _ in keys)
    assert stateful.late_rows(query) == 1


def test_closed_weeks(spark, tmp_path):
    """Weeks that ended a day before the newest posting, over batches; one posting of a closed week is too late."""
    rnd, t0 = random.Random(8), datetime(2023, 12, 28, 5, tzinfo=timezone.utc)
    rows = []
    for i in range(300):
        at = t0 + timedelta(hours=3 * (i // 3))
        account = rnd.choice(["pa_reserves:link", "pa_reserves:x", "pa_fee_aggregator:f", "pool:rewards"])
        rows.append((account, rnd.choice(["credit", "credit", "debit"]), Decimal(rnd.randint(1, 99)), f"t{i // 3}", at))
    late = [("pa_reserves:link", "credit", Decimal(10**6), "late", t0)]
    stream = feed(spark, tmp_path / "in", ENTRY, [rows[:150], rows[150:], late])
    found, query = stateful.drained(stateful.closed_weeks(stream, "1 day"), str(tmp_path / "out"))
    newest = max(r[4] for r in rows if r[0].startswith("pa_"))
    fee = {r[3] for r in rows if r[0].startswith("pa_fee_aggregator:")}
    want = defaultdict(lambda: [0, set()])
    for account, direction, amount, tx, at in rows:
        monday = (at - timedelta(days=at.weekday())).replace(hour=0)
        if account.startswith("pa_reserves:") and monday + timedelta(days=7) <= newest - timedelta(days=1):
            w = want[(str(monday.date()), "pa_fee_inflow" if tx in fee else "other_inflow")]
            w[0] += int(amount) if direction == "credit" else 0
            w[1].add(tx)
    got = {(str(r["week_start"]), r["inflow_source"]): (int(r["link_inflow"]), r["tx_count"]) for r in found.collect()}
    assert got == {k: (a, len(t)) for k, (a, t) in want.items()} and len(got) >= 2
    assert stateful.late_rows(query) >= 1
