"""Streams that keep state: changed block hashes, deduplication within a watermark, and weeks that close.

All state lies in the state store of the query's checkpoint, so a query that is started again goes on
where it was, also on other executors. State is bounded: hashes by the finality depth, keys and weeks by
the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallywheel.functions.fixed import FINALITY_DEPTH
from tallywheel.sources.store import Checkpoint

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONFLICT = "chain_id int, block_number long, old_hash string, new_hash string"
SHARES = 256  # of a chain's blocks


class HashWatch(StatefulProcessor):
    """Of a share of one chain's blocks: the hash of each of the last ones as of its latest sight, and a row for each that changes.

    Of the sights in one micro-batch the first and the last (by ``ingested_at``, then hash) of a block count, so
    the result doesn't depend on the order of rows within it. What lies so far below the highest block that it
    was final before the batch isn't watched any more. The highest block is the chain's: each share has a row
    without a hash that names it.
    """

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", "block_number long", "block_hash string, ingested_at long")
        self.head = handle.getValueState("head", "block_number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.head.get()[0] if self.head.exists() else None
        top, first, last = before, {}, {}
        for part in rows:
            highest = int(part["block_number"].max())
            top = highest if top is None else max(top, highest)
            for block, of, at in part[part["block_hash"].notna()][["block_number", "block_hash", "ingested_at"]].itertuples(index=False, name=None):
                if before is None or block > before - self.depth:
                    sight = (at, of)
                    first[block] = min(first.get(block, sight), sight)
                    last[block] = max(last.get(block, sight), sight)
        known = {k[0]: tuple(v) for k, v in self.hashes.iterator()}  # at most ``depth`` blocks
        out = []
        for block in sorted(last):
            at, new = last[block]
            if block in known and known[block][1] > at:
                continue
            old = known[block][0] if block in known else first[block][1]
            if old != new:
                out.append((int(key[0]), block, old, new))
            if block > top - self.depth:
                self.hashes.updateValue((block,), (new, at))
        if top != before:
            self.head.update((top,))
            for block in known:
                if block <= top - self.depth:
                    self.hashes.removeKey((block,))
        yield pd.DataFrame(out, columns=["chain_id", "block_number", "old_hash", "new_hash"])

    def close(self) -> None:
        pass


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last sights of the blocks of each batch of rows, and for each share of a chain its highest block here, without a hash."""
    heads: dict[int, int] = {}
    for b in batches:
        of = ["chain_id", "block_number"]
        b = b.sort_values([*of, "ingested_at", "block_hash"])
        for chain, top in b.groupby("chain_id")["block_number"].max().items():
            heads[chain] = max(int(top), heads.get(chain, int(top)))
        b = b[~b.duplicated(of) | ~b.duplicated(of, keep="last")]
        yield b.assign(share=b["block_number"] % SHARES)
    for chain, top in heads.items():
        yield pd.DataFrame({"chain_id": chain, "block_number": top, "block_hash": None, "ingested_at": 0, "share": range(SHARES)})


def changed_hashes(headers: DataFrame, depth: int = FINALITY_DEPTH) -> DataFrame:
    """chain_id, block_number, old_hash and new_hash of the blocks of a stream of headers (with ``ingested_at``) whose hash changes before they are final.

    Headers without a chain, a number or a hash are passed over; one without a time of ingestion is the oldest.
    A chain's blocks are dealt out to shares by number, so that a chain isn't one task.
    """
    headers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # keeps maps
    rows = headers.select(F.col("chain_id").cast("int").alias("chain_id"), F.col("block_number").cast("long").alias("block_number"), "block_hash", F.coalesce(F.col("ingested_at").cast("long"), F.lit(0)).alias("ingested_at")).dropna()
    dealt = rows.mapInPandas(_ends, "chain_id int, block_number long, block_hash string, ingested_at long, share int")
    return dealt.groupBy("chain_id", "share").transformWithStateInPandas(HashWatch(depth), CONFLICT, "append", "none")


def mark_replays(conflicts: DataFrame, checkpoint: Checkpoint, source: str, folder: str, checkpoint_location: str) -> StreamingQuery:
    """Start a query that appends changed hashes to a table in ``folder`` and marks the range of each chain and batch for replay.

    A batch that is run again writes its own part of the table anew and marks the same range.
    """

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder.rstrip('/')}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        ranges = batch.sparkSession.read.schema(CONFLICT).parquet(path).groupBy("chain_id").agg(F.min("block_number").alias("a"), F.max("block_number").alias("b"))
        for r in ranges.collect():  # one row for each chain
            checkpoint.mark_replay(r["chain_id"], source, r["a"], r["b"])

    return conflicts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()


def deduplicated(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream without the repeats of a key that come within ``delay`` of each other; rows that come later than that are dropped and counted."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query have dropped as too late, as far as its progress is kept."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def closed_weeks(entries: DataFrame, delay: str, time: str = "block_time") -> DataFrame:
    """week_start, inflow_source, link_inflow and tx_count of each Monday week of a stream of postings, once it can't change any more.

    A week closes when ``delay`` has passed since its end. Postings are summed by transaction first, which
    tells whether it also touched the fee aggregator and makes the number of transactions a plain count.
    """
    fee, reserve = F.col("account").startswith("pa_fee_aggregator:"), F.col("account").startswith("pa_reserves:")
    week = F.window(time, "7 days", startTime="4 days")  # the epoch was a Thursday
    amount = F.when(reserve & (F.col("direction") == "credit"), F.col("amount_link"))
    timed = entries.where(fee | reserve).withWatermark(time, delay)
    by_tx = timed.groupBy(week.alias("week"), "tx_hash").agg(F.max(fee).alias("fee"), F.max(reserve).alias("reserve"), F.coalesce(F.sum(amount), F.lit(0)).alias("inflow"))
    source = F.when(F.col("fee"), "pa_fee_inflow").otherwise("other_inflow")
    by_week = by_tx.where("reserve").groupBy("week", source.alias("inflow_source")).agg(F.sum("inflow").alias("link_inflow"), F.count("*").alias("tx_count"))
    return by_week.select(F.to_date("week.start").alias("week_start"), "inflow_source", "link_inflow", "tx_count")


def drained(stream: DataFrame, folder: str) -> tuple[DataFrame, StreamingQuery]:
    """All rows that a stream gives for what is there now, written to ``folder`` and read again, and the query that has ended."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), query
