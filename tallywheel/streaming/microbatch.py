"""Micro-batches: decoded rows that are final go to tables by key, younger ones to a shadow table.

The watermark is a block number, not an event time: a batch's rows are final if they lie the finality
depth below the highest block seen. Merging by key makes a batch that is run again leave the same table,
and the overlap before the last final block is read again so that late rows are met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywheel.functions.fixed import FINALITY_DEPTH
from tallywheel.operators.blocks import reorg_conflicts
from tallywheel.sources.store import Checkpoint, Table


def finality_sink(final: Table, shadow: Table, transform: Callable[[DataFrame], DataFrame], checkpoint: Checkpoint, chain_id: int, source: str, depth: int = FINALITY_DEPTH) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. The checkpoint is advanced last, to the mark and the hash of its block.

    Where rows carry a ``block_hash``, waiting rows of a block that comes again with another one go, and the
    range of such blocks is marked for replay. The version of a table that a reader holds when a batch
    begins stays until the next batch ends.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = transform(batch).persist()
        try:
            top = rows.agg(F.max("block_number")).first()[0]
            if top is None:
                return
            mark = max(top - depth, checkpoint.last_block(chain_id, source))
            hashed = "block_hash" in rows.columns
            waiting = shadow.read()
            if hashed and waiting is not None:
                named = lambda x: x.select(F.lit(chain_id).alias("chain_id"), "block_number", "block_hash").distinct()
                changed = reorg_conflicts(named(waiting), named(rows)).select("block_number").distinct()
                if replay_reorgs(named(waiting), named(rows), checkpoint, chain_id, source):
                    waiting = waiting.join(changed, "block_number", "left_anti")
            everything = rows if waiting is None else rows.unionByName(waiting.join(rows.select(*shadow.keys), shadow.keys, "left_anti"), allowMissingColumns=True)
            ready = everything.where(F.col("block_number") <= mark)
            held = tuple(final.folders().values()), tuple(shadow.folders().values())
            block_hash = ready.where(F.col("block_number") == mark).agg(F.max("block_hash")).first()[0] if hashed else None
            if ready.take(1):
                final.merge(ready)
            shadow.replace(everything.where(F.col("block_number") > mark))
            final.vacuum(keep=held[0])
            shadow.vacuum(keep=held[1])
            checkpoint.advance(chain_id, source, mark, block_hash or "")
        finally:
            rows.unpersist()

    return write


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 minutes")).start()


def replay_reorgs(known: DataFrame, observed: DataFrame, checkpoint: Checkpoint, chain_id: int, source: str) -> int:
    """Mark the range of blocks whose hash has changed for replay; returns how many there are."""
    r = reorg_conflicts(known, observed).agg(F.count("*").alias("n"), F.min("block_number").alias("a"), F.max("block_number").alias("b")).first()
    if r["n"]:
        checkpoint.mark_replay(chain_id, source, r["a"], r["b"])
    return r["n"]
