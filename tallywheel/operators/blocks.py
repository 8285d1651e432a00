"""Canonical blocks, finality, reorganisations and incremental reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywheel.functions.fixed import FINALITY_DEPTH, OVERLAP_BLOCKS


def _by(per_chain: bool) -> list[str]:
    return ["chain_id"] if per_chain else []


def with_watermark(blocks: DataFrame, depth: int = FINALITY_DEPTH, per_chain: bool = False) -> DataFrame:
    """``blocks`` with the last final block: the highest number (of all chains, or each) less the depth."""
    top = blocks.groupBy(*_by(per_chain)).agg((F.max("block_number") - depth).alias("watermark"))
    return blocks.join(top, "chain_id") if per_chain else blocks.crossJoin(top)  # one row


def canonical_blocks(blocks: DataFrame, depth: int = FINALITY_DEPTH, per_chain: bool = False) -> DataFrame:
    """Of each final block number the row that was ingested last (of equals the highest hash)."""
    latest = Window.partitionBy("chain_id", "block_number").orderBy(F.desc("ingested_at"), F.desc("block_hash"))
    final = with_watermark(blocks, depth, per_chain).where("block_number <= watermark").drop("watermark")
    return final.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def shadow_blocks(blocks: DataFrame, depth: int = FINALITY_DEPTH, per_chain: bool = False) -> DataFrame:
    return with_watermark(blocks, depth, per_chain).where("block_number > watermark").drop("watermark")


def on_canonical(rows: DataFrame, canonical: DataFrame, by_hash: bool = False) -> DataFrame:
    """Rows of canonical blocks; by hash as well where the rows carry it."""
    keys = ["chain_id", "block_number", *(["block_hash"] if by_hash else [])]
    return rows.join(canonical.select(*keys), keys, "left_semi")


def block_gaps(canonical: DataFrame, span: int = 1_000_000) -> DataFrame:
    """Places where a chain's block numbers are not consecutive.

    Windows run over stretches of ``span`` numbers, so that a long chain isn't one task; the least block
    of each stretch follows the greatest of the last one before it.
    """
    stretch = F.floor(F.col("block_number") / span)
    rows = canonical.select("chain_id", "block_number", stretch.alias("_at"))
    ends = rows.groupBy("chain_id", "_at").agg(F.min("block_number").alias("_least"), F.max("block_number").alias("block_number"))
    between = ends.select("chain_id", "block_number", F.lead("_least").over(Window.partitionBy("chain_id").orderBy("_at")).alias("next_block"))
    within = rows.select("chain_id", "block_number", F.lead("block_number").over(Window.partitionBy("chain_id", "_at").orderBy("block_number")).alias("next_block"))
    return within.unionAll(between).where("next_block - block_number > 1").withColumn("missing", F.col("next_block") - F.col("block_number") - 1)


def finality_watermark(head: int, finalized: int | None, depth: int = FINALITY_DEPTH) -> int:
    """The node's finalized block where it tells one, else the head less the depth."""
    return finalized if finalized and finalized > 0 else max(0, head - depth)


def is_final(block: int, watermark: int) -> bool:
    return block <= watermark


def since_last_run(rows: DataFrame, last_block: int | None, overlap: int = OVERLAP_BLOCKS) -> DataFrame:
    """Rows of blocks after the target's last one less an overlap; the bound is a literal, so that files are pruned."""
    return rows.where(F.col("block_number") > max(0, last_block or 0) - overlap) if last_block is not None else rows.where(F.col("block_number") > -overlap)


def reorg_conflicts(known: DataFrame, observed: DataFrame) -> DataFrame:
    """Blocks whose hash is no longer the one that is known."""
    a = known.select("chain_id", "block_number", F.col("block_hash").alias("old_hash"))
    b = observed.select("chain_id", "block_number", F.col("block_hash").alias("new_hash"))
    return a.join(b, ["chain_id", "block_number"]).where("old_hash <> new_hash")


def reorg_depth(known: DataFrame, observed: DataFrame) -> DataFrame:
    """For each chain, how many blocks in a row from its tip have another hash."""
    both = known.select("chain_id", "block_number", F.col("block_hash").alias("_old")).join(observed.select("chain_id", "block_number", F.col("block_hash").alias("_new")), ["chain_id", "block_number"])
    return both.groupBy("chain_id").agg(F.max("block_number").alias("tip"), F.max(F.when(F.col("_old") == F.col("_new"), F.col("block_number"))).alias("same"), F.min("block_number").alias("first")).select("chain_id", "tip", (F.col("tip") - F.coalesce("same", F.col("first") - 1)).alias("depth"))


def promote(shadow: DataFrame, canonical: DataFrame, watermark: int) -> tuple[DataFrame, DataFrame]:
    """Shadow blocks that are final now, and their conflicts with canonical ones."""
    ready = shadow.where(F.col("block_number") <= watermark)
    return ready, reorg_conflicts(canonical, ready)
