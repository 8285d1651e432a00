"""Models that are kept up to date: a run computes anew what the blocks since the last one touch.

The state of each model is a table by ranges of blocks (or of days); a run rewrites only the ranges that
it touches. From the first touched block on, rows of blocks, actions, movements, edges, postings and
failures are replaced, since one block decides each of them, so that rows which a reorganisation took away
go, too. From what was and what is there now follow the keys of the other models that are touched:

* a pool's balance changes need its last snapshot before the first touched block;
* a wallet's or a pool's day is computed anew from all blocks of that day, for the touched keys only;
* the highest balance of a pool, which stands on all of its days, is a table of its own, joined on reading;
* counts of edges are kept by stretches of blocks and summed on reading.

The overlap before the last canonical block is read again, so that late rows are met; a lower ``first``
replays from there, as after a reorganisation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.functions.fixed import FINALITY_DEPTH, OVERLAP_BLOCKS
from tallywheel.functions.portable import date_from_seconds
from tallywheel.plans import marts
from tallywheel.sources.store import Table

_DAY = 1  # days in a range of a table by days
_TABLES = ("stg_canonical_blocks", "int_token_movements", "int_decode_failures", "ledger_entries", "int_action_movement_recon", "edge_counts", "int_pool_balance_deltas", "int_economic_actions", "staking_link_flows", "wallet_economics", "pool_days", "pool_tops")


class Incremental:
    """The keyed models over growing inputs (the raw layer and decoded and reconciled data, by the names that ``marts.build`` knows)."""

    def __init__(self, spark: SparkSession, root: str, span: int = 10_000, overlap: int = OVERLAP_BLOCKS, depth: int = FINALITY_DEPTH):
        self.spark, self.root, self.span, self.overlap, self.depth = spark, root.rstrip("/"), span, overlap, depth
        self.rewritten: dict[str, int] = {}

    def _table(self, name: str, by: str = "block_number", span: int | None = None) -> Table:
        return Table(self.spark, f"{self.root}/{name}", [], by, span or self.span)

    def _put(self, name: str, table: Table, rows: DataFrame, stays: Callable[[DataFrame], DataFrame], touched: Callable[[int], bool]) -> None:
        before = table.folders()
        table.exchange(rows, stays, touched)
        written = [f"{table.path}/{f}" for r, f in table.folders().items() if before.get(r) != f]
        self.rewritten[name] = self.spark.read.parquet(*written).count() if written else 0  # from the files' footers

    def _since(self, name: str, rows: DataFrame, first: int) -> None:
        """All rows from block ``first`` on make place for these."""
        self._put(name, self._table(name), rows, lambda old: old.where(F.col("block_number") < first), lambda r: r >= first // self.span)

    def first_block(self) -> int | None:
        """The first block that the next run touches; None where there is no state yet."""
        known = self._table("stg_canonical_blocks").read()
        last = known.groupBy("chain_id").agg(F.max("block_number").alias("b")).agg(F.min("b")).first()[0] if known is not None else None
        return None if last is None else max(0, last + 1 - self.overlap)

    def run(self, inputs: dict[str, DataFrame], first: int | None = None) -> dict[str, int]:
        """Bring all models up to date whose inputs are there; the rows of the ranges that were written, by model.

        Whoever reads the state before this run can go on until the next one.
        """
        self.rewritten = {}
        for name in _TABLES:
            self._table(name).vacuum()
        start = self.first_block() if first is None else first
        first = 0 if start is None else start
        new = lambda rows: rows.where(F.col("block_number") >= first)
        has = lambda *names: all(n in inputs for n in names)
        was = {name: self._table(name).read() for name in ("stg_canonical_blocks", "staking_link_flows", "int_economic_actions")}
        old = {name: new(rows) for name, rows in was.items() if rows is not None}
        canonical = new(marts.stg_canonical_blocks(inputs["blocks"], self.depth))
        self._since("stg_canonical_blocks", canonical, first)
        canonical = new(self.read("stg_canonical_blocks"))
        if has("token_movements"):
            self._since("int_token_movements", marts.int_token_movements(new(inputs["token_movements"])), first)
        if has("decode_results"):
            self._since("int_decode_failures", marts.int_decode_failures(new(inputs["decode_results"])), first)
        if has("ledger"):
            self._since("ledger_entries", marts.ledger_entries(new(inputs["ledger"]), canonical), first)
        if has("edges"):
            self._since("int_action_movement_recon", marts.int_action_movement_recon(marts.stg_action_movement_edges(new(inputs["edges"]))), first)
            self._counts(inputs["edges"], first)
        if has("balance_snapshots", "token_movements"):
            self._deltas(marts.stg_balance_snapshots(inputs["balance_snapshots"]), first)
        if has("economic_actions"):
            self._since("int_economic_actions", marts.int_economic_actions(new(inputs["economic_actions"]), canonical), first)
        if has("economic_actions", "edges"):
            self._since("staking_link_flows", marts.staking_link_flows(new(self.read("int_economic_actions")), new(self.read("int_action_movement_recon"))), first)
            self._days("wallet_economics", "staking_link_flows", ["wallet"], marts.wallet_days, old, first)
        if has("economic_actions", "balance_snapshots"):
            pools = lambda rows: rows.withColumn("pool_address", F.col("contract_address"))
            self._days("pool_days", "int_economic_actions", ["pool_address"], marts.pool_days, old, first, pools)
            self._tops(marts.stg_balance_snapshots(inputs["balance_snapshots"]), first)
        return self.rewritten

    def _counts(self, edges: DataFrame, first: int) -> None:
        stretch = F.floor(F.col("block_number") / self.span)
        least = first // self.span * self.span
        rows = marts.edge_counts(edges.where(F.col("block_number") >= least).withColumn("stretch", stretch), "stretch").withColumn("block_number", F.col("block_range_start"))
        self._since("edge_counts", rows, least)

    def _deltas(self, snapshots: DataFrame, first: int) -> None:
        """Balance changes from block ``first`` on; of earlier blocks only the last snapshot of each holder that has new ones is read."""
        keys = ["holder_address", "token_address"]
        now = snapshots.where(F.col("block_number") >= first)
        before = snapshots.where(F.col("block_number") < first).join(now.select(*keys).distinct(), keys, "left_semi")
        last = before.groupBy(*keys).agg(F.max(F.struct("block_number", "balance")).alias("at")).select(*keys, "at.*")
        movements = self.read("int_token_movements").where(F.col("block_number") >= first)
        self._since("int_pool_balance_deltas", marts.int_pool_balance_deltas(now.select(*last.columns).unionByName(last), movements), first)

    def _days(self, name: str, source: str, keys: list[str], compute: Callable[[DataFrame], DataFrame], old: dict[str, DataFrame], first: int, named: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """A model by key and day: of the keys and days that have or had rows from block ``first`` on, from all rows of these days."""
        keys = [*keys, "snapshot_date"]
        canonical = self.read("stg_canonical_blocks")
        touched = named(marts.dated(self.read(source).where(F.col("block_number") >= first), canonical.where(F.col("block_number") >= first))).select(*keys)
        if source in old and "stg_canonical_blocks" in old:
            touched = touched.unionAll(named(marts.dated(old[source], old["stg_canonical_blocks"])).select(*keys))
        touched = touched.distinct().persist()
        try:
            days = {r[0] for r in touched.select(F.unix_date("snapshot_date")).distinct().collect()}  # one row for each day since the last run
            day = F.unix_date(date_from_seconds("timestamp"))
            least = canonical.where(day >= min(days)).agg(F.min("block_number")).first()[0] if days else None
            late = lambda rows: rows.where(F.col("block_number") >= (first if least is None else min(least, first)))
            rows = named(marts.dated(late(self.read(source)), late(canonical))).join(touched, keys, "left_semi")
            table = self._table(name, "_day", _DAY)
            found = compute(rows).withColumn("_day", F.unix_date("snapshot_date"))
            self._put(name, table, found, lambda was: was.join(touched, keys, "left_anti"), lambda r: r in days)
        finally:
            touched.unpersist()

    def _tops(self, snapshots: DataFrame, first: int) -> None:
        """The highest balance of each pool with snapshots from block ``first`` on, from all of its snapshots."""
        pools = snapshots.where(F.col("block_number") >= first).select("holder_address").distinct()
        rows = marts.pool_tops(snapshots.join(pools, "holder_address", "left_semi")).withColumn("_share", F.pmod(F.xxhash64("pool_address"), F.lit(16)))
        gone = rows.select("pool_address")
        self._put("pool_tops", self._table("pool_tops", "_share", 1), rows, lambda was: was.join(gone, "pool_address", "left_anti"), lambda r: True)

    def read(self, name: str) -> DataFrame:
        """A model as of the last run."""
        if name == "pool_economics":
            return marts.with_tops(self.read("pool_days"), self.read("pool_tops").select("pool_address", "_top"))
        if name == "reconciliation_status":
            return marts.status_of_counts(marts.summed_counts(self.read("edge_counts")), self.read("stg_canonical_blocks"))
        by = {"wallet_economics": "_day", "pool_days": "_day", "pool_tops": "_share"}.get(name, "block_number")
        rows = self._table(name, by, None if by == "block_number" else 1).read()
        if rows is None:
            raise ValueError(f"no run has written {name}")
        return rows.drop("_day")
