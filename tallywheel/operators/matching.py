"""Matching of actions to the token movements of their transaction, many to many.

An action meets each movement of its transaction at most once. Counts of equal amounts settle most
actions with windows; only the rest look for a batch of movements that sums to their amount.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallywheel.functions import ids
from tallywheel.functions.fixed import NO_MOVEMENT_KINDS, REASONS, STATUSES

EDGE = ["edge_id", "action_id", "movement_id", "allocated_amount", "status", "method", "reason", "chain_id", "block_number", "tx_hash"]
LARGEST_BATCH = 6
_PRIME = 2**61 - 1  # sums are compared by their remainders; those that agree are added up in full
_TABLE = 80  # amounts whose threes are one table
_FEW = 8  # amounts that are tried one combination after the other; 238 at most


def _places(residues: np.ndarray, size: int, want: int, modulus: int) -> np.ndarray:
    """All combinations of one, two or three places, in order, whose residues sum to ``want``."""
    n = len(residues)
    if size == 1:
        return np.flatnonzero(residues == want)[:, None]
    i, j = np.triu_indices(n, 1)
    if size == 2:
        keep = (residues[i] + residues[j]) % modulus == want
        return np.stack((i[keep], j[keep]), axis=1)
    by = np.argsort(residues, kind="stable")  # a third place is looked up by the residue it must have
    first = np.searchsorted(residues[by], np.arange(modulus + 1))
    needed = (want - residues[i] - residues[j]) % modulus
    n_third = first[needed + 1] - first[needed]
    pair = np.repeat(np.arange(len(i)), n_third)
    third = by[first[needed][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n_third) - n_third, n_third)]
    keep = third > j[pair]
    return np.stack((i[pair][keep], j[pair][keep], third[keep]), axis=1)


def _meeting(front: np.ndarray, back: np.ndarray, amounts: list[int], small: np.ndarray, target: int) -> list[int] | None:
    """The first combination in order of one of ``front`` and one of ``back`` behind it that sums to the target."""
    if not len(front) or not len(back):
        return None
    sums, ends = small[front].sum(axis=1) % _PRIME, small[back].sum(axis=1) % _PRIME
    order = np.lexsort((back[:, 0], ends))
    ends, back = ends[order], back[order]
    latest = np.append(ends[1:] != ends[:-1], True)  # of equal sums the one that starts last
    known, starts = ends[latest], back[latest][:, 0]
    left = (target % _PRIME - sums) % _PRIME
    at = np.minimum(np.searchsorted(known, left), len(known) - 1)
    for f in np.flatnonzero((known[at] == left) & (starts[at] > front[:, -1])).tolist():
        lo, hi = np.searchsorted(ends, left[f]), np.searchsorted(ends, left[f], "right")
        exact = target - sum(amounts[p] for p in front[f])
        behind = sorted(x for x in back[lo:hi].tolist() if x[0] > front[f][-1] and sum(amounts[p] for p in x) == exact)
        if behind:
            return [*front[f].tolist(), *behind[0]]
    return None


def first_batch(amounts: list[int], target: int, largest: int = LARGEST_BATCH, part: int = 0, parts: int | None = None) -> list[int] | None:
    """Places of the first combination, by size and then in order, of two or more amounts that sum to the target.

    Only amounts above zero and below the target count, and of equal ones the first ``largest``, since an
    earlier place of the same amount is always the better one. A combination is met in the middle: its
    first half is the first to leave a sum that a half behind it makes up. Sizes whose least or greatest sum
    can't be the target are passed over.

    For the largest sizes the halves are three amounts. They are told apart by the remainder of their
    sum by a prime near the number of amounts, one remainder after the other, so that the table of halves grows
    with the square of their number. With ``parts`` only the remainders of one part are looked at, so
    that one action can be dealt out: the first of the parts' results, by size and order, is the result.
    Of a few amounts, as most transactions have, all combinations are tried in turn, without tables.
    """
    seen: Counter = Counter()
    use = []
    for p, x in enumerate(amounts):
        if 0 < x < target and seen[x] < largest:
            seen[x] += 1
            use.append(p)
    values = [amounts[p] for p in use]
    rising, n = sorted(values), len(use)
    if n <= _FEW:
        if part:
            return None
        sizes = range(2, min(largest, n) + 1)
        return next((list(c) for k in sizes if sum(rising[:k]) <= target <= sum(rising[n - k :]) for c in itertools.combinations(use, k) if sum(amounts[p] for p in c) == target), None)
    small = np.array([x % _PRIME for x in values], np.int64)
    for size in range(2, min(largest, n) + 1):
        if not sum(rising[:size]) <= target <= sum(rising[n - size :]):
            continue
        back = size // 2
        wide = n > _TABLE and size - back > 2
        if not wide and part:
            continue
        modulus = _prime(n) if wide else 1
        residues = np.array([x % modulus for x in values], np.int64)
        found = []
        for r in range(part, modulus, parts or 1):
            one = _meeting(_places(residues, size - back, r, modulus), _places(residues, back, (target - r) % modulus, modulus), values, small, target)
            if one:
                found.append(one)
        if found:
            return [use[p] for p in min(found)]
    return None


def _prime(least: int) -> int:
    """The least prime from a number on."""
    return next(p for p in itertools.count(max(2, least)) if all(p % d for d in range(2, math.isqrt(p) + 1)))


@F.pandas_udf(ArrayType(IntegerType()))
def batch_places(amounts: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([first_batch([int(x) for x in a], int(t)) if len(a) > 1 else None for a, t in zip(amounts, target, strict=True)])


@F.pandas_udf(ArrayType(IntegerType()))
def batch_part(amounts: pd.Series, target: pd.Series, part: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([first_batch([int(x) for x in a], int(t), part=int(k), parts=int(n)) for a, t, k, n in zip(amounts, target, part, parts, strict=True)])


def _says(name: str, *values):
    """A reason's text with values in its places."""
    parts = REASONS[name].split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, tail in zip(values, parts[1:], strict=True) for x in (v.cast("string"), F.lit(tail))])


def _edge(status: str, movement=None, reason: str = "", index=0):
    """Struct of an edge; a movement is a struct with its id, amount and source."""
    found = movement is not None
    method = F.when(movement["source_priority"] == "log", "event_log").otherwise("trace") if found else F.lit(None).cast("string")
    return F.struct(
        (movement["movement_id"] if found else F.lit(None).cast("string")).alias("movement_id"),
        (movement["amount"].cast("decimal(38,0)") if found else F.lit(0).cast("decimal(38,0)")).alias("allocated_amount"),
        F.lit(status).alias("status"),
        method.alias("method"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        (F.lit(index) if isinstance(index, int) else index).alias("index"),
    )


def _dealt(large: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``large`` with ``_at``, found by so many tasks for each action."""
    rows = large.select(*keys, "_amounts", "_target", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")).repartition(*keys, "_part")
    tried = rows.select(*keys, batch_part("_amounts", "_target", "_part", F.lit(parts)).alias("_found")).where("_found IS NOT NULL")
    best = tried.groupBy(*keys).agg(F.min(F.struct(F.size("_found"), "_found")).getField("_found").alias("_at"))
    return large.drop("_at").join(best, keys, "left")


def match_actions(actions: DataFrame, movements: DataFrame, deal_above: int | None = None, parts: int = 64, lowered: bool = False) -> DataFrame:
    """At least one edge for each action.

    not_expected for kinds that move nothing; unmatched without a movement; exact for one movement of
    the same amount; ambiguous, on the first, for more; partial for each of a batch of two to six that
    sums to the amount; else unmatched. Movements are taken in the order of source, sender and id, and
    only amounts above zero count. Addresses and tokens are not compared.

    Actions of kinds that move nothing are answered by themselves. The others need one join by
    transaction, whose partitioning the grouping by action keeps; only amounts of actions without an
    equal movement are sent to Python. With ``deal_above``, an action that has so many movements to try is dealt
    out to ``parts`` rows that are looked at apart, so that a transaction with thousands isn't one task's work.
    With ``lowered`` the tx_hash of both tables is lower case as stored; if both are bucketed by it, nothing is shuffled.
    """
    tx = F.col("tx_hash") if lowered else F.lower("tx_hash")
    still = F.coalesce(F.col("kind").isin(NO_MOVEMENT_KINDS), F.lit(False))
    own = ["action_id", "kind", "amount_link", "chain_id", "block_number", "tx_hash"]
    flat = ["action_id", "chain_id", "block_number", "tx_hash"]
    idle = actions.where(still).select(*flat, F.inline(F.array(_edge("not_expected", reason=_says("idle", F.col("kind"))))))
    asked = actions.where(~still).select(*own, tx.alias("_tx"))
    given = movements.where("amount > 0").select(tx.alias("_tx"), F.struct("source_priority", "from_addr", "movement_id", "amount").alias("_m"))
    met = asked.join(given, "_tx", "left").groupBy("_tx", *own).agg(F.array_sort(F.collect_list("_m")).alias("_c"))
    met = met.withColumn("_same", F.filter("_c", lambda m: m["amount"] == F.col("amount_link")))
    rest = (F.size("_c") > 1) & (F.size("_same") == 0)
    amounts = F.when(rest, F.transform("_c", lambda m: m["amount"].cast("string"))).otherwise(F.array().cast("array<string>"))
    target = F.coalesce(F.col("amount_link"), F.lit(0)).cast("string")
    if deal_above is None:
        met = met.withColumn("_at", batch_places(amounts, target))
    else:
        met = met.withColumns({"_amounts": amounts, "_target": target})
        few, many = met.where(F.size("_amounts") <= deal_above), met.where(F.size("_amounts") > deal_above)
        met = few.withColumn("_at", batch_places("_amounts", "_target")).unionByName(_dealt(many, ["action_id"], parts))
    first, n = F.get("_same", 0), F.size("_same")
    edges = (
        F.when(F.size("_c") == 0, F.array(_edge("unmatched", reason=REASONS["none"])))
        .when(n == 1, F.array(_edge("exact", first, REASONS["exact"])))
        .when(n > 1, F.array(_edge("ambiguous", first, _says("ambiguous", n))))
        .when(F.col("_at").isNotNull(), F.transform("_at", lambda p, i: _edge("partial", F.get("_c", p), _says("partial", i + 1, F.size("_at")), i)))
        .otherwise(F.array(_edge("unmatched", reason=F.coalesce(_says("no_sum", F.size("_c"), F.col("amount_link")), F.lit(REASONS["none"])))))
    )
    found = idle.unionAll(met.select(*flat, F.inline(edges)))
    return found.select(ids.edge_id("action_id", "movement_id", "status", "index").alias("edge_id"), *EDGE[1:])


def _spare(movements: DataFrame) -> DataFrame:
    """An edge for each movement, as if no action were matched to it; a movement's number is its place in the transaction."""
    place = F.row_number().over(Window.partitionBy(F.lower("tx_hash")).orderBy("source_priority", "from_addr", "movement_id")) - 1
    left = movements.withColumns({"_place": place, "action_id": F.lit(None).cast("string")})
    edge = _edge("unexpected", F.struct("movement_id", "amount", "source_priority"), REASONS["unexpected"], F.col("_place"))
    flat = left.select("action_id", "chain_id", "block_number", "tx_hash", edge.alias("_e")).select("action_id", "chain_id", "block_number", "tx_hash", "_e.*")
    return flat.select(ids.edge_id("action_id", "movement_id", "status", "index").alias("edge_id"), *EDGE[1:])


def unexpected(edges: DataFrame, movements: DataFrame) -> DataFrame:
    """Edges for movements that no action of their transaction was matched to."""
    return _spare(movements).join(edges.where("movement_id IS NOT NULL").select("movement_id").distinct(), "movement_id", "left_anti").select(*EDGE)


def match_transactions(actions: DataFrame, movements: DataFrame, **how) -> DataFrame:
    """The edges of all actions, and one for each movement that none of them has; the matching is planned once, as both meet by movement."""
    edges = match_actions(actions, movements, **how).withColumn("_matched", F.lit(True))
    met = Window.partitionBy(F.coalesce("movement_id", "edge_id"))
    both = edges.unionByName(_spare(movements).withColumn("_matched", F.lit(False))).withColumn("_met", F.max("_matched").over(met))
    return both.where("_matched OR NOT _met").select(*EDGE)


def _rank(column: str = "status"):
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col(column))


def transaction_status(edges: DataFrame) -> DataFrame:
    """The worst status of each transaction, and its number of edges."""
    return edges.groupBy("chain_id", "tx_hash").agg(F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.min(_rank()).cast("int")).alias("overall_status"), F.count("*").alias("edge_count"))


def partition_status(edges: DataFrame, transactions: DataFrame, chain_id: int, from_block: int, to_block: int) -> DataFrame:
    """One row: counts of transactions by status (all six), and the share that is exact or not expected; 1 where there are none.

    ``transactions`` holds the tx_hash of every transaction with an action or a movement.
    """
    worst = transactions.select("tx_hash").distinct().join(transaction_status(edges), "tx_hash", "left").withColumn("overall_status", F.coalesce("overall_status", F.lit("exact")))
    n = {s: F.count_if(F.col("overall_status") == s) for s in STATUSES}
    counts = F.map_from_arrays(F.array(*[F.lit(s) for s in STATUSES]), F.array(*[n[s] for s in STATUSES]))
    good = (n["exact"] + n["not_expected"]).cast("double")
    return worst.agg(F.count("*").alias("tx_count"), counts.alias("counts_by_status"), F.coalesce(F.try_divide(good, F.count("*").cast("double")), F.lit(1.0)).alias("pass_rate")).select(ids.partition_id(F.lit(chain_id), F.lit(from_block), F.lit(to_block)).alias("partition_id"), "*")


def match_payment_actions(actions: DataFrame, movements: DataFrame) -> DataFrame:
    """One edge for each payment action: the first movement of its amount, whatever others there are."""
    target = F.when(F.col("output_amount") > 0, F.col("output_amount")).otherwise(F.col("source_amount"))
    rows = actions.withColumns({"_target": target, "_tx": F.lower("tx_hash")}).drop("movement_id")
    idle = rows.where("kind = 'pa_config_changed' OR _target = 0")
    m = movements.select(F.lower("tx_hash").alias("_tx"), "movement_id", F.col("amount").alias("_target"), F.col("source_priority").alias("_source"), F.col("from_addr").alias("_from"))
    met = rows.where("NOT (kind = 'pa_config_changed' OR _target = 0)").join(m, ["_tx", "_target"], "left").withColumn("_n", F.row_number().over(Window.partitionBy("action_id").orderBy("_source", "_from", "movement_id"))).where("_n = 1")
    common = ["chain_id", "block_number", "tx_hash"]
    none = F.lit(None).cast("string")
    edge = lambda df, status, tail, movement, amount, method, reason: df.select(ids.digest(F.lit("pa_edge"), "action_id", *tail).alias("edge_id"), "action_id", movement.alias("movement_id"), amount.cast("decimal(38,0)").alias("allocated_amount"), F.lit(status).alias("status"), method.alias("method"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), *common)
    out = edge(idle, "not_expected", [F.lit("not_expected")], none, F.lit(0), none, _says("pa_idle", F.col("kind")))
    out = out.unionAll(edge(met.where("movement_id IS NULL"), "unmatched", [F.lit("unmatched")], none, F.lit(0), none, REASONS["pa_none"]))
    return out.unionAll(edge(met.where("movement_id IS NOT NULL"), "exact", [F.col("movement_id"), F.lit("exact")], F.col("movement_id"), F.col("_target"), F.when(F.col("_source") == "log", "event_log").otherwise("trace"), REASONS["pa_exact"]))


def write_outputs(edges: DataFrame, transactions: DataFrame, partition: DataFrame, root: str, run_partition_id: str) -> dict[str, str]:
    """Write the edges, the transactions' status and the partition's row as three Parquet folders of a run."""
    out = {}
    for name, df in (("edges", edges), ("transactions", transactions), ("partition", partition)):
        out[name] = f"{root.rstrip('/')}/reconciliation/{name}/run_partition_id={run_partition_id}"
        df.write.mode("overwrite").parquet(out[name])
    return out
