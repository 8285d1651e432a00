"""Data-quality checks as one-row tables, generic column tests, and parity of two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywheel.operators.ledger import balance_by


def _row(name: str, severity: str, passed: Column, metric: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), F.lit(severity).alias("severity"), detail.alias("detail"), metric.cast("double").alias("metric_value"))


def _check(df: DataFrame, *row) -> DataFrame:
    return df.select(_row(*row).alias("_row")).select("_row.*")


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _unmatched() -> tuple:
    n = F.coalesce(F.try_element_at("counts_by_status", F.lit("unmatched")), F.lit(0))
    return "no_unmatched_economic_actions", "critical", n == 0, n, _said(n, " unmatched transactions")


def _rate(least: float) -> tuple:
    return "pass_rate", "warn", F.col("pass_rate") >= least, F.col("pass_rate"), _said("pass rate ", F.col("pass_rate"))


def no_unmatched_actions(partition: DataFrame) -> DataFrame:
    return _check(partition, *_unmatched())


def partition_checks(partition: DataFrame, least: float = 0.95) -> DataFrame:
    """``no_unmatched_actions`` and ``pass_rate`` of one partition, whose matching is planned once for both."""
    return partition.select(F.inline(F.array(_row(*_unmatched()), _row(*_rate(least)))))


def no_duplicate_ids(rows: DataFrame, column: str = "decoded_event_id") -> DataFrame:
    """The metric is the number of occurrences beyond the first of each id."""
    extra = rows.agg((F.count(column) - F.count_distinct(column)).alias("extra"))
    return _check(extra, "no_duplicate_event_ids", "critical", F.col("extra") == 0, F.col("extra"), _said(F.col("extra"), " repeated ids"))


def freshness(blocks: DataFrame, now: int, most: int = 1800, column: str = "timestamp") -> DataFrame:
    lag = blocks.agg(F.greatest(F.lit(now) - F.max(column), F.lit(0)).alias("lag"))
    return _check(lag, "freshness", "warn", F.coalesce(F.col("lag") <= most, F.lit(False)), F.col("lag"), _said(F.coalesce(F.col("lag"), F.lit(-1)), " seconds behind"))


def unknown_signatures(failures: DataFrame, threshold_percent: float = 0.5, attempts: int | None = None) -> DataFrame:
    r = failures.agg(F.count_if(F.col("failure_reason") == "unknown_topic").alias("n"), F.greatest(F.lit(1), F.count("*") if attempts is None else F.lit(attempts)).alias("d")).withColumn("share", F.col("n") * 100.0 / F.col("d"))
    return _check(r, "unknown_signatures", "warn", F.col("share") <= threshold_percent, F.col("share"), _said(F.col("n"), " of ", F.col("d"), " logs have an unknown topic"))


def unknown_share(failures: DataFrame, threshold_percent: float = 0.5) -> DataFrame:
    """One row if more than the threshold of all failures are unknown topics, else none; none without failures."""
    r = failures.agg(F.count("*").alias("total_failures"), F.count_if(F.col("failure_reason") == "unknown_topic").alias("unknown_topic_count"))
    return r.where((F.col("total_failures") > 0) & (F.col("unknown_topic_count") * 100.0 / F.col("total_failures") > threshold_percent))


def balance_consistency(differences: DataFrame, tolerance: int = 0, column: str = "difference") -> DataFrame:
    r = differences.agg(F.count_if(F.abs(column) > tolerance).alias("n"), F.coalesce(F.max(F.abs(column)), F.lit(0)).alias("worst"))
    return _check(r, "balance_consistency", "critical", F.col("n") == 0, F.col("worst"), _said(F.col("n"), " pools differ"))


def ledger_balanced(entries: DataFrame) -> DataFrame:
    bad = balance_by(entries.where(F.coalesce("tx_hash", F.lit("")) != ""), "tx_hash").where("delta <> 0")
    least = bad.orderBy("tx_hash").limit(10).agg(F.array_sort(F.collect_list("tx_hash")).alias("which"))  # ten at most
    r = bad.agg(F.count("*").alias("n")).crossJoin(least)  # one row and one row
    return _check(r, "ledger_balanced_per_tx", "critical", F.col("n") == 0, F.col("n"), _said(F.col("n"), " unbalanced: ", F.array_join("which", ", ")))


def pass_rate(partition: DataFrame, least: float = 0.95) -> DataFrame:
    return _check(partition, *_rate(least))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def fails_run(checks: DataFrame) -> DataFrame:
    """Critical failures; warnings only alert."""
    return checks.where("NOT passed AND severity = 'critical'")


def alert_text(check) -> str:
    return f"[{check['severity'].upper()}] {check['name']}: {check['detail']}"


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(Column.__or__, [F.col(c).isNull() for c in columns]))


def not_unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def not_accepted(df: DataFrame, column: str, values: list[str], where: str | None = None) -> DataFrame:
    rows = df.where(where) if where else df
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent, on, "left_anti")


def parity(left: DataFrame, right: DataFrame, amount: str, keys: list[str]) -> DataFrame:
    """Counts and sums of two tables, and how many rows each has that the other lacks (by keys and amount)."""
    both = left.select(*keys, amount, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(right.select(*keys, amount, F.lit(0), F.lit(1)))
    rows = both.groupBy(*keys, amount).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return rows.agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"), F.sum(F.col(amount) * F.col("_l")).alias("left_amount"), F.sum(F.col(amount) * F.col("_r")).alias("right_amount"), F.sum(F.greatest(F.col("_l") - F.col("_r"), F.lit(0))).alias("only_left"), F.sum(F.greatest(F.col("_r") - F.col("_l"), F.lit(0))).alias("only_right"))


def _signed_rows(left: DataFrame, right: DataFrame, amount: str, keys: list[str], buckets: int) -> DataFrame:
    """Rows of both tables, those of the right one with a minus, with two hashes of all of a row and two buckets of its keys."""
    one = lambda df, sign: df.select(*keys, amount, F.lit(sign).alias("_sign"))
    h, at = F.xxhash64(F.lit("row"), *keys, amount), F.xxhash64(F.lit("bucket"), *keys)
    hashes = {"_h": h.cast("decimal(38,0)"), "_g": F.xxhash64(F.lit("again"), *keys, amount).cast("decimal(38,0)")}
    places = {"_coarse": F.pmod(at, F.lit(buckets)).cast("int"), "_fine": F.pmod(F.shiftrightunsigned(at, 32), F.lit(buckets)).cast("int")}
    return one(left, 1).unionAll(one(right, -1)).withColumns(hashes | places)


def differing_rows(left: DataFrame, right: DataFrame, amount: str, keys: list[str], buckets: int = 4096) -> tuple[dict, DataFrame]:
    """Totals of both tables, and the rows (with ``_sign``) of those places where they differ.

    Order-free digests of each bucket of keys, summed in each task before the shuffle, tell the coarse
    buckets that differ; in these alone digests of fine buckets tell which rows have to be compared. With few
    differences a share of one in ``buckets`` squared for each of them is shuffled, whatever the tables' size. A
    difference is overlooked where two sums of 64-bit hashes agree by chance.
    """
    rows = _signed_rows(left, right, amount, keys, buckets)
    apart = [F.sum(F.col(c) * F.col("_sign")).alias(c) for c in ("_h", "_g")]
    side = lambda sign, x: F.sum(F.when(F.col("_sign") == sign, x).otherwise(x * 0))
    sums = [x.alias(n) for n, x in {"left_rows": side(1, F.lit(1)), "right_rows": side(-1, F.lit(1)), "left_amount": side(1, F.col(amount)), "right_amount": side(-1, F.col(amount))}.items()]
    coarse = rows.groupBy("_coarse").agg(*sums, *apart).collect()  # one row for each of so many buckets
    differ = [r["_coarse"] for r in coarse if r["_h"] or r["_g"]]
    totals = {n: [r[n] for r in coarse if r[n] is not None] for n in ("left_rows", "right_rows", "left_amount", "right_amount")}
    within = rows.where(F.col("_coarse").isin(differ))
    fine = within.groupBy("_coarse", "_fine").agg(*apart).where("_h <> 0 OR _g <> 0").select("_coarse", "_fine")
    return {n: sum(x) if x else None for n, x in totals.items()}, within.join(fine, ["_coarse", "_fine"], "left_semi").select(*keys, amount, "_sign")


def parity_by_digests(left: DataFrame, right: DataFrame, amount: str, keys: list[str], buckets: int = 4096) -> DataFrame:
    """What ``parity`` tells, with a shuffle of rows only where the tables differ."""
    totals, rows = differing_rows(left, right, amount, keys, buckets)
    kind = left.agg(F.sum(amount)).dtypes[0][1]
    most = lambda sign: F.coalesce(F.sum(F.greatest(sign * F.col("_n"), F.lit(0))), F.lit(0))
    found = rows.groupBy(*keys, amount).agg(F.sum("_sign").alias("_n")).agg(most(1).alias("only_left"), most(-1).alias("only_right"))
    value = lambda n: F.lit(totals[n]).cast(kind if n.endswith("amount") else "long").alias(n)
    return found.select(*map(value, totals), "only_left", "only_right")


def first_of_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in the given order."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def metrics(decode_results: DataFrame, partition: DataFrame, reorgs: DataFrame) -> DataFrame:
    """metric and value: decode failure rate in percent, pass rate, reorganised blocks and distinct unknown topics.

    All logs are decoded once: unknown ones are counted by topic, all others together, and both figures follow from the counts.
    """
    unknown = F.col("failure_reason") == "unknown_topic"
    by_topic = decode_results.select(F.coalesce(~F.col("success"), F.lit(False)).alias("failed"), F.when(unknown, F.get("topics", 0)).alias("topic")).groupBy("topic").agg(F.count_if("failed").alias("failures"), F.count("*").alias("logs"))
    totals = by_topic.agg(F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), F.coalesce(F.sum("logs"), F.lit(0)).alias("logs"), F.count("topic").cast("double").alias("topics"))
    rate = (F.col("failures") * 100.0 / F.greatest(F.col("logs"), F.lit(1))).cast("double")
    decoded = totals.select(F.inline(F.array(_metric("decode_failure_rate", rate), _metric("unknown_signatures", F.col("topics")))))
    passed = partition.select(F.lit("reconciliation_pass_rate").alias("metric"), F.col("pass_rate").alias("value"))
    blocks = reorgs.agg(F.count("*").cast("double").alias("value")).select(F.lit("reorg_events").alias("metric"), "value")
    return decoded.unionAll(passed).unionAll(blocks)


def _metric(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), value.alias("value"))
