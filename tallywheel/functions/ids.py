"""Deterministic identities: SHA-256 over text keys, as pure column expressions.

A key's parts are joined by '|'; nulls count as empty, since concat_ws would drop them.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def key(*parts) -> Column:
    return F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def digest(*parts) -> Column:
    return F.sha2(key(*parts), 256)


def surrogate_key(*columns) -> Column:
    return digest(*columns)


def raw_log_id(chain, block, tx, log_index) -> Column:
    return digest(F.lit("raw_log"), chain, block, F.lower(_c(tx)), log_index)


def decoded_event_id(chain, block, tx, log_index) -> Column:
    return digest(F.lit("decoded_event"), chain, block, F.lower(_c(tx)), log_index)


def raw_trace_call_id(tx, trace_address) -> Column:
    """``trace_address`` is an array of ints; the root's is empty."""
    return digest(F.lit("raw_trace_call"), F.lower(_c(tx)), F.array_join(_c(trace_address).cast("array<string>"), ","))


def movement_id(chain, tx, from_addr, to_addr, amount, occurrence) -> Column:
    return digest(F.lit("movement"), chain, F.lower(_c(tx)), F.lower(_c(from_addr)), F.lower(_c(to_addr)), _c(amount), occurrence)


def action_id(event_id, kind) -> Column:
    return digest(F.lit("action"), event_id, kind)


def pa_action_id(event_id, kind) -> Column:
    return digest(F.lit("pa_action"), event_id, kind)


def ledger_entry_id(action, index) -> Column:
    return digest(F.lit("ledger_entry"), action, index)


def pa_ledger_entry_id(action, index) -> Column:
    return digest(F.lit("pa_ledger_entry"), action, index)


def edge_id(action, movement, status, index) -> Column:
    return digest(F.lit("edge"), action, movement, status, index)


def partition_id(chain, first, last) -> Column:
    return digest(F.lit("partition"), chain, first, last)


def run_partition_id(chain, dag, run, source, partition) -> Column:
    return digest(F.lit("run_partition"), chain, dag, run, source, partition)


def trace_occurrence(path) -> Column:
    """Path folded 16 bits at a time, as decimal text; up to seven levels fit a 38-digit decimal.

    Deeper paths give null. A negative step is an error.
    """
    p = _c(path)
    step = lambda n: F.when(n < 0, F.raise_error(F.lit("negative trace address"))).otherwise(F.pmod(n, F.lit(65536)))
    folded = F.aggregate(p, F.lit(0).cast("decimal(38,0)"), lambda acc, n: (acc * F.lit(65536).cast("decimal(6,0)") + step(n).cast("decimal(6,0)")).cast("decimal(38,0)"))
    return F.when(F.size(p) <= 7, folded.cast("string"))
