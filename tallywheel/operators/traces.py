"""Call traces as flat rows: a frame's path is an array of child numbers, the root's is empty.

Paths are the tree. Ancestors are the path's prefixes, siblings sort by number, and the order of arrays
is the pre-order of a walk, so nothing recurses after the nested JSON has been flattened.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from tallywheel.functions import ids
from tallywheel.functions.fixed import TRANSFER_FROM_SELECTOR, TRANSFER_SELECTOR
from tallywheel.functions.hexes import parse_path, word_to_text
from tallywheel.operators.decode import decode_calldata
from tallywheel.sources.registry import Registry


def flatten_call_trace() -> UserDefinedTableFunction:
    """Table function over the JSON of a nested call trace; register it, or use it with LATERAL.

    A frame has status 0 if it or a frame above it failed. Nothing that a text can hold ends the job:
    one that isn't JSON gives a single row with problem ``malformed_json``, a child that is no object one
    with ``malformed_frame``, calls that are no list are none (``malformed_calls``), and a value that is no 0x
    quantity of 256 bits (as "0x") is null (``malformed_value``).
    """

    @F.udtf(returnType="trace_address array<int>, call_type string, from_address string, to_address string, value string, gas string, gas_used string, input string, output string, error string, revert_reason string, status int, subtraces int, problem string")
    class Flatten:
        def eval(self, text: str):
            if not text:
                return
            try:
                root = json.loads(text)
            except (ValueError, RecursionError):
                yield [], *[None] * 10, 0, 0, "malformed_json"
                return
            text_of = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"), sort_keys=True)
            stack = [(root, [], False)]
            while stack:
                node, path, above = stack.pop()
                if not isinstance(node, dict):
                    yield path, *[None] * 10, 0, 0, "malformed_frame"
                    continue
                failed = above or any(text_of(node.get(n)) for n in ("error", "revertReason"))
                calls, problem = node.get("calls") or [], None
                if not isinstance(calls, list):
                    calls, problem = [], "malformed_calls"
                value = node.get("value") or "0x0"
                if isinstance(value, str) and re.fullmatch("0[xX][0-9a-fA-F]{1,64}", value):
                    value = str(int(value, 16))
                else:
                    value, problem = None, "malformed_value"
                lower = lambda name, node=node: (text_of(node.get(name)) or "").lower()
                yield path, text_of(node.get("type")), lower("from"), lower("to") or None, value, *[text_of(node.get(n)) for n in ("gas", "gasUsed", "input", "output", "error", "revertReason")], int(not failed), len(calls), problem
                stack.extend((c, [*path, i], failed) for i, c in reversed(list(enumerate(calls))))

    return Flatten


_LEVELS = """
    WITH RECURSIVE frames AS (
        SELECT own, try_parse_json(text) AS node, CAST(array() AS array<int>) AS path, false AS above FROM {rows} WHERE text <> ''
        UNION ALL
        SELECT own, c.value, concat(path, array(c.pos)), above OR coalesce(try_variant_get(node, '$.error', 'string'), '') <> '' OR coalesce(try_variant_get(node, '$.revertReason', 'string'), '') <> ''
        FROM frames, LATERAL posexplode(try_variant_get(node, '$.calls', 'array<variant>')) AS c(pos, value))
    SELECT * FROM frames
"""


def flatten_trace_json(rows: DataFrame, text: str) -> DataFrame:
    """The frames of nested call traces, as the table function gives them, with the other columns of ``rows``; all in the JVM.

    The JSON is parsed once into a variant; from then on each step of a recursive query takes the calls of all
    frames of one level of all traces, so there are as many steps as levels in the deepest trace. Problems
    are those of the table function. Its parser takes a thousand nested brackets, five hundred levels of
    calls; a deeper trace ends as ``malformed_json`` here and is left to the table function.
    """
    spark = rows.sparkSession
    for limit, most in (("Row", -1), ("Level", 600)):
        spark.conf.set(f"spark.sql.cteRecursion{limit}Limit", most)
    given = rows.select(F.struct(*[rows[c] for c in rows.columns if c != text]).alias("own"), rows[text].alias("text"))
    found = spark.sql(_LEVELS, rows=given)
    of = lambda name, kind="string": F.try_variant_get("node", f"$.{name}", kind)
    calls, said = of("calls", "array<variant>"), lambda name: F.coalesce(of(name), F.lit("")) != ""
    value = F.coalesce(F.nullif(of("value"), F.lit("")), F.lit("0x0"))
    frame = F.try_variant_get("node", "$", "map<string,variant>").isNotNull()
    sound = value.rlike("^0[xX][0-9a-fA-F]{1,64}$")
    failed = F.col("above") | said("error") | said("revertReason")
    problem = F.when(F.col("node").isNull(), "malformed_json").when(~frame, "malformed_frame").when(~sound, "malformed_value").when(calls.isNull() & of("calls", "variant").isNotNull() & ~F.is_variant_null(of("calls", "variant")), "malformed_calls")
    known = {
        "trace_address": F.col("path"),
        "call_type": of("type"),
        "from_address": F.coalesce(F.lower(of("from")), F.lit("")),
        "to_address": F.nullif(F.lower(of("to")), F.lit("")),
        "value": F.when(sound, word_to_text(F.lpad(F.substr(value, F.lit(3)), 64, "0"))),
        **{column: of(name) for column, name in (("gas", "gas"), ("gas_used", "gasUsed"), ("input", "input"), ("output", "output"), ("error", "error"), ("revert_reason", "revertReason"))},
        "status": (~failed).cast("int"),
        "subtraces": F.coalesce(F.size(calls), F.lit(0)),
    }
    none = {"trace_address": F.col("path"), "status": F.lit(0), "subtraces": F.lit(0)}
    return found.select("own.*", *[F.when(frame, x).otherwise(none.get(c, F.lit(None))).alias(c) for c, x in known.items()], problem.alias("problem"))


def normalise_traces(rows: DataFrame) -> DataFrame:
    """Trace rows of a warehouse table: paths parsed, call types filled in, failed frames without an error marked reverted."""
    kind = F.coalesce(F.nullif("call_type", F.lit("")), F.nullif("trace_type", F.lit("")) if "trace_type" in rows.columns else F.lit(None), F.lit("call"))
    path = parse_path("trace_address") if dict(rows.dtypes)["trace_address"] == "string" else F.coalesce("trace_address", F.array().cast("array<int>"))
    return rows.withColumns({"trace_address": path, "call_type": F.lower(kind), "error": F.when((F.col("status") == 0) & F.col("error").isNull(), "reverted").otherwise(F.col("error")), "to_address": F.lower("to_address"), "from_address": F.lower("from_address")})


def trace_problems(frames: DataFrame) -> DataFrame:
    """tx_hash and problem of each malformed tree: duplicate_path, no_root or missing_parent."""
    twice = frames.groupBy("tx_hash", "trace_address").count().where("count > 1").select("tx_hash", F.lit("duplicate_path").alias("problem"))
    rootless = frames.groupBy("tx_hash").agg(F.count_if(F.size("trace_address") == 0).alias("n")).where("n = 0").select("tx_hash", F.lit("no_root").alias("problem"))
    child = frames.where(F.size("trace_address") > 0).select("tx_hash", F.slice("trace_address", F.lit(1), F.size("trace_address") - 1).alias("trace_address"))
    orphan = child.join(frames.select("tx_hash", "trace_address"), ["tx_hash", "trace_address"], "left_anti").select("tx_hash", F.lit("missing_parent").alias("problem"))
    return twice.unionAll(rootless).unionAll(orphan).distinct()


def preorder(frames: DataFrame) -> DataFrame:
    return frames.orderBy("tx_hash", "trace_address")


def walk(frames: DataFrame, predicate) -> DataFrame:
    """Frames for which a predicate (a column, or a function from the frame table to one) holds, in pre-order."""
    return preorder(frames.where(predicate(frames) if callable(predicate) else predicate))


def with_ancestor_success(frames: DataFrame) -> DataFrame:
    """``frames`` with success (no error of its own) and parent_success (none above it; true for the root).

    In path order the frames below one follow it without a break, up to the path with its last number
    plus one. So a frame lies below a failed one exactly if the greatest such bound of the failed frames
    with smaller paths is above its own path: one pass over each transaction's frames, whatever their
    depth, with one shuffle. Frames that share a path aren't below each other; those without a
    transaction have no frames above them.
    """
    own = frames.withColumn("success", F.col("error").isNull() & (F.col("revert_reason").isNull() if "revert_reason" in frames.columns else F.lit(True)))
    path, depth = F.col("trace_address"), F.size("trace_address")
    bound = F.when(depth == 0, F.array(F.lit(2**31 - 1))).otherwise(F.concat(F.slice(path, F.lit(1), depth - 1), F.array(F.element_at(path, -1) + 1)))
    tree = Window.partitionBy("tx_hash")
    placed = own.withColumn("_place", F.dense_rank().over(tree.orderBy("trace_address")))
    before = tree.orderBy("_place").rangeBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(~F.col("success"), bound)).over(before)
    return placed.withColumn("_reach", reach).withColumn("parent_success", F.coalesce(F.col("tx_hash").isNull() | (F.col("_reach") <= path), F.lit(True))).drop("_place", "_reach")


def decode_trace_calls(frames: DataFrame, registry: Registry) -> DataFrame:
    """Decoded calls of all frames, with their success and that of the frames above."""
    found = decode_calldata(with_ancestor_success(frames), registry)
    return found.withColumns({"raw_trace_call_id": ids.raw_trace_call_id("tx_hash", "trace_address"), "contract_address": F.lower(F.coalesce("to_address", F.lit("")))})


def token_transfer_calls(calls: DataFrame, token: str, receipts: DataFrame, fill_caller: bool = False) -> DataFrame:
    """Transfers that took effect: the frame, all frames above it and the transaction succeeded.

    A plain transfer names no sender; ``fill_caller`` takes the frame's caller, else it is empty.
    """
    named = F.col("method_name").isin("transfer", "transferFrom") | F.col("method_selector").isin(TRANSFER_SELECTOR, TRANSFER_FROM_SELECTOR)
    ok = receipts.where("status = 1").select(F.lower("tx_hash").alias("_tx")).distinct()
    kept = calls.where((F.col("contract_address") == token) & named & F.col("success") & F.col("parent_success")).join(ok, F.lower("tx_hash") == F.col("_tx"), "left_semi")
    sender = F.coalesce(F.try_element_at("params", F.lit("from")), F.lower("from_address") if fill_caller else F.lit(""))
    amount = F.coalesce(*[F.try_element_at("params", F.lit(n)) for n in ("amount", "value", "_value")]).try_cast("decimal(38,0)")  # null beyond 38 digits
    to = F.coalesce(*[F.try_element_at("params", F.lit(n)) for n in ("to", "_to", "recipient")])
    return kept.withColumns({"token_address": F.lit(token), "from_addr": sender, "to_addr": to, "amount": amount})
