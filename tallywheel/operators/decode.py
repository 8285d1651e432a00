"""Event logs and calldata against versioned ABIs, with a reason for each failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywheel.functions import ids
from tallywheel.functions.abi import nested_values
from tallywheel.functions.fixed import TRANSFER_FROM_SELECTOR, TRANSFER_SELECTOR
from tallywheel.functions.hexes import bare, is_hex_bytes, method_selector, word_to_address, word_to_decimal, word_to_text
from tallywheel.sources.registry import Registry, in_phase

_COMPLEMENT = ("0123456789abcdef", "fedcba9876543210")


def _signed(w: Column) -> Column:
    minus = F.lower(w).rlike("^[89a-f]")
    return F.when(minus, F.concat(F.lit("-"), word_to_text(F.translate(F.lower(w), *_COMPLEMENT), negative=True))).otherwise(word_to_text(w))


def _bound(value: Column, f) -> Column:
    """``f`` of a value that gets a name, as an expression in a lambda is evaluated at each of its places."""
    return F.get(F.transform(F.array(value), f), 0)


def _whole(kind: Column, w: Column) -> Column:
    """Whether a number's word holds no more bits than its type: the digits above are zeros, or for one below zero all ones."""
    bits = F.coalesce(F.regexp_extract(kind, "^u?int([0-9]+)$", 1).try_cast("int"), F.lit(256))

    def fits(spare: Column) -> Column:
        above, first = F.lower(F.substr(w, F.lit(1), spare)), F.lower(F.substr(w, spare + 1, F.lit(1)))
        zeros = above == F.repeat(F.lit("0"), spare)
        return F.when(kind.startswith("u"), zeros).otherwise(zeros & (first < "8") | (above == F.repeat(F.lit("f"), spare)) & (first >= "8"))

    return _bound(F.lit(64) - F.shiftright(F.least(bits, F.lit(256)), 2), fits)


def _content(w: Column, body: Column) -> Column:
    """Hex digits of a string or bytes: at the place in ``w`` their size, then so many bytes, padded with zeros to whole words."""
    within = lambda word: _bound(word_to_decimal(word), lambda x: F.when(x <= F.length(body) / 2, x.cast("int") * 2))
    padded = lambda size: F.ceil(size / 64).cast("int") * 64
    cut = lambda size: lambda tail: F.when((F.length(tail) == padded(size)) & F.substr(tail, size + 1, F.lit(64)).rlike("^0*$"), F.substr(tail, F.lit(1), size))
    return _bound(within(w), lambda at: _bound(within(F.substr(body, at + 1, F.lit(64))), lambda size: _bound(F.substr(body, at + 65, padded(size)), cut(size))))


def value_text(kind: Column, w: Column, body: Column) -> Column:
    """One value as text: numbers in base 10, addresses and bytes as 0x hex; null where it doesn't fit its type.

    ``w`` is the value's word in the head and ``body`` all hex digits, where strings and bytes lie. No value
    ends a job: places and sizes beyond the data, numbers of more bits than their type, padding other than
    zeros and text that isn't UTF-8 give null.
    """
    long = lambda hexes: F.when(kind == "bytes", F.concat(F.lit("0x"), F.lower(hexes))).otherwise(F.try_validate_utf8(F.unhex(hexes).cast("string")))
    fixed = lambda n: F.when(F.substr(w, n + 1, F.lit(64)).rlike("^0*$"), F.concat(F.lit("0x"), F.lower(F.substr(w, F.lit(1), n))))
    return (
        F.when(kind.rlike("^u?int[0-9]*$"), F.when(_whole(kind, w), F.when(kind.startswith("u"), word_to_text(w)).otherwise(_signed(w))))
        .when(kind == "address", F.when(w.startswith("0" * 24), word_to_address(w)))
        .when(kind == "bool", F.when(F.lower(w) == "0" * 64, F.lit("false")).when(F.lower(w) == "0" * 63 + "1", F.lit("true")))
        .when(kind.isin("bytes", "string"), _bound(_content(w, body), long))
        .when(kind.startswith("bytes"), _bound(F.regexp_extract(kind, "^bytes([0-9]+)$", 1).try_cast("int") * 2, fixed))
    )


def _values(inputs: Column, words_at, body: Column, nested: bool, ok: Column) -> Column:
    """Texts of all values where ``ok``; rows with arrays or tuples among them go to Python, if there can be any."""
    one = lambda kind, word: _bound(word, lambda w: value_text(kind, w, body))
    plain = F.transform(inputs, lambda x, i: one(x["type"], words_at(i)))
    if not nested:
        return F.when(ok, plain)
    deep = ok & F.exists(inputs, lambda x: x["type"].contains("[") | x["type"].contains("("))
    kinds = F.transform(inputs, lambda x: x["type"])
    found = nested_values(kinds, F.when(deep, body))
    return F.when(deep, F.coalesce(found, F.transform(inputs, lambda x: F.lit(None).cast("string")))).when(ok, plain)


def _as_map(inputs: Column, values: Column) -> Column:
    return F.map_from_arrays(F.transform(inputs, lambda x: x["name"]), values)


def _complete(values: Column) -> Column:
    return ~F.exists(values, lambda v: v.isNull())


def decode_logs(logs: DataFrame, registry: Registry) -> DataFrame:
    """Every log with raw_log_id, success, failure_reason, detail and, on success, the decoded event.

    Reasons in the order they are looked for: unregistered_contract (no phase covers the block),
    unknown_topic, abi_mismatch (number of indexed parameters), malformed_data (data needed, but empty
    or no whole words), abi_mismatch (a value doesn't fit its type). A log without topics is held against
    the ABI's first anonymous event. Arrays and tuples are JSON text.
    """
    spark = logs.sparkSession
    phased = in_phase(logs, registry.phase_table(spark).select("phase_address", "from_block", "to_block", "abi", "abi_version", "role"), "address", "block_number")
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    topic, named = F.lower(F.get(topics, 0)), F.least(F.size(topics), F.lit(1))  # the first topic names the event
    events = registry.event_table(spark).withColumnRenamed("abi", "event_abi")
    joined = phased.withColumn("_topic", topic)
    joined = joined.join(events, (joined["abi"] == events["event_abi"]) & joined["_topic"].eqNullSafe(events["topic0"]), "left")
    indexed, plain = F.filter("inputs", lambda x: x["indexed"]), F.filter("inputs", lambda x: ~x["indexed"])
    joined = joined.withColumn("_body", F.coalesce(bare("data"), F.lit("")))
    body = F.col("_body")
    sound, nested = F.col("_reason").isNull(), registry.has_nested("event")
    topic_values = _values(indexed, lambda i: bare(F.get(topics, i + named)), body, False, sound)
    data_values = _values(plain, lambda i: F.substr(body, i * 64 + 1, F.lit(64)), body, nested, sound)
    staged = joined.withColumns({"_indexed": indexed, "_plain": plain})
    staged = staged.withColumn("_reason", F.when(F.col("phase_address").isNull(), "unregistered_contract").when(F.col("event_name").isNull(), "unknown_topic").when(F.size("_indexed") != F.size(topics) - named, "abi_mismatch").when((F.size("_plain") > 0) & ((F.length("_body") == 0) | (F.length("_body") % 64 != 0) | ~is_hex_bytes("_body")), "malformed_data"))
    staged = staged.withColumns({"_topics": topic_values, "_data": data_values})
    reason = F.coalesce("_reason", F.when(~_complete(F.col("_topics")) | ~_complete(F.col("_data")), "abi_mismatch"))
    staged = staged.withColumn("failure_reason", reason)
    ok = F.col("failure_reason").isNull()
    detail = F.when(F.col("_reason").isNull() & ~ok, "a value does not fit its type").when(F.col("failure_reason") == "unknown_topic", F.coalesce("_topic", F.lit("no topics")))
    return staged.select(
        *logs.columns,
        ids.raw_log_id("chain_id", "block_number", "tx_hash", "log_index").alias("raw_log_id"),
        ids.decoded_event_id("chain_id", "block_number", "tx_hash", "log_index").alias("decoded_event_id"),
        F.lower("address").alias("contract_address"),
        "role",
        "abi_version",
        ok.alias("success"),
        "failure_reason",
        detail.alias("detail"),
        F.when(ok, F.col("event_name")).alias("event_name"),
        F.when(ok, F.coalesce("_topic", F.lit(""))).alias("event_signature"),
        F.when(ok, _as_map(F.col("_indexed"), F.col("_topics"))).alias("indexed_params"),
        F.when(ok, _as_map(F.col("_plain"), F.col("_data"))).alias("data_params"),
    )


def decode_calldata(calls: DataFrame, registry: Registry, address: str = "to_address", data: str = "input") -> DataFrame:
    """Every call with method_name, method_selector, params, success_decode and failure_reason.

    A call to an unregistered contract, or one with an unknown selector, falls back to the two token
    transfer methods, then to ``<unknown>`` with no parameters.
    """
    spark = calls.sparkSession
    phased = in_phase(calls, registry.phase_table(spark).select("phase_address", "from_block", "to_block", "abi"), address, "block_number")
    phased = phased.withColumn("method_selector", method_selector(data))
    methods = registry.method_table(spark).withColumnRenamed("abi", "method_abi")
    joined = phased.join(methods, (phased["abi"] == methods["method_abi"]) & (phased["method_selector"] == methods["selector"]), "left")
    joined = joined.withColumn("_body", F.substr(F.coalesce(bare(data), F.lit("")), F.lit(9)))
    body = F.col("_body")
    sound = F.col("_reason").isNull()
    values = _values(F.col("inputs"), lambda i: F.substr(body, i * 64 + 1, F.lit(64)), body, registry.has_nested("function"), sound)
    staged = joined.withColumns({"_reason": F.when(F.col("method_name").isNull(), "unknown_topic").when(F.length(body) % 64 != 0, "malformed_data")})
    staged = staged.withColumn("_values", values)
    staged = staged.withColumn("failure_reason", F.coalesce("_reason", F.when(~_complete(F.col("_values")), "abi_mismatch")))
    ok = F.col("failure_reason").isNull()
    staged = staged.withColumn("_fast", fast_transfer(F.col(data), body))
    fast = F.col("_fast")
    return staged.select(
        *calls.columns,
        F.when(ok, F.col("method_name")).when(fast["method"].isNotNull(), fast["method"]).otherwise("<unknown>").alias("method_name"),
        "method_selector",
        F.when(ok, _as_map(F.col("inputs"), F.col("_values"))).when(fast["method"].isNotNull(), fast["params"]).otherwise(F.create_map().cast("map<string,string>")).alias("params"),
        "failure_reason",
    )


def fast_transfer(data: Column, body: Column | None = None) -> Column:
    """method and params of token transfer calldata; further bytes are ignored, null where it is neither.

    ``body`` is the hex after the selector, if a column has it already.
    """
    sel = method_selector(data)
    body = F.substr(F.coalesce(bare(data), F.lit("")), F.lit(9)) if body is None else body
    w = lambda i: F.substr(body, F.lit(64 * i + 1), F.lit(64))
    address = lambda i: F.when(w(i).startswith("0" * 24), word_to_address(w(i)))
    amount = lambda i: word_to_text(w(i))
    plain = (sel == TRANSFER_SELECTOR) & (F.length(body) >= 128) & address(0).isNotNull() & amount(1).isNotNull()
    other = (sel == TRANSFER_FROM_SELECTOR) & (F.length(body) >= 192) & address(0).isNotNull() & address(1).isNotNull() & amount(2).isNotNull()
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(plain, "transfer").when(other, "transferFrom").alias("method"),
        F.when(plain, F.create_map(F.lit("from"), none, F.lit("to"), address(0), F.lit("amount"), amount(1))).when(other, F.create_map(F.lit("from"), address(0), F.lit("to"), address(1), F.lit("amount"), amount(2))).alias("params"),
    )
