"""Hex text as addresses, selectors and numbers; all expressions stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower_address(x) -> Column:
    return F.lower(_c(x))


def bare(x) -> Column:
    """Hex text without its 0x."""
    return F.regexp_replace(_c(x), "^0[xX]", "")


def is_hex_bytes(x) -> Column:
    return F.coalesce(_c(x).rlike("^(0[xX])?([0-9a-fA-F]{2})*$"), F.lit(False))


def topic_to_address(topic) -> Column:
    """Last twenty bytes of a 32-byte topic; null for any other length."""
    t = _c(topic)
    return F.when((F.length(t) == 66) & F.lower(F.substring(t, 1, 2)).eqNullSafe("0x"), F.concat(F.lit("0x"), F.lower(F.right(t, F.lit(40)))))


def word_to_address(word) -> Column:
    w = bare(word)
    return F.when(w.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("0x"), F.lower(F.right(w, F.lit(40)))))


def is_proxy_marker(word) -> Column:
    """Whether a storage word is well formed and not zero."""
    w = bare(word)
    return F.coalesce(w.rlike("^[0-9a-fA-F]{64}$") & w.rlike("[^0]"), F.lit(False))


def method_selector(calldata) -> Column:
    """First four bytes in lower case, or 0x where there are fewer; null counts as empty."""
    raw = F.coalesce(bare(calldata), F.lit(""))
    return F.when(F.length(raw) < 8, F.lit("0x")).otherwise(F.concat(F.lit("0x"), F.lower(F.substring(raw, 1, 8))))


def word(data, i: int, skip: int = 0) -> Column:
    """The i-th 32-byte word of hex data, after ``skip`` hex digits; null beyond the end."""
    w = F.substring(bare(data), 1 + skip + 64 * i, 64)
    return F.when(F.length(w) == 64, w)


def word_to_decimal(w) -> Column:
    """An unsigned 256-bit word as DECIMAL(38,0); null where it has more digits or isn't a word."""
    x = F.lower(_c(w))
    ok = x.rlike("^0{32}[0-9a-f]{32}$")
    half = lambda at: F.conv(F.substring(x, at, 16), 16, 10).cast("decimal(20,0)")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    value = F.try_add(F.try_multiply(half(33).cast("decimal(38,0)"), two64.cast("decimal(38,0)")), half(49).cast("decimal(38,0)"))
    return F.when(ok, value.try_cast("decimal(38,0)"))


def word_to_text(w, negative: bool = False) -> Column:
    """An unsigned 256-bit word in base 10, of up to 78 digits; null where it isn't a word.

    With ``negative`` the word is all bits of a number below zero turned over, and the text that of its
    magnitude. Numbers beyond DECIMAL(38,0) are built in nine groups of nine digits, 32 bits at a time.
    """
    x, more = F.lower(_c(w)), int(negative)
    limbs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(x, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    base = 10**9

    def step(groups: Column, factor: int, add: Column) -> Column:
        """groups * factor + add, the least group first."""
        start = F.struct(add.cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        total = lambda s, g: g * F.lit(factor).cast("long") + s["carry"]
        digits = lambda s, g: F.concat(s["out"], F.array(F.pmod(total(s, g), F.lit(base).cast("long"))))
        return F.aggregate(groups, start, lambda s, g: F.struct(F.call_function("div", total(s, g), F.lit(base).cast("long")).alias("carry"), digits(s, g).alias("out")), lambda s: s["out"])

    groups = F.aggregate(limbs, F.array_repeat(F.lit(0).cast("long"), 9), lambda s, limb: step(s, 2**32, limb))
    groups = step(groups, 1, F.lit(more)) if more else groups
    digits = F.array_join(F.transform(F.reverse(groups), lambda g: F.lpad(g.cast("string"), 9, "0")), "")
    large = F.when(x.rlike("^[0-9a-f]{64}$"), F.regexp_replace(digits, "^0+(?=.)", ""))
    small = F.try_add(word_to_decimal(w), F.lit(more).cast("decimal(38,0)")) if more else word_to_decimal(w)
    return F.coalesce(small.cast("string"), large)


def quantity(x) -> Column:
    """A 0x quantity of up to sixteen digits as a number."""
    return F.conv(bare(x), 16, 10).cast("decimal(20,0)")


def parse_path(x) -> Column:
    """Trace address text '0,2,1' as an array of ints; null and empty give the root's empty array."""
    return F.transform(F.filter(F.split(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[\\[\\] ]", ""), ","), lambda s: s != ""), lambda s: s.cast("int"))


def path_text(path) -> Column:
    return F.array_join(_c(path).cast("array<string>"), ",")
