"""Dates, ratios and amounts as the marts use them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def date_from_seconds(seconds) -> Column:
    return F.to_date(F.timestamp_seconds(_c(seconds)))


def week_start(date) -> Column:
    """Monday of the date's ISO week."""
    return F.to_date(F.trunc(_c(date), "week"))


def safe_divide(a, b) -> Column:
    """Ratio in double precision; null where the divisor is null or zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def display_amount(x) -> Column:
    """Whole tokens of 10^18 units, for display only."""
    return _c(x).cast("double") / F.lit(1e18)


def account_kind(account) -> Column:
    """What stands before the first colon."""
    return F.substring_index(_c(account), ":", 1)


def account_owner(account) -> Column:
    """What stands after the first colon."""
    a = _c(account)
    return F.regexp_replace(a, "^[^:]*:", "")


def first_of(maps: list, names: list[str]) -> Column:
    """First value that isn't null: all names in the first map, then all in the next."""
    return F.coalesce(*[F.try_element_at(_c(m), F.lit(n)) for m in maps for n in names])


def first_by_name(maps: list, names: list[str], skip_empty: bool = False) -> Column:
    """First value that isn't null: each name in all maps, then the next name."""
    values = [F.try_element_at(_c(m), F.lit(n)) for n in names for m in maps]
    return F.coalesce(*[F.nullif(v, F.lit("")) if skip_empty else v for v in values])
