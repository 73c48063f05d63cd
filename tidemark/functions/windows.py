"""Rolling expressions over ordered rows, null until their frame holds enough values."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEYS, ORDER = ("symbol",), "date"


def ordered(keys: tuple[str, ...] = KEYS, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int | None, keys: tuple[str, ...] = KEYS, order: str = ORDER) -> WindowSpec:
    """The last n rows with the current one, or all rows so far."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)


def guarded(value: Column, counted: Column, frame: WindowSpec, least: int) -> Column:
    """An aggregate over a frame where at least so many of the counted values are there."""
    return F.when(F.count(counted).over(frame) >= least, value.over(frame))


def rolling(function, x: Column, n: int, least: int | None = None, keys: tuple[str, ...] = KEYS, order: str = ORDER) -> Column:
    return guarded(function(x), x, trailing(n, keys, order), n if least is None else least)


def previous(x: Column | str, n: int = 1, keys: tuple[str, ...] = KEYS, order: str = ORDER) -> Column:
    return F.lag(x, n).over(ordered(keys, order))


def forward_filled(x: Column, keys: tuple[str, ...] = KEYS, order: str = ORDER) -> Column:
    return F.last(x, ignorenulls=True).over(trailing(None, keys, order))


def backward_filled(x: Column, keys: tuple[str, ...] = KEYS, order: str = ORDER) -> Column:
    return F.first(x, ignorenulls=True).over(ordered(keys, order).rowsBetween(0, Window.unboundedFollowing))


def midrank(x: Column, n: int, least: int, keys: tuple[str, ...] = KEYS, order: str = ORDER) -> Column:
    """The mid-rank in percent of the last value there is among those of the frame; nulls take the rank before."""
    frame = trailing(n, keys, order)
    values = F.collect_list(x).over(frame)
    last = F.element_at(values, -1)
    less, same = F.size(F.filter(values, lambda v: v < last)), F.size(F.filter(values, lambda v: v == last))
    rank = F.lit(100.0) * (less + F.lit(0.5) * (same - 1)) / F.greatest(F.size(values) - 1, F.lit(1))
    return F.when(F.count(x).over(frame) >= least, rank)


def island(flag: Column, keys: tuple[str, ...] = KEYS, order: str = ORDER) -> Column:
    """A number that rows of one run of true flags share."""
    return F.sum(F.when(flag, 0).otherwise(1)).over(trailing(None, keys, order))
