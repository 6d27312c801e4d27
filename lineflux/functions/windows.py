"""Ordered-sequence expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def over(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def filled(c: Column, keys, order, default=None) -> Column:
    """The last known value, else the next known one, else the default."""
    w = over(keys, order)
    back = F.last(c, True).over(w.rowsBetween(*UP_TO))
    ahead = F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead, *([default] if default is not None else []))


def running(c: Column, keys, order) -> Column:
    return F.sum(c).over(over(keys, order).rowsBetween(*UP_TO))


def prior_sum(c: Column, keys, order) -> Column:
    """Sum of the rows before; 0 on the first."""
    return F.coalesce(F.sum(c).over(over(keys, order).rowsBetween(*BEFORE)), F.lit(0))


def prior_mean(c: Column, keys, order) -> Column:
    """Mean of the rows before; null on the first, so nothing leaks from the current row."""
    return F.avg(c).over(over(keys, order).rowsBetween(*BEFORE))


def sequence(keys, order) -> Column:
    return (F.row_number().over(over(keys, order)) - 1).cast("long")


def average_rank(keys, order_by: Column) -> Column:
    """Rank where ties share the mean of their places."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(order_by)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, order_by)) - 1) / 2.0


def islands(changed: Column, keys, order) -> Column:
    """A number that grows by one where `changed` is true."""
    return F.sum(changed.cast("int")).over(over(keys, order).rowsBetween(*UP_TO))
