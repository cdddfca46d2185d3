"""Expressions: a thin tree over ``pyspark.sql.Column`` that also knows its columns and its simple bounds.

Catalyst does pushdown and pruning; the bounds serve only to skip data files by the statistics in a snapshot's manifest.
"""

from __future__ import annotations

import builtins
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Bound = tuple[str, str, Any]  # column, operator, literal


def column_of(x: Any) -> Column:
    """An expression, Column or plain value as a Column."""
    return x.column if isinstance(x, Expr) else x if isinstance(x, Column) else F.lit(x)


def named(x: Any) -> Column:
    """As :func:`column_of`, but a string names a column."""
    return F.col(x) if isinstance(x, str) else column_of(x)


class Expr:
    """An expression; ``bounds`` hold wherever it is true, ``refs`` are the columns it reads (None: not known).

    ``aggregate``: whether it is one, or ``distinct`` (of distinct values) or ``large`` (one whose state is).
    """

    def __init__(self, column: Column, refs: frozenset[str] | None = None, bounds: tuple[Bound, ...] = (), name: str | None = None, literal: Any = None, aggregate: bool | str = False):
        self.column, self.refs, self.bounds, self.name, self.literal, self.aggregate = column, refs, bounds, name, literal, aggregate

    def __repr__(self) -> str:
        return f"Expr({self.column})"

    def _with(self, other: Any, op: str, made: Column) -> Expr:
        refs = None if self.refs is None or (isinstance(other, Expr) and other.refs is None) or isinstance(other, Column) else self.refs | (other.refs if isinstance(other, Expr) else frozenset())
        value = other.literal if isinstance(other, Expr) else other
        plain = self.name is not None and value is not None and not isinstance(other, Column) and (not isinstance(other, Expr) or other.literal is not None)
        bounds = ((self.name, op, value),) if plain and op in ("=", "<", "<=", ">", ">=") else ()
        kinds = (self.aggregate, other.aggregate if isinstance(other, Expr) else False)
        return Expr(made, refs, bounds, aggregate=next((k for k in ("distinct", "large", True) if k in kinds), False))

    def __eq__(self, o):  # type: ignore[override]
        return self._with(o, "=", self.column == column_of(o))

    def __ne__(self, o):  # type: ignore[override]
        return self._with(o, "!=", self.column != column_of(o))

    def __lt__(self, o):
        return self._with(o, "<", self.column < column_of(o))

    def __le__(self, o):
        return self._with(o, "<=", self.column <= column_of(o))

    def __gt__(self, o):
        return self._with(o, ">", self.column > column_of(o))

    def __ge__(self, o):
        return self._with(o, ">=", self.column >= column_of(o))

    def __and__(self, o):
        made = self._with(o, "and", self.column & column_of(o))
        made.bounds = self.bounds + (o.bounds if isinstance(o, Expr) else ())
        return made

    def __or__(self, o):
        return self._with(o, "or", self.column | column_of(o))

    def __invert__(self):
        return Expr(~self.column, self.refs)

    def __add__(self, o):
        return self._with(o, "+", self.column + column_of(o))

    def __sub__(self, o):
        return self._with(o, "-", self.column - column_of(o))

    def __mul__(self, o):
        return self._with(o, "*", self.column * column_of(o))

    def __truediv__(self, o):
        return self._with(o, "/", self.column / column_of(o))

    __hash__ = object.__hash__

    def is_in(self, values) -> Expr:
        values = [*values]
        plain = self.name is not None and values and len({type(v) for v in values}) == 1 and not isinstance(values[0], (Expr, Column))
        bounds = ((self.name, ">=", builtins.min(values)), (self.name, "<=", builtins.max(values))) if plain else ()
        return Expr(self.column.isin(values), self.refs, bounds)

    def is_null(self) -> Expr:
        return Expr(self.column.isNull(), self.refs)

    def is_not_null(self) -> Expr:
        return Expr(self.column.isNotNull(), self.refs)

    def between(self, low: Any, high: Any) -> Expr:
        return (self >= low) & (self <= high)

    def like(self, pattern: str) -> Expr:
        return Expr(self.column.like(pattern), self.refs)

    def startswith(self, prefix: str) -> Expr:
        return Expr(self.column.startswith(prefix), self.refs)

    def endswith(self, suffix: str) -> Expr:
        return Expr(self.column.endswith(suffix), self.refs)

    def contains(self, part: str) -> Expr:
        return Expr(self.column.contains(part), self.refs)

    def rlike(self, pattern: str) -> Expr:
        return Expr(self.column.rlike(pattern), self.refs)

    def field(self, name: str) -> Expr:
        """A field of a struct."""
        return Expr(self.column.getField(name), self.refs)

    def item(self, key: Any) -> Expr:
        """An element of an array (from 0) or a map."""
        return Expr(self.column.getItem(key), self.refs)

    def cast(self, kind: str) -> Expr:
        return Expr(self.column.cast(kind), self.refs, aggregate=self.aggregate)

    def alias(self, name: str) -> Expr:
        return Expr(self.column.alias(name), self.refs, self.bounds, aggregate=self.aggregate)

    def asc(self) -> Expr:
        return Expr(self.column.asc(), self.refs)

    def desc(self) -> Expr:
        return Expr(self.column.desc(), self.refs)


def col(name: str) -> Expr:
    return Expr(F.col(name), frozenset([name]), name=name)


def lit(value: Any) -> Expr:
    return Expr(F.lit(value), frozenset(), literal=value)


class Case(Expr):
    """``when(condition, value).when(...).otherwise(value)``; the first condition that is true wins, NULL where none is."""

    def when(self, condition: Any, value: Any) -> Case:
        return Case(self.column.when(column_of(condition), column_of(value)))

    def otherwise(self, value: Any) -> Expr:
        return Expr(self.column.otherwise(column_of(value)))


def when(condition: Any, value: Any) -> Case:
    return Case(F.when(column_of(condition), column_of(value)))


class Aggregate(Expr):
    def __init__(self, column: Column, kind: bool | str = True):
        super().__init__(column, aggregate=kind)

    def over(self, partition_by=None, order_by=None, descending: bool | list[bool] = False, rows: tuple | None = None, range_: tuple | None = None) -> Expr:
        return Expr(self.column.over(_window(partition_by, order_by, descending, rows, range_)))


def count_if(condition: Any) -> Aggregate:
    """Rows for which the condition is true."""
    return Aggregate(F.count_if(named(condition)))


def only(aggregate: Callable[[Any], Aggregate], x: Any, condition: Any) -> Aggregate:
    """The aggregate of ``x`` over the rows for which the condition is true."""
    return aggregate(F.when(named(condition), named(x)))


def stddev(x: Any) -> Aggregate:
    return Aggregate(F.stddev(named(x)))


def variance(x: Any) -> Aggregate:
    return Aggregate(F.variance(named(x)))


def median(x: Any) -> Aggregate:
    return Aggregate(F.median(named(x)), "large")


def percentile(x: Any, share: float | list[float], approximate: bool = False) -> Aggregate:
    """Interpolated percentile; ``approximate``: a value of bounded rank error, in bounded memory."""
    return Aggregate((F.percentile_approx if approximate else F.percentile)(named(x), share), "large")


def approx_count_distinct(x: Any, error: float = 0.05) -> Aggregate:
    return Aggregate(F.approx_count_distinct(named(x), error), "large")


def collect_list(x: Any) -> Aggregate:
    return Aggregate(F.collect_list(named(x)))


def count(x: Any = None) -> Aggregate:
    """Values that aren't null; rows, without an argument."""
    return Aggregate(F.count(F.lit(1)) if x is None else F.count(named(x)))


def sum(x: Any) -> Aggregate:  # noqa: A001
    return Aggregate(F.sum(named(x)))


def avg(x: Any) -> Aggregate:
    return Aggregate(F.avg(named(x)))


def min(x: Any) -> Aggregate:  # noqa: A001
    return Aggregate(F.min(named(x)))


def max(x: Any) -> Aggregate:  # noqa: A001
    return Aggregate(F.max(named(x)))


def count_distinct(x: Any) -> Aggregate:
    return Aggregate(F.count_distinct(named(x)), "distinct")


def _list(x: Any) -> list:
    return [] if x is None else [*x] if isinstance(x, (list, tuple)) else [x]


def _window(partition_by, order_by, descending, rows=None, range_=None):
    keys = _list(order_by)
    down = descending if isinstance(descending, list) else [descending] * len(keys)
    spec = Window.partitionBy(*[named(k) for k in _list(partition_by)])
    if keys:
        spec = spec.orderBy(*[named(k).desc() if d else named(k) for k, d in zip(keys, down, strict=True)])
    if rows:
        spec = spec.rowsBetween(*rows)
    return spec.rangeBetween(*range_) if range_ else spec


class Ranking(Expr):
    """A window function; without an order, rows are numbered as they come."""

    def __init__(self, column: Column, ordered: bool = False):
        super().__init__(column)
        self.ordered = ordered

    def over(self, partition_by=None, order_by=None, descending: bool | list[bool] = False) -> Expr:
        if order_by is None and self.ordered:
            raise ValueError("rank functions need order_by")
        return Expr(self.column.over(_window(partition_by, order_by if order_by is not None else [F.monotonically_increasing_id()], descending)))


def row_number() -> Ranking:
    return Ranking(F.row_number())


def rank() -> Ranking:
    return Ranking(F.rank(), True)


def dense_rank() -> Ranking:
    return Ranking(F.dense_rank(), True)


def percent_rank() -> Ranking:
    return Ranking(F.percent_rank(), True)


def cume_dist() -> Ranking:
    return Ranking(F.cume_dist(), True)


def first_value(x: Any, ignore_nulls: bool = False) -> Aggregate:
    return Aggregate(F.first_value(named(x), F.lit(ignore_nulls)))


def last_value(x: Any, ignore_nulls: bool = False) -> Aggregate:
    """Of the frame: up to the current row, unless ``over`` is given another."""
    return Aggregate(F.last_value(named(x), F.lit(ignore_nulls)))


def nth_value(x: Any, n: int) -> Aggregate:
    return Aggregate(F.nth_value(named(x), n))


def ntile(n: int) -> Ranking:
    return Ranking(F.ntile(n), True)


def _offset(n: int) -> int:
    if n < 0:
        raise ValueError("offset must not be negative")
    return n


def lead(x: Any, offset: int = 1, default: Any = None) -> Ranking:
    return Ranking(F.lead(named(x), _offset(offset), default))


def lag(x: Any, offset: int = 1, default: Any = None) -> Ranking:
    return Ranking(F.lag(named(x), _offset(offset), default))
