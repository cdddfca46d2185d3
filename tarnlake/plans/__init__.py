"""The query builder: each step gives a new builder over lazy DataFrames; nothing runs until the result is used."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions import Expr, named

HOWS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def collision_free(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Right-hand columns that the left has too, keys apart, get ``_right``."""
    taken = set(left.columns)
    return right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c in taken and c not in keys})


def aggregated(df: DataFrame, columns: list[Column], kinds: list[bool | str], keys: list[Column] | tuple = ()) -> DataFrame:
    """The aggregates by ``keys``. Those of distinct values are made apart from those with a large state: in one aggregate,
    Spark would keep such a state for each of the distinct values.
    """
    apart, whole = [k == "distinct" for k in kinds], df.groupBy(*keys).agg(*columns)
    plain = whole.columns[: len(keys)]
    if not any(apart) or "large" not in kinds or any("map<" in kind for _, kind in whole.dtypes[: len(keys)]):
        return whole
    sides = []
    for own in (False, True):
        side = df.groupBy(*keys).agg(*[c for c, a in zip(columns, apart, strict=True) if a == own])
        sides.append(side.toDF(*[f"k{i}_{own}" for i in range(len(keys))], *[f"c{i}_" for i, a in enumerate(apart) if a == own]))
    same = [F.col(f"k{i}_False").eqNullSafe(F.col(f"k{i}_True")) for i in range(len(keys))]
    made = sides[0].join(sides[1], same) if keys else sides[0].crossJoin(F.broadcast(sides[1]))
    return made.select(*[F.col(f"k{i}_False").alias(n) for i, n in enumerate(plain)], *[F.col(f"c{i}_").alias(n) for i, n in enumerate(whole.columns[len(keys) :])])


@dataclass(frozen=True)
class Query:
    """Order of work: scan, joins, added columns, filters, then grouping and its order, or order and projection, then limit.

    Full joins coalesce their keys; a filter means WHERE after the joins and the added columns, whatever it is written as,
    and Catalyst moves it back where that is safe. In a grouped select, the values of a column that is no key come as a
    list; in one without groups, an aggregate beside plain columns holds for every row.
    """

    lake: Any
    table: str | None
    source: Any  # bounds -> DataFrame
    selected: tuple = ()
    filters: tuple = ()
    joins: tuple = ()
    keys: tuple | None = None
    order: tuple = ()
    n: int | None = None
    skip: int = 0
    added: tuple = ()
    ttl: float | None = None
    having_: tuple = ()
    sets: Any = None  # rollup, cube, a list of grouping sets, or (column, values) of a pivot

    def select(self, *items: str | Expr | Column) -> Query:
        return replace(self, selected=self.selected + items)

    def filter(self, condition: Expr | Column | str) -> Query:
        return replace(self, filters=(*self.filters, condition))

    where = filter

    def join(self, table: Any, on: str | list[str] | None = None, how: str = "inner") -> Query:
        if how not in HOWS:
            raise ValueError(f"how must be one of {sorted(HOWS)}")
        if (on is None) != (how == "cross"):
            raise ValueError("a cross join takes no keys, any other join some")
        return replace(self, joins=(*self.joins, (table, [on] if isinstance(on, str) else on, HOWS[how])))

    def group_by(self, *keys: str | Expr) -> Query:
        return replace(self, keys=(self.keys or ()) + keys)

    def rollup(self, *keys: str) -> Query:
        """Groups by all keys, by all but the last, and so on to none."""
        return replace(self, keys=keys, sets="rollup")

    def cube(self, *keys: str) -> Query:
        """Groups by every subset of the keys."""
        return replace(self, keys=keys, sets="cube")

    def grouping_sets(self, *sets: list[str] | tuple[str, ...]) -> Query:
        return replace(self, keys=tuple(dict.fromkeys(k for s in sets for k in s)), sets=[*sets])

    def pivot(self, column: str, values: list) -> Query:
        """The aggregates once for each of the values of ``column``, as columns; after ``group_by``."""
        return replace(self, sets=(column, [*values]))

    # -- other tables, whole results

    def _of(self, df: DataFrame) -> Query:
        return Query(self.lake, None, lambda bounds: df)

    def _frame(self, other: Any) -> DataFrame:
        return other if isinstance(other, DataFrame) else other.dataframe() if isinstance(other, Query) else self.lake.table(other)

    def union(self, other: Any) -> Query:
        return self._of(self.dataframe().union(self._frame(other)).distinct())

    def union_all(self, other: Any) -> Query:
        return self._of(self.dataframe().unionAll(self._frame(other)))

    def intersect(self, other: Any) -> Query:
        return self._of(self.dataframe().intersect(self._frame(other)))

    def except_(self, other: Any, every: bool = False) -> Query:
        """Rows that the other hasn't: each once, or (``every``) as often as here less as often as there."""
        df, right = self.dataframe(), self._frame(other)
        return self._of(df.exceptAll(right) if every else df.subtract(right))

    def sample(self, fraction: float, seed: int = 0) -> Query:
        return self._of(self.dataframe().sample(fraction, seed))

    def range_join(self, table: Any, condition: Expr | Column, how: str = "inner") -> Query:
        """Join on any condition, such as a value between two columns of the other."""
        left, right = self.dataframe(), self._frame(table)
        return self._of(left.join(collision_free(left, right, []), named(condition), HOWS[how]))

    def asof_join(self, table: Any, time: str, by: str | list[str] = (), direction: str = "backward") -> Query:
        """Beside each row, the columns of the other's row of the same ``by`` that is last at or before its ``time`` (``forward``: first at or after).

        One pass over the union of both, ordered by time within ``by``; rows of the other with one time stand for each
        other. Rows without a time or a key have no partner.
        """
        if direction not in ("backward", "forward"):
            raise ValueError("direction must be backward or forward")
        left, right, by = self.dataframe(), self._frame(table), [by] if isinstance(by, str) else [*by]
        right = collision_free(left, right, [time, *by])
        own, other = [c for c in left.columns if c not in (time, *by)], [c for c in right.columns if c not in (time, *by)]
        sides = [left.select(time, *by, F.lit(1).alias("side_"), F.struct(*own).alias("row_") if own else F.struct(F.lit(1).alias("one_")).alias("row_"), F.lit(None).cast(right.select(F.struct(*other).alias("r")).schema["r"].dataType).alias("met_"))]
        sides.append(right.where(F.col(time).isNotNull()).select(time, *by, F.lit(0 if direction == "backward" else 2).alias("side_"), F.lit(None).cast(sides[0].schema["row_"].dataType).alias("row_"), F.struct(*other).alias("met_")))
        order = Window.partitionBy(*by).orderBy(F.col(time), "side_")
        near = F.last("met_", True).over(order.rowsBetween(Window.unboundedPreceding, 0)) if direction == "backward" else F.first("met_", True).over(order.rowsBetween(0, Window.unboundedFollowing))
        none = F.col(time).isNull()
        for k in by:
            none = none | F.col(k).isNull()
        made = sides[0].unionAll(sides[1]).withColumn("near_", F.when(~none, near)).where("side_ = 1")
        return self._of(made.select(*[F.col(f"row_.{c}") if c in own else F.col(c) for c in left.columns], *[F.col(f"near_.{c}") for c in other]))

    def having(self, condition: Expr | Column) -> Query:
        return replace(self, having_=(*self.having_, condition))

    def order_by(self, *keys: str | Expr) -> Query:
        return replace(self, order=self.order + keys)

    def limit(self, n: int) -> Query:
        return replace(self, n=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def with_column(self, name: str, value: Any) -> Query:
        return replace(self, added=(*self.added, (name, value)))

    def cache(self, ttl: float | None = None) -> Query:
        """Keep the result for ``ttl`` seconds; None keeps it until the table changes."""
        return replace(self, ttl=float("inf") if ttl is None else ttl)

    def dataframe(self) -> DataFrame:
        replaced = {name for name, _ in self.added}
        bounds = tuple(b for f in self.filters if isinstance(f, Expr) for b in f.bounds if b[0] not in replaced) if not any(h in ("right", "full") for _, _, h in self.joins) else ()
        df = self.source(bounds)
        for table, on, how in self.joins:
            right = self._frame(table)
            right = collision_free(df, right, on or []) if how not in ("left_semi", "left_anti") else right
            df = df.crossJoin(right) if how == "cross" else df.join(right, on=on, how=how)
        for name, value in self.added:
            df = df.withColumn(name, value.column if isinstance(value, Expr) else value if isinstance(value, Column) else F.lit(value))
        for f in self.filters:
            df = df.where(F.expr(f) if isinstance(f, str) else f.column if isinstance(f, Expr) else f)
        columns = [named(x) for x in self.selected]
        if self.keys is not None:
            if not self.selected:
                raise ValueError("group_by needs select")
            df = self._grouped(df, columns)
            for h in self.having_:
                df = df.where(named(h))
            if self.order:
                df = df.orderBy(*[named(k) for k in self.order])
        else:
            if self.order:
                df = df.orderBy(*[named(k) for k in self.order])
            if columns:
                sums = [isinstance(x, Expr) and x.aggregate for x in self.selected]
                if all(sums):
                    df = aggregated(df, columns, sums)
                elif any(sums):  # aggregated once; the one row goes to all
                    every = aggregated(df, [c for c, s in zip(columns, sums, strict=True) if s], [s for s in sums if s])
                    names = iter(every.columns)
                    one = every.toDF(*[f"all_{i}_" for i in range(len(every.columns))])
                    places = iter(one.columns)
                    df = df.crossJoin(F.broadcast(one)).select(*[F.col(next(places)).alias(next(names)) if s else c for c, s in zip(columns, sums, strict=True)])
                else:
                    df = df.select(*columns)
        if self.skip:
            df = df.offset(self.skip)
        return df if self.n is None else df.limit(self.n)

    def _grouped(self, df: DataFrame, columns: list[Column]) -> DataFrame:
        keys = [named(k) for k in self.keys]
        names = df.select(*keys).columns
        out, aggregates, kinds = [], [], []
        for x, c in zip(self.selected, columns, strict=True):
            if isinstance(x, Column) or (isinstance(x, Expr) and x.aggregate):
                aggregates.append(c)
                kinds.append(x.aggregate if isinstance(x, Expr) else True)
                out.append(None)
                continue
            name = df.select(c).columns[0]
            if name not in names:
                aggregates.append(F.collect_list(c).alias(name))
                kinds.append(True)
            out.append(name)
        if isinstance(self.sets, tuple):
            return df.groupBy(*keys).pivot(*self.sets).agg(*aggregates)
        if not aggregates and self.sets is None:
            return df.select(*keys).distinct().select(*out)
        if isinstance(self.sets, list):
            made = df.groupingSets([[named(k) for k in s] for s in self.sets], *keys).agg(*aggregates)
        elif self.sets:
            made = getattr(df, self.sets)(*keys).agg(*aggregates)
        else:
            made = aggregated(df, aggregates, kinds, keys)
        known = {*names, *(n for n in out if n)}
        rest = iter(n for n in made.columns[len(keys) :] if n not in known)
        return made.select(*[n or next(rest) for n in out])

    def execute(self) -> DataFrame:
        df = self.dataframe()
        return df if self.ttl is None else self.lake.results.get(df, self.tables(), self.ttl)

    def tables(self) -> set[str]:
        return {t for t in [self.table, *(t for t, _, _ in self.joins)] if isinstance(t, str)}

    def explain(self, mode: str = "formatted") -> None:
        self.dataframe().explain(mode)

    # -- changes of the table, by the query's filters

    def _condition(self) -> Expr:
        if not self.filters:
            raise ValueError("a filter is needed")
        made = None
        for f in self.filters:
            own = f if isinstance(f, Expr) else Expr(F.expr(f) if isinstance(f, str) else f)
            made = own if made is None else made & own
        return made

    def insert(self, data: Any) -> None:
        self.lake.append(self.table, data)

    def delete(self) -> int:
        return self.lake.delete(self.table, self._condition())

    def update(self, values: dict[str, Any]) -> int:
        return self.lake.update(self.table, self._condition(), values)

    def merge(self, source: Any, on: str | list[str], when_matched_update: Any = None, when_not_matched_insert: Any = None) -> dict:
        return self.lake.merge(self.table, source, on, when_matched_update, when_not_matched_insert)

