"""Aggregate functions as column builders, with the deltas that include and exclude a document."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from types import ModuleType

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Aggregate:
    """`value(column, order)` is the aggregate as an expression; `order` is a struct that orders the rows of the group."""

    #: whether the value of a group follows from old value and change alone
    delta = False

    def value(self, c: Column, order: Column) -> Column:
        raise NotImplementedError

    def included(self, c: Column, sign: Column) -> Column | None:
        """Aggregate of the changes alone (`sign` 1: included, -1: excluded); None if the aggregate cannot be kept by deltas."""
        return None

    def merged(self, old: Column, change: Column) -> Column:
        """Value after the change; both may be null."""
        return F.when(old.isNull() & change.isNull(), None).otherwise(F.coalesce(old, F.lit(0)) + F.coalesce(change, F.lit(0)))

    def definition(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={_text(v)}' for k, v in sorted(vars(self).items()))})"


def _code(c: object) -> str:
    consts = [_code(x) if hasattr(x, "co_code") else repr(x) for x in c.co_consts]
    return f"{c.co_code.hex()}{consts}{c.co_names}{c.co_varnames}{c.co_freevars}"


def _text(v: object, depth: int = 8) -> str:
    """Definition of a value as text; of a function its code, defaults and the values it captured or finds in its module."""
    if isinstance(v, Aggregate):
        return v.definition()
    if isinstance(v, partial):
        return f"partial({_text(v.func, depth)}, {v.args!r}, {sorted(v.keywords.items())!r})"
    code = getattr(v, "__code__", None)
    if code is None or depth == 0:
        return f"{v.__module__}.{v.__qualname__}" if hasattr(v, "__qualname__") else repr(v)
    held = [c.cell_contents for c in v.__closure__ or ()]
    used = {n: v.__globals__[n] for n in code.co_names if n in v.__globals__ and not isinstance(v.__globals__[n], ModuleType)}
    parts = [_code(code), *[_text(x, depth - 1) for x in (*(v.__defaults__ or ()), *held)], repr(v.__kwdefaults__), *[f"{n}={_text(x, depth - 1)}" for n, x in sorted(used.items())]]
    return f"{v.__qualname__}:{hashlib.sha256('|'.join(parts).encode()).hexdigest()[:16]}"


@dataclass
class Count(Aggregate):
    delta = True

    def value(self, c, order):
        return F.count(F.lit(1))

    def included(self, c, sign):
        return F.sum(sign)


@dataclass
class Sum(Aggregate):
    delta = True

    def value(self, c, order):
        return F.sum(c)

    def included(self, c, sign):
        return F.sum(c * sign)


@dataclass
class Sum2(Aggregate):
    """Sum of squares."""

    delta = True

    def value(self, c, order):
        return F.sum(c * c)

    def included(self, c, sign):
        return F.sum(c * c * sign)


@dataclass
class Avg(Aggregate):
    """Average; of integers cut towards zero if `integer`."""

    integer: bool = False

    def value(self, c, order):
        return F.avg(c).cast("bigint") if self.integer else F.avg(c)


@dataclass
class StdDev(Aggregate):
    """Population standard deviation, by central moments."""

    def value(self, c, order):
        return F.stddev_pop(c)


@dataclass
class Max(Aggregate):
    def value(self, c, order):
        return F.max(c)

    def included(self, c, sign):
        return self.value(F.when(sign > 0, c), F.col("doc_id"))

    def merged(self, old, change):
        return F.greatest(old, change)


@dataclass
class Min(Aggregate):
    def value(self, c, order):
        return F.min(c)

    def included(self, c, sign):
        return self.value(F.when(sign > 0, c), F.col("doc_id"))

    def merged(self, old, change):
        return F.least(old, change)


@dataclass
class First(Aggregate):
    """Value of the first row in key order."""

    def value(self, c, order):
        return F.min_by(c, order)

    def included(self, c, sign):
        return self.value(F.when(sign > 0, c), F.col("doc_id"))

    def merged(self, old, change):
        return F.coalesce(old, change)


@dataclass
class Last(Aggregate):
    def value(self, c, order):
        return F.max_by(c, order)

    def included(self, c, sign):
        return self.value(F.when(sign > 0, c), F.col("doc_id"))

    def merged(self, old, change):
        return F.coalesce(change, old)


@dataclass
class Skip(Aggregate):
    """The column takes part in nothing."""


@dataclass
class GroupConcat(Aggregate):
    """Texts joined in key order; the delimiter comes only after something, so leading empty texts leave no trace."""

    delimiter: str = ","

    def value(self, c, order):
        texts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("x")))), lambda s: s["x"])
        return F.aggregate(texts, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(self.delimiter), x)))


@dataclass
class Scale(Aggregate):
    by: float
    of: Aggregate

    def value(self, c, order):
        return self.of.value(c * F.lit(self.by), order)


@dataclass
class Offset(Aggregate):
    by: float
    of: Aggregate

    def value(self, c, order):
        return self.of.value(c + F.lit(self.by), order)


@dataclass
class Invert(Aggregate):
    """Aggregate of `by` minus the value."""

    by: float
    of: Aggregate

    def value(self, c, order):
        return self.of.value(F.lit(self.by) - c, order)


@dataclass
class Transform(Aggregate):
    fn: Callable[[Column], Column]
    of: Aggregate

    def value(self, c, order):
        return self.of.value(self.fn(c), order)


@dataclass
class Convert(Aggregate):
    """Aggregate of the value cast to a type."""

    to: str
    of: Aggregate

    def value(self, c, order):
        return self.of.value(c.cast(self.to), order)


@dataclass
class Incremental(Aggregate):
    """User aggregate that includes and excludes: `full` aggregates a column; `change` aggregates (column, sign) of the changes
    alone; `merge` joins the value so far and the change (either may be null)."""

    full: Callable[[Column], Column]
    change: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column], Column]
    delta = True

    def value(self, c, order):
        return self.full(c)

    def included(self, c, sign):
        return self.change(c, sign)

    def merged(self, old, change):
        return self.merge(old, change)


@dataclass
class Custom(Aggregate):
    """User aggregate: a function from the values of a group, an array in key order, to a column. The array of a group is held by
    one task, so for groups without a bound Incremental or Pandas is the better choice."""

    fn: Callable[[Column], Column]

    def value(self, c, order):
        return self.fn(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("x")))), lambda s: s["x"]))


@dataclass
class Pandas(Aggregate):
    """User aggregate as a function from a pandas series to one value of the type `kind`; the order of its rows is open."""

    fn: Callable
    kind: str

    def value(self, c, order):
        fn = self.fn

        def run(x: pd.Series) -> float:
            return fn(x)

        return F.pandas_udf(run, self.kind)(c)


#: (result column, input column or expression, aggregate)
Spec = tuple[str, str | Column, Aggregate]


def composite(column: str, **parts: Aggregate) -> list[Spec]:
    """Several aggregates of one column."""
    return [(name, column, a) for name, a in parts.items()]


def aggregate_rows(columns: list[str], aggregates: list[Aggregate]) -> list[Spec]:
    """One aggregate per column, in order; skipped columns leave no result. Results are named as the columns."""
    return [(c, c, a) for c, a in zip(columns, aggregates, strict=True) if not isinstance(a, Skip)]


def expressions(specs: list[Spec], order: Column) -> list[Column]:
    return [a.value(F.col(c) if isinstance(c, str) else c, order).alias(name) for name, c, a in specs if not isinstance(a, Skip)]


def revision(specs: list[Spec], keys: list[str]) -> str:
    """Hash of the definition; a materialized aggregate of another revision is rebuilt."""
    text = repr(keys) + ";".join(f"{n}<-{c}:{a.definition()}" for n, c, a in specs)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def grouped(df: DataFrame, keys: list, specs: list[Spec], order: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*expressions(specs, order)) if keys else df.agg(*expressions(specs, order))
