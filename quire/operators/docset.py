"""Sets of document ids with values: AND, OR, XOR, NOT on a stack. A set may be inverted, then it is all ids but its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]


def keep_right(left: Column, right: Column) -> Column:
    return right


@dataclass(frozen=True)
class DocSet:
    """`df` (id, value, occ); `occ` numbers repeated ids, so sets are multisets: AND keeps the smaller number of an id, OR the
    larger."""

    df: DataFrame
    inverted: bool = False

    @staticmethod
    def of(df: DataFrame, id_col: str = "doc_id", value: str | Column | None = None, *, distinct: bool = False) -> DocSet:
        """From rows of a recordset. `distinct`: the ids are known to be distinct, so they need not be numbered."""
        v = F.lit(None).cast("string") if value is None else F.col(value) if isinstance(value, str) else value
        rows = df.select(F.col(id_col).alias("id"), v.alias("value"))
        occ = F.lit(1) if distinct else F.row_number().over(Window.partitionBy("id").orderBy("value"))
        return DocSet(rows.withColumn("occ", occ))

    def _join(self, other: DocSet, how: str, merge: Merge) -> DataFrame:
        b = other.df.select("id", "occ", F.col("value").alias("_right"), F.lit(True).alias("_b"))
        both = self.df.withColumn("_a", F.lit(True)).join(b, ["id", "occ"], how)
        left, right = F.col("value"), F.col("_right")
        v = F.when(F.col("_a").isNull(), right).when(F.col("_b").isNull(), left).otherwise(merge(left, right))
        return both.select("id", v.alias("value"), "occ", "_a", "_b")

    def minus(self, other: DocSet) -> DataFrame:
        return self.df.join(other.df.select("id", "occ"), ["id", "occ"], "left_anti")

    def __invert__(self) -> DocSet:
        return DocSet(self.df, not self.inverted)

    def and_(self, other: DocSet, merge: Merge = keep_right) -> DocSet:
        if self.inverted and other.inverted:
            return ~(~self).or_(~other, merge)
        if self.inverted:
            return DocSet(other.minus(~self))
        if other.inverted:
            return DocSet(self.minus(~other))
        return DocSet(self._join(other, "inner", merge).drop("_a", "_b"))

    def or_(self, other: DocSet, merge: Merge = keep_right) -> DocSet:
        if self.inverted and other.inverted:
            return ~(~self).and_(~other, merge)
        if self.inverted or other.inverted:
            return ~(~self).and_(~other, merge)
        return DocSet(self._join(other, "full_outer", merge).drop("_a", "_b"))

    def xor_(self, other: DocSet) -> DocSet:
        one = DocSet(self.df)._join(DocSet(other.df), "full_outer", keep_right)
        return DocSet(one.where(F.col("_a").isNull() | F.col("_b").isNull()).drop("_a", "_b"), self.inverted != other.inverted)

    def is_empty(self) -> bool:
        """An inverted set is never empty: ids are unbounded."""
        return not self.inverted and self.df.isEmpty()

    def all_items(self) -> DataFrame:
        """(id, value) in order of ids; of an inverted set there is no list."""
        if self.inverted:
            raise ValueError("an inverted set has no list of items")
        return self.df.orderBy("id", "occ").select("id", "value")

    def list(self, storage: DataFrame) -> DataFrame:
        """(id, value) with the documents of `storage` (outer); an inverted set gives no rows."""
        rows = self.df.where(F.lit(False)) if self.inverted else self.df
        return rows.drop("occ").join(storage, "id", "left")


class DocSetStack:
    """Sets in postfix notation: push operands, then the operator."""

    def __init__(self) -> None:
        self._stack: list[DocSet] = []

    def push(self, s: DocSet | DataFrame, id_col: str = "doc_id", value: str | Column | None = None) -> DocSetStack:
        self._stack.append(s if isinstance(s, DocSet) else DocSet.of(s, id_col, value))
        return self

    push_unsorted = push

    def _two(self, fn: Callable[[DocSet, DocSet], DocSet]) -> DocSetStack:
        b, a = self._stack.pop(), self._stack.pop()
        self._stack.append(fn(a, b))
        return self

    def AND(self, merge: Merge = keep_right) -> DocSetStack:  # noqa: N802
        return self._two(lambda a, b: a.and_(b, merge))

    def OR(self, merge: Merge = keep_right) -> DocSetStack:  # noqa: N802
        return self._two(lambda a, b: a.or_(b, merge))

    def XOR(self) -> DocSetStack:  # noqa: N802
        return self._two(lambda a, b: a.xor_(b))

    def NOT(self) -> DocSetStack:  # noqa: N802
        self._stack.append(~self._stack.pop())
        return self

    def pop(self) -> DocSet:
        return self._stack.pop()

    def top(self) -> DocSet:
        return self._stack[-1]

    def clear(self) -> None:
        self._stack.clear()

    def empty(self) -> bool:
        return not self._stack

    def is_top_empty(self) -> bool:
        return self.top().is_empty()

    def all_items(self) -> DataFrame:
        return self.top().all_items()

    def list(self, storage: DataFrame) -> DataFrame:
        return self.top().list(storage)
