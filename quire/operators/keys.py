"""Compound keys: prefix comparison, ranges that reach the Parquet scan, and key order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prefix:
    """As the last element of a key: strings that begin with `text`."""

    text: str


@dataclass(frozen=True)
class KeyColumn:
    """A column of a key and how it is ordered.

    order: 'plain'; 'array' (shorter arrays first, then element by element); 'variant' (a struct whose first field is the
    number of the alternative); or 'collate:<locale>' for the order of a language. Nulls always come first.
    """

    name: str
    order: str = "plain"

    def sort(self) -> list[Column]:
        c = F.col(self.name)
        if self.order == "array":
            return [F.size(c), c]
        if self.order.startswith("collate:"):
            return [F.collate(c, self.order.split(":", 1)[1])]
        return [c]


def key_columns(keys: list[str | KeyColumn]) -> list[KeyColumn]:
    return [k if isinstance(k, KeyColumn) else KeyColumn(k) for k in keys]


def order_by(keys: list[str | KeyColumn], *, reverse: bool = False, tie: str | None = None) -> list[Column]:
    """Sort columns for the order of keys, ties by `tie`."""
    cols = [c for k in key_columns(keys) for c in k.sort()] + ([F.col(tie)] if tie else [])
    return [c.desc_nulls_last() if reverse else c.asc_nulls_first() for c in cols]


def as_key(key: Any) -> tuple:
    return key if isinstance(key, tuple) else tuple(key) if isinstance(key, list) else (key,)


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def _equal(name: str, value: Any) -> Column:
    c = F.col(name)
    if isinstance(value, Prefix):
        return c.startswith(value.text)
    return c.isNull() if value is None else c == F.lit(value)


def _after(name: str, value: Any) -> Column:
    c = F.col(name)
    if isinstance(value, Prefix):
        # first in order that no longer begins with the text
        return (c > F.lit(value.text)) & ~c.startswith(value.text)
    return c.isNotNull() if value is None else c > F.lit(value)


def _before(name: str, value: Any) -> Column:
    c = F.col(name)
    if value is None:
        return F.lit(False)
    return (c < F.lit(value.text if isinstance(value, Prefix) else value)) | c.isNull()


def _names(keys: list[str | KeyColumn], key: Any) -> tuple[list[str], tuple]:
    key = as_key(key)
    names = [k.name for k in key_columns(keys)]
    if len(key) > len(names):
        raise ValueError("the key has more columns than the index")
    return names[: len(key)], key


def _expand(names: list[str], key: tuple, step: Any) -> Column:
    """OR of ANDs: a comparison of structs would not be pushed down to the scan."""
    parts = [_all([_equal(n, v) for n, v in zip(names[:i], key[:i], strict=True)] + [step(names[i], key[i])]) for i in range(len(key))]
    return reduce(or_, parts) if parts else F.lit(False)


def equal_to(keys: list[str | KeyColumn], key: Any) -> Column:
    """Rows whose leading key columns are `key`; () is every row."""
    names, key = _names(keys, key)
    return _all([_equal(n, v) for n, v in zip(names, key, strict=True)])


def greater_than(keys: list[str | KeyColumn], key: Any) -> Column:
    """Rows after all rows with prefix `key`."""
    names, key = _names(keys, key)
    return _expand(names, key, _after)


def less_than(keys: list[str | KeyColumn], key: Any) -> Column:
    """Rows before all rows with prefix `key`."""
    names, key = _names(keys, key)
    return _expand(names, key, _before)


def greater_equal(keys: list[str | KeyColumn], key: Any) -> Column:
    """Rows with prefix `key` and after."""
    return greater_than(keys, key) | equal_to(keys, key)


def less_equal(keys: list[str | KeyColumn], key: Any) -> Column:
    """Rows with prefix `key` and before."""
    return less_than(keys, key) | equal_to(keys, key)


def between(keys: list[str | KeyColumn], low: Any, high: Any, *, included: bool = False) -> Column:
    """From prefix `low` up to prefix `high`, whose rows belong to it only if `included`."""
    return greater_equal(keys, low) & (less_equal(keys, high) if included else less_than(keys, high))
