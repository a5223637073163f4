"""Structured (JSON) documents: parsing, printing, typed access and changes. Values are VARIANT or their JSON text."""

from __future__ import annotations

import json
import math
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.errors import JsonError


class Undefined:
    """Stands for a value that is not there, which differs from null."""

    def __repr__(self) -> str:
        return "[undefined]"

    def __bool__(self) -> bool:
        return False


UNDEFINED = Undefined()


def parse(c: Column) -> Column:
    """VARIANT of a JSON text; an error if it is none."""
    return F.parse_json(c)


def try_parse(c: Column) -> Column:
    return F.try_parse_json(c)


def text(v: Column) -> Column:
    """JSON text, keys in order."""
    return F.to_json(v)


def to_string(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit(repr(UNDEFINED)))


def as_type(v: Column, path: str, kind: str) -> Column:
    """Value at a path as a type; an error if it cannot be converted."""
    return F.variant_get(v, path, kind)


def get(v: Column, path: str, kind: str) -> Column:
    """Value at a path as a type; null if it is missing or cannot be converted."""
    return F.try_variant_get(v, path, kind)


def contains(v: Column, path: str, kind: str) -> Column:
    """Whether the value at a path is of a type."""
    return get(v, path, kind).isNotNull()


def defined(v: Column, path: str) -> Column:
    """Whether something is at a path, be it null."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def is_null(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.is_variant_null(F.try_variant_get(v, path, "variant")), F.lit(False))


def items(v: Column, kind: str = "variant") -> Column:
    """Elements of an array; none if it is something else."""
    return F.coalesce(F.try_variant_get(v, "$", f"array<{kind}>"), F.expr(f"cast(array() as array<{kind}>)"))


def pairs(v: Column, kind: str = "variant") -> Column:
    """Entries of an object as a map; none if it is something else."""
    return F.coalesce(F.try_variant_get(v, "$", f"map<string,{kind}>"), F.expr(f"cast(map() as map<string,{kind}>)"))


def equal(a: Column, b: Column) -> Column:
    """Deep equality, strict in types: 1 differs from 1.0."""
    return (F.to_json(a) == F.to_json(b)) & (F.schema_of_variant(a) == F.schema_of_variant(b))


# --- arrays and maps of columns


def at(a: Column, i: int) -> Column:
    """Element `i` from 0 on; null if there is none."""
    return F.try_element_at(a, F.lit(i + 1))


def at_or_fail(a: Column, i: int) -> Column:
    return F.element_at(a, i + 1)


def front(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def back(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def push_back(a: Column, v: Column) -> Column:
    return F.array_append(a, v)


def pop_back(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def set_item(a: Column, i: int, v: Column, fill: Column | None = None) -> Column:
    """Array with element `i` set; a shorter one is filled up before it."""
    fill = F.lit(None) if fill is None else fill
    padded = F.concat(a, F.array_repeat(fill, F.greatest(F.lit(i + 1) - F.size(a), F.lit(0))))
    return F.transform(padded, lambda x, n: F.when(n == i, v).otherwise(x))


def field(m: Column, name: str) -> Column:
    return F.try_element_at(m, F.lit(name))


def set_field(m: Column, name: str, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != name), F.create_map(F.lit(name), v))


def merge(m: Column, changes: Column) -> Column:
    """Map with the entries of `changes`; entries with null delete."""
    kept = F.map_filter(m, lambda k, _: ~F.map_contains_key(changes, k))
    return F.map_concat(kept, F.map_filter(changes, lambda _, v: v.isNotNull()))


# --- values in Python


def structured(values: Any) -> Any:
    """A list whose items are all [text, value] pairs becomes an object, any other an array without undefined items."""
    if isinstance(values, list | tuple):
        if values and all(isinstance(p, list | tuple) and len(p) == 2 and isinstance(p[0], str) for p in values):
            return {k: structured(v) for k, v in values if v is not UNDEFINED}
        return [structured(v) for v in values if v is not UNDEFINED]
    return values


def to_json(value: Any, *, ascii_only: bool = False, escape_slash: bool = False) -> str:
    """JSON text of a Python value; infinities are written as signs, NaN as null, times in ISO form."""

    def plain(v: Any) -> Any:
        if isinstance(v, float) and not math.isfinite(v):
            return None if math.isnan(v) else "∞" if v > 0 else "-∞"
        if isinstance(v, datetime):
            return v.isoformat()
        if isinstance(v, dict):
            return {k: plain(x) for k, x in sorted(v.items()) if x is not UNDEFINED}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v if x is not UNDEFINED]
        return v

    out = json.dumps(plain(value), ensure_ascii=ascii_only, separators=(",", ":"))
    return out.replace("/", "\\/") if escape_slash else out


def _no_twice(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise JsonError("dupkey")
    return out


def from_json(source: str) -> Any:
    """Value of a standard JSON text; JsonError with its `kind` if it is none."""
    try:
        return json.loads(source, object_pairs_hook=_no_twice)
    except json.JSONDecodeError as e:
        raise JsonError(_kind(e)) from None


def _kind(e: json.JSONDecodeError) -> str:
    rest, before = e.doc[e.pos :], e.doc[: e.pos].rstrip()
    if not rest.strip() or e.msg.startswith("Unterminated string"):
        return "eof"
    if e.msg.startswith("Invalid"):
        return "character"
    if before and e.pos == len(before) and before[-1].isdigit() and rest[0] in "0123456789.eE+-" or rest[0] in "-+.":
        return "number"
    if e.msg.startswith("Expecting property name") or "before end of object" in e.msg:
        return "key"
    if e.msg.startswith("Expecting ':'"):
        return "colon"
    if e.msg.startswith("Expecting ','"):
        return "comma"
    return "keyword" if rest[0] in "tfn" else "unknown"


def error_kind(text: str | None) -> str | None:
    """Kind of the error that keeps a text from being JSON; None if there is none."""
    try:
        if text is not None:
            from_json(text)
    except JsonError as e:
        return e.kind
    return None


def json_error(c: Column) -> Column:
    """`error_kind` of a column, in Arrow batches; meant for texts that `try_parse` refused."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(error_kind)

    return F.pandas_udf(run, "string")(c)
