"""Secondary indexes: functions from a document to any number of (key, value) rows, of four types."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.errors import DuplicateKeyError
from quire.operators.view import View

MULTI, UNIQUE, UNIQUE_NO_CHECK, UNIQUE_HIDE_DUP = "multi", "unique", "unique_no_check", "unique_hide_dup"


@dataclass(frozen=True)
class IndexFunction:
    """`emit()` lists the rows a document emits: each a dict of key and value columns, or with "when", a condition without
    which it is not emitted. The columns it may use are `document`, `id`, `previous_id` (0: none) and `op` (put or erase).
    `revision` changes when the function does, so that the index is built anew."""

    keys: list[str]
    values: list[str]
    emit: Callable[[], list[dict[str, Column]]]
    revision: int = 1

    def rows(self, docs: DataFrame, *, id_col: str = "id", keep: list[str] = []) -> DataFrame:  # noqa: B006
        """(keys, values, doc_id) of all documents; built by one generator, without a Python function per row. Of equal keys of one
        document the last emitted stays."""
        names = [*self.keys, *self.values]
        emits = self.emit()
        parts = []
        for i, e in enumerate(emits):
            row = F.struct(*[e.get(n, F.lit(None)).alias(n) for n in names], F.lit(i).alias("_nth"))
            parts.append(F.when(e["when"], row) if "when" in e else row)
        if len(parts) == 1:
            flat = docs if "when" not in emits[0] else docs.where(emits[0]["when"])
            return flat.select(*[emits[0].get(n, F.lit(None)).alias(n) for n in names], F.col(id_col).alias("doc_id"), *keep)
        rows = docs.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("e"), F.col(id_col).alias("doc_id"), *keep)
        rows = rows.select("e.*", "doc_id", *keep)
        last = rows.groupBy(*self.keys, "doc_id", *keep).agg(F.max_by(F.struct(*self.values, "_nth"), "_nth").alias("_v")) if self.values else rows.drop("_nth").distinct()
        return last.select(*self.keys, *[F.col(f"_v.{v}").alias(v) for v in self.values], "doc_id", *keep)


@dataclass(frozen=True)
class PythonIndexFunction:
    """As IndexFunction, for what expressions cannot say: `fn` gets batches of documents as pandas frames and gives frames of
    rows (keys, values, doc_id) in `schema`. One call a batch, not one a document."""

    keys: list[str]
    values: list[str]
    fn: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    revision: int = 1

    def rows(self, docs: DataFrame, *, id_col: str = "id", keep: list[str] = []) -> DataFrame:  # noqa: B006
        fn = self.fn

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield fn(batch)

        return docs.withColumnRenamed(id_col, "id").mapInPandas(run, self.schema)


class NoStorage:
    """Feeds indexes without keeping documents: ids are counted on, and looking a document up finds nothing."""

    def __init__(self, functions: dict[str, IndexFunction], next_id: int = 1):
        self.functions, self.next_id = functions, next_id

    def put(self, docs: DataFrame, *, id_col: str = "id") -> dict[str, DataFrame]:
        """Rows that `docs`, which have ids, add to each index."""
        top = docs.agg(F.max(id_col)).first()[0]
        self.next_id = max(self.next_id, (top or 0) + 1)
        return {name: fn.rows(docs, id_col=id_col) for name, fn in self.functions.items()}

    def erase(self, indexes: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
        """Indexes without the rows of the documents `ids` (id)."""
        gone = ids.select(F.col("id").alias("doc_id"))
        return {name: rows.join(gone, "doc_id", "left_anti") for name, rows in indexes.items()}

    def get(self, doc_id: int) -> None:
        return None


def conflicts(rows: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Keys held by several documents; `touched`: only these keys are looked at."""
    if touched is not None:
        rows = rows.join(touched.select(*keys).distinct(), keys, "left_semi")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")


def last_writer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of the highest document id."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "doc_id").alias("_r"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def build(docs: DataFrame, fn: IndexFunction, kind: str = MULTI, *, id_col: str = "id") -> DataFrame:
    """Index over the current documents. A unique index raises DuplicateKeyError if a key has several documents."""
    rows = fn.rows(docs if "op" in docs.columns else docs.withColumn("op", F.lit("put")), id_col=id_col)
    if kind == UNIQUE:
        found = conflicts(rows, fn.keys).limit(5).collect()
        if found:
            raise DuplicateKeyError([tuple(r[k] for k in fn.keys) for r in found])
    return last_writer(rows, fn.keys) if kind == UNIQUE_NO_CHECK else rows


def delta(index: DataFrame, feed: DataFrame, fn: IndexFunction, kind: str = MULTI) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the changes of `feed` (new_doc_id, old_doc_id, deleted, new_doc) do to an index: rows that come, keys that go, and the
    rows that replaced documents had.

    Keys that go are document ids, or of an index with unchecked unique keys these keys, because there a row goes also when
    its key gets another document. Only keys that changed are checked for uniqueness."""
    gone = feed.where("old_doc_id <> 0").select(F.col("old_doc_id").alias("doc_id")).distinct()
    live = feed.where("not deleted").join(gone.withColumnRenamed("doc_id", "new_doc_id"), "new_doc_id", "left_anti")
    docs = live.select(F.col("new_doc_id").alias("id"), F.col("old_doc_id").alias("previous_id"), F.col("new_doc").alias("document"), F.lit("put").alias("op"))
    come = fn.rows(docs)
    dead = index.join(gone, "doc_id", "left_semi").select(*come.columns)
    if kind == UNIQUE:
        # two replacements of one document in one batch conflict as well
        both = feed.where("old_doc_id <> 0 and not deleted").groupBy("old_doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        out = index.join(gone, "doc_id", "left_anti").select(*come.columns).unionByName(come)
        found = conflicts(out, fn.keys, come).limit(5).collect()
        if both or found:
            raise DuplicateKeyError([tuple(r[k] for k in fn.keys) for r in found] or [r.old_doc_id for r in both])
    if kind == UNIQUE_NO_CHECK:
        touched = come.select(*fn.keys).distinct()
        kept = index.join(gone, "doc_id", "left_anti").join(touched, fn.keys, "left_semi").select(*come.columns)
        return last_writer(kept.unionByName(come), fn.keys), touched.unionByName(dead.select(*fn.keys)).distinct(), dead
    return come, gone, dead


def update(index: DataFrame, feed: DataFrame, fn: IndexFunction, kind: str = MULTI) -> DataFrame:
    """Index after the changes of `feed`: rows of replaced documents go, rows of new ones come."""
    come, gone, _ = delta(index, feed, fn, kind)
    return index.join(gone, gone.columns, "left_anti").select(*come.columns).unionByName(come)


def view(index: DataFrame, fn: IndexFunction, kind: str = MULTI, storage: DataFrame | None = None) -> View:
    v = View(index, fn.keys, "doc_id", storage=storage)
    return v.hide_duplicates() if kind == UNIQUE_HIDE_DUP else v
