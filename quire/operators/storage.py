"""The versioned document log: revisions (id, previous_id, deleted, has_value, document) and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.common import cut, parallelism
from quire.errors import ReferencedDocumentNotFound

SCHEMA = "id long, previous_id long, deleted boolean, has_value boolean, document string"


def select_all(rev: DataFrame, *, backward: bool = False) -> DataFrame:
    return rev.orderBy(F.desc("id") if backward else F.col("id"))


def select_from(rev: DataFrame, start: int, *, backward: bool = False) -> DataFrame:
    return select_all(rev.where(F.col("id") <= start if backward else F.col("id") >= start), backward=backward)


def select_range(rev: DataFrame, start: int, end: int, *, included: bool = False) -> DataFrame:
    """From `start` to `end`, descending if `start` is the larger; `end` itself only if `included`."""
    c, down = F.col("id"), start > end
    low, high = (c <= start, c >= end if included else c > end) if down else (c >= start, c <= end if included else c < end)
    return select_all(rev.where(low & high), backward=down)


def find(rev: DataFrame, doc_id: int) -> DataFrame:
    """The record with this id, as a table of at most one row."""
    return rev.where(F.col("id") == doc_id).limit(1)


def get(rev: DataFrame, doc_id: int) -> DataFrame:
    """The document with this id; none if the record has no value."""
    return rev.where((F.col("id") == doc_id) & F.col("has_value")).select("document").limit(1)


def last_id(rev: DataFrame) -> DataFrame:
    """(`last_id`): the highest id, 0 of an empty log."""
    return rev.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def dense_ids(df: DataFrame, first: int, order: list[Column]) -> DataFrame:
    """`df` with `id`, dense from `first` on in `order`. Rows are range partitioned, counted per partition and numbered inside
    each, so no task sees all of them."""
    parts = max(2, parallelism(df.sparkSession))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    counts = {r._part: r.n for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    base, at = {}, first
    for p in sorted(counts):
        base[p], at = at, at + counts[p]
    if not base:
        return placed.select(F.lit(None).cast("long").alias("id"), *df.columns)
    offset = F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))])
    local = F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33)
    return placed.select((offset[F.col("_part")] + local).cast("long").alias("id"), *df.columns)


def new_revisions(docs: DataFrame, first_id: int, order: list[Column] | None = None) -> DataFrame:
    """`docs` (document, previous_id) as revisions with ids from `first_id` on."""
    new = dense_ids(docs.select(F.coalesce("previous_id", F.lit(0)).cast("long").alias("previous_id"), "document"), first_id, order or [F.col("previous_id"), F.col("document")])
    return new.select("id", "previous_id", F.lit(False).alias("deleted"), F.lit(True).alias("has_value"), "document")


def new_tombstones(ids: DataFrame, first_id: int) -> DataFrame:
    """Tombstones for the documents `ids` (id), with ids from `first_id` on."""
    new = dense_ids(ids.select(F.col("id").alias("previous_id")), first_id, [F.col("previous_id")])
    return new.select("id", "previous_id", F.lit(True).alias("deleted"), F.lit(False).alias("has_value"), F.lit(None).cast("string").alias("document"))


def put(rev: DataFrame, docs: DataFrame, first_id: int, *, order: list[Column] | None = None, check: bool = True) -> DataFrame:
    """`docs` (document, previous_id) as new revisions with ids from `first_id` on; ReferencedDocumentNotFound if a named
    predecessor is neither in `rev` nor among the new ones."""
    new = new_revisions(docs, first_id, order)
    return checked(rev, new) if check else new


def erase(rev: DataFrame, ids: DataFrame, first_id: int, *, check: bool = True) -> DataFrame:
    """Tombstones for the documents `ids` (id)."""
    new = new_tombstones(ids, first_id)
    return checked(rev, new) if check else new


def check_known(rev: DataFrame, new: DataFrame) -> None:
    """ReferencedDocumentNotFound if `new` names a predecessor that is neither in `rev` nor among the new ones."""
    known = rev.select(F.col("id").alias("previous_id")).unionByName(new.select(F.col("id").alias("previous_id")))
    missing = new.where("previous_id <> 0").join(known, "previous_id", "left_anti").limit(5).collect()
    if missing:
        raise ReferencedDocumentNotFound([r.previous_id for r in missing])


def checked(rev: DataFrame, new: DataFrame) -> DataFrame:
    """`new` if every predecessor it names is known."""
    new = cut(new)
    check_known(rev, new)
    return new


def purge(rev: DataFrame, ids: DataFrame) -> DataFrame:
    """The log without the records `ids` (id)."""
    return rev.join(ids, "id", "left_anti")


def current(rev: DataFrame) -> DataFrame:
    """Documents that no later revision replaced or deleted."""
    replaced = rev.where("previous_id <> 0").select(F.col("previous_id").alias("id")).distinct()
    return rev.where("not deleted").join(replaced, "id", "left_anti")


def levels(rev: DataFrame, n: int) -> DataFrame:
    """`rev` with `level`: 0 for a record nothing follows, one more for its predecessor, up to `n`; null beyond."""
    replaced = rev.where("previous_id <> 0").select(F.col("previous_id").alias("id")).distinct()
    out = rev.join(replaced, "id", "left_anti").select("id", "previous_id", F.lit(0).alias("level"))
    front = out
    for i in range(1, n + 1):
        step = front.where("previous_id <> 0").select(F.col("previous_id").alias("id")).distinct()
        front = rev.select("id", "previous_id").join(step, "id", "left_semi").withColumn("level", F.lit(i))
        if i < n:
            front = cut(front)  # else each further level would compute all levels above it again
        out = out.unionByName(front)
    deepest = out.groupBy("id").agg(F.max("level").alias("level"))
    return rev.join(deepest, "id", "left")


def compact(rev: DataFrame, n: int = 0, *, deleted: bool = False) -> DataFrame:
    """The log with at most `n` older versions of every document; with `deleted` also tombstones and what led to them go, but
    never the newest record of the log."""
    kept = levels(rev, n).where("level is not null").drop("level")
    if not deleted:
        return kept
    newest = kept.agg(F.max("id").alias("newest"))
    dead = kept.join(F.broadcast(newest), F.col("id") < F.col("newest")).where("deleted").select("id", "previous_id")
    gone, front = dead.select("id"), dead
    for _ in range(n):
        step = front.where("previous_id <> 0").select(F.col("previous_id").alias("id")).distinct()
        front = kept.select("id", "previous_id").join(step, "id", "left_semi")
        gone = gone.unionByName(front.select("id"))
    return kept.join(gone.distinct(), "id", "left_anti")


def change_feed(rev: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """One row per revision of `new` (default: all): what it changed, with the replaced document (outer: null if it is gone)."""
    new = rev if new is None else new
    old = rev.select(F.col("id").alias("old_doc_id"), F.col("document").alias("old_doc"), F.col("previous_id").alias("old_old_doc_id"))
    rows = new.select(F.col("id").alias("new_doc_id"), F.col("previous_id").alias("old_doc_id"), "deleted", F.col("document").alias("new_doc"))
    return rows.join(old, "old_doc_id", "left").select("new_doc_id", "old_doc_id", F.coalesce("old_old_doc_id", F.lit(0)).alias("old_old_doc_id"), "deleted", "new_doc", "old_doc")


def export(rev: DataFrame, path: str, next_id: int) -> str:
    """Writes a backup beside `path`, named with the next id; returns its name."""
    where = f"{path}_{next_id}"
    rev.write.parquet(where)
    return where


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def restore(rev: DataFrame, backup: DataFrame) -> DataFrame:
    """Records of `backup` whose ids the log lacks."""
    return backup.join(rev.select("id"), "id", "left_anti")


def dangling(index: DataFrame, rev: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Index rows whose document is not stored."""
    return index.join(rev.select(F.col("id").alias(id_col)), id_col, "left_anti")
