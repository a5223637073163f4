"""A change feed applied to a checkpoint: upserts in an embedded database per bucket, published at once.

Every bucket of document ids is a DuckDB table in memory. A change is inserted, or on conflict updates the row if its
sequence is higher than the stored one; so repeated and late changes leave no trace, and deleted or purged documents stay
as tombstones that older changes cannot revive. The same upsert runs first where the rows are read, so a document with very
many changes reaches its bucket as a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.common import parallelism, scratch

#: Rows of changes per bucket on average; about 100 bytes each in memory.
BUCKET_ROWS = 1_000_000
#: Memory of the database of one task.
MEMORY = "700MB"
#: Documents the upsert before the shuffle holds before it passes them on.
COMBINE_ROWS = 400_000

STATE = "doc_id long, seq long, prev_id long, deleted boolean, purged boolean"
_CREATE = "CREATE TABLE state (doc_id BIGINT PRIMARY KEY, seq BIGINT, prev_id BIGINT, deleted BOOLEAN, purged BOOLEAN)"
_UPSERT = """
    INSERT INTO state
    SELECT doc_id, seq, prev_id, deleted, purged FROM changes
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC, purged DESC, deleted DESC, prev_id DESC) = 1
    ON CONFLICT (doc_id) DO UPDATE SET seq = excluded.seq, prev_id = excluded.prev_id, deleted = excluded.deleted, purged = excluded.purged
    WHERE excluded.seq > state.seq OR (excluded.seq = state.seq AND (excluded.purged, excluded.deleted, excluded.prev_id) > (state.purged, state.deleted, state.prev_id))"""


def _upserts(batches: Iterator[pa.RecordBatch], flush: int | None) -> Iterator[pa.RecordBatch]:
    import duckdb

    # no spill to a folder of the machine: a bucket is small enough for its share of memory, or fails
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.execute(_CREATE)
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        con.register("changes", pa.Table.from_batches([batch]))
        con.execute(_UPSERT)
        con.unregister("changes")
        held += batch.num_rows
        if flush and held >= flush:
            yield from con.sql("SELECT * FROM state").to_arrow_table().to_batches(max_chunksize=50_000)
            con.execute("DROP TABLE state")
            con.execute(_CREATE)
            held = 0
    yield from con.sql("SELECT * FROM state").to_arrow_table().to_batches(max_chunksize=50_000)
    con.close()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _upserts(batches, COMBINE_ROWS)


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _upserts(batches, None)


def _changes(df: DataFrame, doc_id: str, prev_id: str, deleted: str, seq: str, purge: bool) -> DataFrame:
    none = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    return df.select(
        none(doc_id).alias("doc_id"),
        F.coalesce(F.col(seq).cast("long"), F.lit(-1)).alias("seq"),
        none(prev_id).alias("prev_id"),
        F.coalesce(F.col(deleted), F.lit(False)).alias("deleted"),
        ((none(doc_id) == none(prev_id)) if purge else F.lit(False)).alias("purged"),
    ).where(F.col("doc_id") != 0)


def changes(base: DataFrame, feed: DataFrame) -> DataFrame:
    """Checkpoint and feed as rows of one form; rows that name no document (null or 0) are left out."""
    return _changes(base, "id", "previous_id", "deleted", "commit_seq", False).unionByName(_changes(feed, "new_doc_id", "old_doc_id", "deleted", "commit_seq", True))


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Makes `staged`, complete, visible as `target` in one rename; fails if `target` is there already."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(target)) or not fs.rename(path(staged), path(target)):
        raise RuntimeError(f"cannot publish {target}")


def apply_changes(base: DataFrame, feed: DataFrame, *, target: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The standing row of every document: `doc_id`, `seq`, `prev_id`, `deleted`, `purged`.

    That is the row with the highest `commit_seq` among checkpoint and feed; null sequences come before all others. Of
    different rows with the same sequence the purged one stands, then the deleted one, then the higher predecessor. Tombstones
    are rows like any other. All buckets are written beside `target` (default: a new path in the shared folder), which appears
    only when all are complete. Empty tables give no rows; repeated rows change nothing; other columns are not read.
    """
    spark = base.sparkSession
    target = target or scratch(spark, "state")
    buckets = max(parallelism(spark), -(-(base.count() + feed.count()) // bucket_rows))
    rows = changes(base, feed).mapInArrow(_combine, STATE).repartition(buckets, "doc_id").mapInArrow(_bucket, STATE)
    rows.write.parquet(f"{target}.staged")
    publish(spark, f"{target}.staged", target)
    return spark.read.schema(STATE).parquet(target)


def current(state: DataFrame, is_purged: Column | None = None) -> DataFrame:
    """Documents of `state` that are stored, not deleted, and that no stored document, deleted or not, has replaced."""
    kept = state.where(~(F.col("purged") if is_purged is None else is_purged))
    replaced = kept.where("prev_id <> 0").select(F.col("prev_id").alias("doc_id")).distinct()
    return kept.where(~F.col("deleted")).join(replaced, "doc_id", "left_anti")


def current_documents(base: DataFrame, feed: DataFrame, now: DataFrame) -> DataFrame:
    """`now` (`doc_id`, `seq`) with collection and content of the row that stands (`coll_name`, `document`).

    Of repeated deliveries with different contents the greatest is taken."""
    b = base.select(F.col("id").cast("long").alias("doc_id"), F.coalesce(F.col("commit_seq").cast("long"), F.lit(-1)).alias("seq"), "coll_name", "document")
    f = feed.select(F.col("new_doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("commit_seq").cast("long"), F.lit(-1)).alias("seq"), "coll_name", F.col("new_doc").alias("document"))
    content = b.unionByName(f).where("doc_id <> 0")
    # max_by of a struct keeps one row per document while rows are combined, before any shuffle of repeated deliveries
    latest = content.groupBy("doc_id", "seq").agg(F.max(F.struct("coll_name", "document")).alias("x"))
    return now.join(latest, ["doc_id", "seq"]).select("doc_id", "seq", "x.coll_name", "x.document")
