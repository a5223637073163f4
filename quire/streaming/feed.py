"""Change feeds as streams: indexes and aggregates kept up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quire.common import cut
from quire.operators import index as ix
from quire.operators import storage as st
from quire.operators.aggregate_by import apply_deltas
from quire.operators.aggregates import Spec

#: Batches of a table from which on all its rows are written together.
LAYERS = 16


def revisions(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """The revision log as a stream of the files that are added to `path`."""
    reader = spark.readStream.schema(st.SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def observe(stream: DataFrame, observer: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Gives every micro-batch of revisions to the observer. The checkpoint knows what was seen, so a restart goes on from
    there; a failure shows in the query's exception."""
    writer = stream.writeStream.foreachBatch(observer).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="1 second").start()


class Versions:
    """A table kept by micro-batches, one folder each: rows that come, and keys that go (columns `keys`), which hide rows of earlier
    batches. Every LAYERS batches a folder holds all rows instead. A batch that is run again replaces its own folder only."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str] | None = None):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys or ["doc_id"]
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs, self._path = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}/_SUCCESS"))

    def _layers(self, before: int | None) -> list[tuple[int, bool]]:
        """(batch, whether it holds all rows) of the complete batches from the last whole one on."""
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        numbers = sorted(int(f.getPath().getName()[2:]) for f in self._fs.listStatus(root) if f.getPath().getName().startswith("v="))
        out = []
        for n in reversed([n for n in numbers if before is None or n < before]):
            if self._there(f"v={n}/all"):
                out.append((n, True))
                break
            if self._there(f"v={n}/come"):
                out.append((n, False))
        return out[::-1]

    def read(self, before: int | None = None) -> DataFrame:
        """The rows after the last complete batch, or after the last before a batch."""
        layers = self._layers(before)
        if not layers:
            return self.spark.createDataFrame([], self.schema)
        rows = [self.spark.read.schema(self.schema).parquet(f"{self.root}/v={n}/{'all' if whole else 'come'}").withColumn("_at", F.lit(n)) for n, whole in layers]
        out = reduce(DataFrame.unionByName, rows)
        later = [n for n, whole in layers if not whole]
        if not later:
            return out.drop("_at")
        types = dict(self.spark.createDataFrame([], self.schema).dtypes)
        keys = ", ".join(f"`{k}` {types[k]}" for k in self.keys)
        gone = reduce(DataFrame.unionByName, [self.spark.read.schema(keys).parquet(f"{self.root}/v={n}/gone").withColumn("_until", F.lit(n)) for n in later])
        hidden = gone.groupBy(*self.keys).agg(F.max("_until").alias("_until"))
        same = reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys])
        return out.alias("a").join(hidden.alias("b"), same & (F.col("a._at") < F.col("b._until")), "left_anti").drop("_at")

    def change(self, come: DataFrame, gone: DataFrame, batch: int) -> None:
        """What a batch changes; the keys that go are complete before the rows that come, which make the batch count."""
        self._fs.delete(self._path(f"{self.root}/v={batch}"), True)
        gone.select(*self.keys).distinct().write.parquet(f"{self.root}/v={batch}/gone")
        come.write.parquet(f"{self.root}/v={batch}/come")
        if len(self._layers(None)) > LAYERS:
            self.read().write.mode("overwrite").parquet(f"{self.root}/v={batch}/all")


def maintain_index(spark: SparkSession, log: str, table: Versions, fn: ix.IndexFunction, checkpoint: str, *, kind: str = ix.MULTI) -> StreamingQuery:
    """Keeps an index over the log at `log` up to date. `table` is keyed by `doc_id`, of an index with unchecked unique keys by
    these."""

    def step(batch: DataFrame, n: int) -> None:
        feed = st.change_feed(spark.read.schema(st.SCHEMA).parquet(log), batch)
        come, gone, _ = ix.delta(table.read(n), feed, fn, kind)
        table.change(come, gone, n)

    return observe(revisions(spark, log), step, checkpoint)


def deltas(feed: DataFrame, fn: ix.IndexFunction) -> DataFrame:
    """Rows of an index function that changes exclude (sign -1) and include (sign 1)."""
    old = feed.where("old_doc is not null").select(F.col("old_doc_id").alias("id"), F.col("old_old_doc_id").alias("previous_id"), F.col("old_doc").alias("document"), F.lit("erase").alias("op"))
    new = feed.where("not deleted").select(F.col("new_doc_id").alias("id"), F.col("old_doc_id").alias("previous_id"), F.col("new_doc").alias("document"), F.lit("put").alias("op"))
    old, new = fn.rows(old).withColumn("sign", F.lit(-1)), fn.rows(new).withColumn("sign", F.lit(1))
    return old.unionByName(new)


def maintain_aggregate(spark: SparkSession, log: str, table: Versions, fn: ix.IndexFunction, group: list[str], specs: list[Spec], checkpoint: str) -> StreamingQuery:
    """Keeps an aggregate by deltas over the log at `log`, without an index. `table` is keyed by `group`; only groups that a batch
    touches are written."""

    def step(batch: DataFrame, n: int) -> None:
        changes = cut(deltas(st.change_feed(spark.read.schema(st.SCHEMA).parquet(log), batch), fn))
        touched = changes.select(*group).distinct()
        old = table.read(n).alias("o").join(touched.alias("t"), reduce(and_, [F.col(f"o.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group]), "left_semi")
        table.change(apply_deltas(old, changes, group, specs), touched, n)

    return observe(revisions(spark, log), step, checkpoint)
