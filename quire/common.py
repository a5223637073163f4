"""Helpers shared by all operators: the shared folder, lineage cuts, skew-safe lookups."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hot-key list never has more entries than this, so broadcasting it is safe at any size of input.
HOT_KEYS = 512
#: Keys with fewer rows than this are left to the ordinary shuffle.
HOT_ROWS = 50_000
#: Bytes of an Arrow batch that are worked on at once.
SLICE_BYTES = 8 << 20

#: Paths made in the shared folder, by application.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset (tests, local mode) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `sweep` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    if name != "package":
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Removes what operators of this application left in the shared folder, checkpoints too, and returns the number of folders.
    To be called when no result is needed any more that was not written elsewhere."""
    sc = spark.sparkContext
    path = spark._jvm.org.apache.hadoop.fs.Path
    held = sc._jsc.sc().getCheckpointDir()
    gone = _MADE.pop(sc.applicationId, [])
    if held.isDefined():
        folder = path(held.get())
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        gone += [f.getPath().toString() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    n = 0
    for name in gone:
        n += bool(path(name).getFileSystem(sc._jsc.hadoopConfiguration()).delete(path(name), True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder: later steps read it instead of computing it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As `cut`, as a Parquet table: columns that a later step does not use are not read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application; so it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    where = f"{scratch(spark, 'package')}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, False)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(where)
    _SHIPPED.add(sc.applicationId)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *, per_core: int = 2) -> DataFrame:
    """Deals rows out for a step heavy on CPU if the input has fewer partitions than there are cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(per_core * cores)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Non-empty batches in slices of about `most` bytes on average, so that memory does not follow the length of texts."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)


def skew_lookup(rows: DataFrame, key: str, table: DataFrame, *, counts: DataFrame, how: str = "left") -> DataFrame:
    """Joins `rows` to `table`, which has one row per `key`, however often one key occurs in `rows`.

    `counts` (`key`, `n`): rows per key, made by an aggregate with map-side combining. The HOT_KEYS most frequent
    keys with HOT_ROWS rows or more are looked up by a broadcast, so their rows are not shuffled; any key left has
    at most a HOT_KEYS-th of all rows and goes through the shuffled join. Where no key is that frequent, it is one join. Null
    keys match nothing; with how="left" they are kept.
    """
    found = counts.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key).collect()
    if not found:
        return rows.join(table, key, how)
    hot = rows.sparkSession.createDataFrame([r for r in found if r[0] is not None], counts.select(key).schema)
    hot_table = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    flagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    # a null key would gather in one partition of the shuffled left join: it goes the broadcast way too
    first = flagged.where(F.col("_hot") | F.col(key).isNull()).drop("_hot").join(hot_table, key, how)
    rest = flagged.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot").join(table, key, how)
    return rest.unionByName(first)
