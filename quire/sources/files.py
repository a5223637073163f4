"""Raw files read in splits by many tasks: delimited records, whose ends the parity of quotes finds, and ranges of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.common import cut

#: Bytes of a file that one task reads.
SPLIT_BYTES = 32 << 20
#: Bytes read at once.
CHUNK = 4 << 20
#: Rows of a batch that is passed on.
BATCH_ROWS = 20_000


def opened(path: str) -> pa.NativeFile:
    """A file to be read at any place; executors open it by themselves, so the store must be one that they reach."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(`path`, `length`) of the files at `path`, a file, folder or pattern; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def splits(files: DataFrame, size: int = SPLIT_BYTES) -> DataFrame:
    """(`path`, `offset`, `size`) of the splits of `files` (`path`, `length`)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    return files.where("length > 0").select("path", "length", starts.alias("offset")).select("path", "offset", F.least(F.lit(size).cast("long"), F.col("length") - F.col("offset")).alias("size"))


def _chunks(f: pa.NativeFile, start: int, stop: int) -> Iterator[np.ndarray]:
    f.seek(start)
    while start < stop:
        data = f.read(min(CHUNK, stop - start))
        if not data:
            return
        start += len(data)
        yield np.frombuffer(data, np.uint8)


def _parity(quote: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odd = []
            for path, offset, size in zip(batch["path"], batch["offset"], batch["size"], strict=True):
                with opened(path) as f:
                    odd.append(sum(int((c == quote).sum()) for c in _chunks(f, offset, offset + size)) & 1)
            yield batch.assign(odd=odd)

    return run


def records_of_split(f: pa.NativeFile, offset: int, size: int, inside: bool, quote: int = 34) -> Iterator[tuple[int, bytes]]:
    """(place, record) of the records that begin in a split; `inside`: whether it begins within quotes.

    A record ends at a line break outside quotes, which does not belong to it; the last one is read on beyond the split."""
    length, stop = f.size(), offset + size
    begin: int | None = 0 if offset == 0 else None
    if offset and not inside:
        f.seek(offset - 1)
        if f.read(1) == b"\n":
            begin = offset
    held, at = bytearray(), offset
    for data in _chunks(f, offset, length):
        marks = data == quote
        within = (np.cumsum(marks) + inside) & 1
        inside = bool(within[-1])
        text = data.tobytes()
        last = 0
        for end in np.flatnonzero((data == 10) & (within == 0)).tolist():
            if begin is not None:
                yield begin, bytes(held) + text[last:end]
            held.clear()
            last, begin = end + 1, at + end + 1
            if begin >= stop:
                return
        if begin is not None:
            held += text[last:]
        elif at + len(data) >= stop:
            return  # no record begins in this split
        at += len(data)
    if begin is not None and held:
        yield begin, bytes(held)


def read_records(spark: SparkSession, path: str, *, sep: str = ",", quote: str = '"', split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(`file`, `at`, `raw_line`, `sep_char`) of the records of delimited files; `at` is the byte a record begins at.

    Files are read twice, in splits: first the quotes of every split are counted, which tells by the parity of all before it
    whether a split begins within quotes; then every task finds the ends of its records. Empty lines are left out; a
    carriage return before the line break does not belong to the record. A quote that is never closed takes in what follows
    up to the next one, whatever the splits. Bytes that are no UTF-8 are replaced.
    """
    mark = ord(quote)
    parts = splits(listed(spark, path), split_bytes)
    n = max(1, spark.sparkContext.defaultParallelism)
    counted = cut(parts.repartition(n, "path", "offset").mapInPandas(_parity(mark), "path string, offset long, size long, odd int"))
    # one short row per split; the splits of one file are numbers that a task can hold
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, offset, size, inside in zip(batch["path"], batch["offset"], batch["size"], batch["inside"], strict=True):
                rows = []
                with opened(path) as f:
                    for at, raw in records_of_split(f, offset, size, bool(inside), mark):
                        raw = raw.removesuffix(b"\r")
                        if raw:
                            rows.append((path, at, raw.decode("utf-8", "replace"), sep))
                        if len(rows) >= BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=["file", "at", "raw_line", "sep_char"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "at", "raw_line", "sep_char"])

    return placed.select("path", "offset", "size", "inside").repartition(n, "path", "offset").mapInPandas(run, "file string, at long, raw_line string, sep_char string")
