"""Backups in the binary form [id: u64][size: u32][bytes], where bytes are [previous id: u64, big endian][document].

A backup is a file, or a folder of such files written by one task each. Its name ends with the next id of the storage.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.common import spread
from quire.operators.storage import SCHEMA
from quire.sources.files import CHUNK, SPLIT_BYTES, listed, opened

_COLUMNS = ["id", "previous_id", "deleted", "has_value", "document"]


def _walk(read, start: int, stop: int | None, order: str) -> Iterator[tuple[int, int, bytes]]:
    """(place, id, bytes) of the records from `start` on; `read` gives the next bytes, none at the end."""
    held, at = b"", start
    while stop is None or at < stop:
        while len(held) < 12 or len(held) < 12 + struct.unpack_from(f"{order}QI", held)[1]:
            more = read()
            if not more:
                if held:
                    raise ValueError("the backup ends within a " + ("header" if len(held) < 12 else "record"))
                return
            held += more
        # all whole records of what is held
        p = 0
        while len(held) - p >= 12:
            doc_id, size = struct.unpack_from(f"{order}QI", held, p)
            if size < 8:
                raise ValueError("the backup ends within a record")
            if len(held) - p < 12 + size or (stop is not None and at >= stop):
                break
            yield at, doc_id, held[p + 12 : p + 12 + size]
            p += 12 + size
            at += 12 + size
        held = held[p:]


def _record(doc_id: int, data: bytes) -> tuple[int, int, bool, bool, str | None]:
    (previous,) = struct.unpack_from(">Q", data)
    body = data[8:]
    return doc_id, previous, not body, bool(body), body.decode("utf-8", "replace") if body else None


def records(data: bytes, order: str = "<") -> Iterator[tuple[int, int, bool, bool, str | None]]:
    parts = iter([data])
    for _, doc_id, body in _walk(lambda: next(parts, b""), 0, None, order):
        yield _record(doc_id, body)


def encode(rows: list[tuple[int, int, str | None]], order: str = "<") -> bytes:
    out = bytearray()
    for doc_id, previous, text in rows:
        body = struct.pack(">Q", previous) + (text or "").encode()
        out += struct.pack(f"{order}QI", doc_id, len(body)) + body
    return bytes(out)


def write_binary(rev: DataFrame, path: str, next_id: int, *, start: int = 0, order: str = "<") -> str:
    """Writes the revisions from id `start` on as a binary backup and returns its name, `path`_`next_id`: a folder with a file per
    task, in which ids ascend. A file appears when it is whole; a task that is run again writes the same file again."""
    where = f"{path}_{next_id}"
    rows = rev.where(F.col("id") >= start).select("id", "previous_id", "document")
    parts = rev.sparkSession.sparkContext.defaultParallelism
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where.removeprefix("file:"))
        store.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        staged = f"{folder}/_{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(staged) as out:
            for batch in batches:
                texts = [t if isinstance(t, str) else None for t in batch["document"]]
                out.write(encode(list(zip(batch["id"].tolist(), batch["previous_id"].tolist(), texts, strict=True)), order))
                n += len(batch)
        store.move(staged, name)
        yield pd.DataFrame({"records": [n]})

    ordered.mapInPandas(run, "records long").agg(F.sum("records")).collect()
    return where


def read_binary(spark: SparkSession, path: str, *, order: str = "<", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Revisions of binary backups. Records have no marks between them, so one task per file runs through the headers and gives a
    place to begin at after every `split_bytes`; the splits are then read by as many tasks, piece by piece."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                rows, begin = [], 0
                with opened(path) as f:
                    for at, _, _ in _walk(lambda f=f: f.read(CHUNK), 0, None, order):
                        if at - begin >= split_bytes:
                            rows.append((path, begin, at))
                            begin = at
                if length:
                    rows.append((path, begin, length))
                yield pd.DataFrame(rows, columns=["path", "begin", "end"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, begin, end in zip(batch["path"], batch["begin"], batch["end"], strict=True):
                rows = []
                with opened(path) as f:
                    f.seek(begin)
                    for _, doc_id, data in _walk(lambda f=f: f.read(CHUNK), begin, end, order):
                        rows.append(_record(doc_id, data))
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_COLUMNS)

    files = spread(listed(spark, path).where(~F.element_at(F.split("path", "/"), -1).startswith("_")))
    places = files.mapInPandas(find, "path string, begin long, end long")
    n = max(1, spark.sparkContext.defaultParallelism)
    return places.repartition(n, "path", "begin").mapInPandas(read, SCHEMA)
