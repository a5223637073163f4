"""Delimited records read by structural indexing; faulty ones come out with the reason.

A batch of records is one byte buffer. The mask of quote bytes and the parity of its running sum tell which bytes lie
inside quotes; the separators outside are the field ends, and every check is an operation on whole arrays. No record is
looked at alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.common import slices, spread

FIELDS = ["id", "fname", "lname", "company", "city", "country", "phone1", "phone2", "email", "subsdate", "website"]

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_HOST = rf"{_LABEL}(?:\.{_LABEL})+"
_PIECE = r"[A-Za-z0-9_+-]+"
_NOT_SPACE = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: field: (may it be empty, what it must match otherwise)
CHECKS = {
    "id": (False, r"\A[0-9A-Fa-f]{15}\z"),
    "email": (True, rf"\A{_PIECE}(?:\.{_PIECE})*@{_HOST}\z"),
    "subsdate": (True, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"),
    "website": (True, rf"\Ahttps?://{_HOST}(?::[0-9]{{1,5}})?(?:[/?#]{_NOT_SPACE}*)?\z"),
}


def real_dates(text: pa.Array) -> np.ndarray:
    """Which of `text`, all in the form YYYY-MM-DD, are dates that exist (years from 1)."""
    part = lambda a, b: pc.cast(pc.utf8_slice_codeunits(text, a, b), pa.int32()).to_numpy(zero_copy_only=False)
    y, m, d = part(0, 4), part(5, 7), part(8, 10)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where(m <= 12, m, 0)] + ((m == 2) & leap)
    return (y >= 1) & (d >= 1) & (d <= days)


def index_records(lines: pa.Array, seps: pa.Array, n_fields: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Structure of `lines`, each with its own one-byte separator.

    Returns which records break the quoting rule, their numbers of fields, the positions of the sound records with
    `n_fields` fields, and the unquoted fields of those, record by record.
    """
    n = len(lines)
    lines = pc.fill_null(lines.cast(pa.large_binary()), b"")
    offset = np.frombuffer(lines.buffers()[1], np.int64, n + 1, lines.offset * 8)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]] if offset[-1] > offset[0] else np.zeros(0, np.uint8)
    start = offset[:-1] - offset[0]
    end = offset[1:] - offset[0]
    sizes = end - start
    record = np.repeat(np.arange(n), sizes)
    sep = np.frombuffer(b"".join(seps.to_pylist()), np.uint8)

    quote = data == 34
    running = np.concatenate([[0], np.cumsum(quote)])  # quotes before each byte
    inside = ((running[:-1] - np.repeat(running[start], sizes)) & 1).astype(bool)  # parity within the record, before the byte
    is_sep = (data == np.repeat(sep, sizes)) & ~inside
    first = np.zeros(len(data), bool)
    last = np.zeros(len(data), bool)
    full = sizes > 0
    first[start[full]] = True
    last[end[full] - 1] = True
    before = lambda x: np.concatenate([[False], x[:-1]]) & ~first
    after = lambda x: np.concatenate([x[1:], [False]]) & ~last
    doubled = quote & ~inside & before(quote)  # the second of two quotes inside a quoted field
    opens = quote & ~inside & ~doubled
    # a separator just after a closing quote lies outside again: its own parity says so
    wrong = (opens & ~(first | before(is_sep))) | (quote & inside & ~(last | after(is_sep) | after(quote)))
    bad = np.zeros(n, bool)
    bad[record[wrong]] = True
    bad |= ((running[end] - running[start]) & 1).astype(bool)

    count = np.bincount(record[is_sep], minlength=n) + 1
    sound = np.flatnonzero(~bad & (count == n_fields))
    ok = np.zeros(n, bool)
    ok[sound] = True
    take = np.repeat(ok, sizes)
    keep = take & ~is_sep & (~quote | doubled)
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = np.sort(np.concatenate([np.flatnonzero(is_sep & take), end[sound]]))
    # an empty last field ends where the record does, and an empty record has one field: both sort into place
    offsets = np.concatenate([[0], kept[ends]]).astype(np.int64)
    fields = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes())])
    return bad, count, sound, fields


def check_batch(lines: pa.Array, seps: pa.Array, fields: list[str], checks: dict[str, tuple[bool, str]]) -> tuple[pa.Array, list[pa.Array]]:
    """Reason (null: none) and fields (null where there is a reason) of each record."""
    n, k = len(lines), len(fields)
    seps = pc.fill_null(seps, ",")
    seps = pc.if_else(pc.equal(pc.binary_length(seps), 1), seps, ",")
    bad, count, sound, flat = index_records(lines, seps.cast(pa.binary()), k)
    reason = np.full(n, None, object)
    reason[count != k] = "columns"
    reason[bad] = "quoting"
    columns = [flat.take(pa.array(np.arange(i, len(sound) * k, k))) for i in range(k)]
    open_ = np.ones(len(sound), bool)
    for name, (empty, pattern) in checks.items():
        value = pc.utf8_trim_whitespace(columns[fields.index(name)])
        good = pc.match_substring_regex(value, pattern).to_numpy(zero_copy_only=False)
        if name == "subsdate":
            form = np.flatnonzero(good)
            good = good.copy()
            good[form] = real_dates(value.take(pa.array(form)))
        if empty:
            good = good | pc.equal(pc.binary_length(value), 0).to_numpy(zero_copy_only=False)
        reason[sound[open_ & ~good]] = name
        open_ &= good
    where = np.full(n, -1)
    where[sound[open_]] = np.flatnonzero(open_)
    at = pa.array(where, mask=where < 0)
    return pa.array(reason, pa.string()), [c.take(at).cast(pa.string()) for c in columns]


def parse_records(df: DataFrame, *, key: str = "line_no", line: str = "raw_line", sep: str = "sep_char", fields: list[str] | None = None, checks: dict[str, tuple[bool, str]] | None = None) -> DataFrame:
    """One row per record of `df`: `key`, `reason`, then the fields.

    `reason` is null for valid records; for the others, which have null fields, it is the first that applies of
    `quoting`, `columns` and the names of `checks` in their order. Values come out unquoted but untrimmed.
    A null or empty record has one empty field, so the reason is `columns` (if more than one is expected). A null
    separator, or one that is not a single byte, counts as a comma. Repeated records give repeated rows; other
    columns of `df`, whatever their names, are ignored.
    """
    fields, checks = fields or FIELDS, CHECKS if checks is None else checks
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("_key"), F.col(line).cast("string").alias("_line"), F.col(sep).cast("string").alias("_sep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            reason, columns = check_batch(part.column(1), part.column(2), fields, checks)
            yield pa.RecordBatch.from_arrays([part.column(0), reason, *columns], ["_key", "reason", *[f"f{i}" for i in range(len(fields))]])

    out = rows.mapInArrow(run, f"_key {kind}, reason string, " + ", ".join(f"f{i} string" for i in range(len(fields))))
    return out.select(F.col("_key").alias(key), "reason", *[F.col(f"f{i}").alias(f"{name}_text" if name in (key, "reason") else name) for i, name in enumerate(fields)])


def rejects(df: DataFrame, **names) -> DataFrame:
    """The faulty records: `key`, `reason`."""
    out = parse_records(df, **names)
    return out.where(F.col("reason").isNotNull()).select(out.columns[0], "reason")


def valid(df: DataFrame, **names) -> DataFrame:
    """The sound records: `key` and the fields."""
    out = parse_records(df, **names)
    return out.where(F.col("reason").isNull()).drop("reason")
