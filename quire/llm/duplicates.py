"""Records that differ only in how they are written: one each, with the number of copies.

The values of a record are brought to one form (letter case, white space and punctuation dropped), ordered, and hashed to
128 bits. Counts are made by an aggregate whose buffers are numbers, so rows of one record are combined before the shuffle.
A second, independent hash and the length of the form belong to the key: records whose 128 bits collide stay apart and are
counted as collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.common import skew_lookup, stored

FIELDS = ["email", "fname", "lname", "phone1"]

#: White space, punctuation, symbols and control or format characters, but for the mark between values.
_NOISE = r"[\s\p{Z}\p{P}\p{S}\p{C}&&[^\x01]]+"


def canonical(fields: list[str]) -> Column:
    """Text that is equal for records equal but for form and order of their values; '' if all are missing or blank."""
    joined = F.concat_ws("\x01", *[F.translate(F.col(f).cast("string"), "\x01", " ") for f in fields])
    values = F.split(F.regexp_replace(F.lower(joined), _NOISE, ""), "\x01")
    return F.concat_ws("\x01", F.array_sort(F.filter(values, lambda x: x != "")))


def record_key(fields: list[str]) -> Column:
    """md5 of the record's form with the check values (a second hash and the length), one binary of 28 bytes."""
    t = canonical(fields)
    number = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    return F.concat(F.unhex(F.md5(t)), number(F.xxhash64(t), 16), number(F.length(t), 8))


def keyed(df: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """(`row_id`, `h`): the row and the key of its record."""
    return df.select(F.col(key).alias("row_id"), record_key(fields or FIELDS).alias("h"))


def copies(df: DataFrame, *, key: str = "row_no", fields: list[str] | None = None) -> DataFrame:
    """One row per distinct record: `row_id` (the smallest of its rows), `copies`, `h`.

    Null and blank values count as missing; rows without any value are copies of each other. Empty tables give no rows.
    """
    return keyed(df, key, fields).groupBy("h").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies"))


def collisions(df: DataFrame, *, size: int = 16, **how) -> DataFrame:
    """Hashes of `size` bytes that several distinct records share, with their number; of 16 bytes expected to be none."""
    return copies(df, **how).groupBy(F.substring("h", 1, size).alias("h128")).agg(F.count(F.lit(1)).alias("records")).where("records > 1")


def copy_pairs(df: DataFrame, *, key: str = "row_no", fields: list[str] | None = None) -> DataFrame:
    """(`row_a`, `row_b`): each row that is not the first of its record, with the first."""
    rows = stored(keyed(df, key, fields), "keyed")  # the forms are made once, though rows are looked at three times
    groups = rows.groupBy("h").agg(F.min("row_id").alias("row_a"), F.count(F.lit(1)).alias("n"))
    many = groups.where("n > 1")
    out = skew_lookup(rows, "h", many.select("h", "row_a"), counts=many.select("h", "n"), how="inner")
    return out.where("row_id <> row_a").select("row_a", F.col("row_id").alias("row_b"))
