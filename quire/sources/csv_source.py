"""CSV with a header: fields mapped by name, lenient conversions, quotes and separators."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import SPLIT_BYTES, read_records

# Words for truth.
TRUE = ["y", "t", "true", "yes", "on"]
FALSE = ["n", "f", "false", "no", "off"]

# Header names of the customer file.
CUSTOMER = {
    "Customer Id": "id", "First Name": "fname", "Last Name": "lname", "Company": "company", "City": "city", "Country": "country",
    "Phone 1": "phone1", "Phone 2": "phone2", "Email": "email", "Subscription Date": "subsdate", "Website": "website",
}


def to_integer(c: Column) -> Column:
    """The leading integer of a text, 0 if there is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d{1,18})", 1), F.lit("")), F.lit("S999999999999999999")).cast("bigint"), F.lit(0).cast("bigint"))


def to_float(c: Column) -> Column:
    """The leading number of a text, 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def to_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.coalesce(F.when(word.isin(TRUE), True).when(word.isin(FALSE), False).otherwise(to_float(c) != 0), F.lit(False))


CONVERT = {
    "string": lambda c: F.coalesce(c, F.lit("")), "long": to_integer, "int": lambda c: to_integer(c).cast("int"), "double": to_float,
    "boolean": to_boolean, "char": lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 1),
}


def map_columns(raw: DataFrame, mapping: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """Header names of `raw` to fields. Unknown columns are dropped, missing ones and missing trailing fields take the
    type's default; what does not parse becomes 0."""
    names = {c.strip(): c for c in raw.columns}
    out = []
    for header, field in mapping.items():
        c = F.col(f"`{names[header]}`") if header in names else F.lit(None).cast("string")
        out.append(CONVERT[(types or {}).get(field, "string")](c).alias(field))
    return raw.select(*out)


def read_csv(spark: SparkSession, path: str, mapping: dict[str, str], *, types: dict[str, str] | None = None, sep: str = ",", quote: str = '"', split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of files with a header, which must be the same in all; quoted fields may hold separators, line breaks and doubled
    quotes; empty lines are skipped. A file is read by as many tasks as it has splits."""
    lines = read_records(spark, path, sep=sep, quote=quote, split_bytes=split_bytes)
    first = lines.where("at = 0").orderBy("file").head(1)
    if not first:
        return map_columns(spark.createDataFrame([], "`-` string"), mapping, types)
    header = next(csv.reader([first[0].raw_line.lstrip("\ufeff")], delimiter=sep, quotechar=quote))
    # a repeated or empty name of a column cannot be mapped
    names = [h.strip() if h.strip() and h not in header[:i] else f"_{i}" for i, h in enumerate(header)]
    row = F.from_csv(F.col("raw_line"), ", ".join(f"`{h.replace('`', '')}` string" for h in names), {"sep": sep, "quote": quote, "escape": quote})
    return map_columns(lines.where("at > 0").select(row.alias("r")).select("r.*"), mapping, types)


def parse_csv(lines: DataFrame, column: str, header: list[str], mapping: dict[str, str], *, types: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """Records that are values of a string column."""
    schema = ", ".join(f"`{h}` string" for h in header)
    row = F.from_csv(F.col(column), schema, {"sep": sep, "escape": '"'})
    return map_columns(lines.where(F.trim(F.col(column)) != "").select(row.alias("r")).select("r.*"), mapping, types)
