"""Codecs: how documents of a user's own form are stored as text and read back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    """`encode` makes the stored text from the columns of a row, `decode` a struct of these columns from the text. `deleted` tells
    from the text whether the document counts as deleted."""

    encode: Callable[[], Column]
    decode: Callable[[Column], Column]
    deleted: Callable[[Column], Column] | None = None

    def documents(self, rows: DataFrame) -> DataFrame:
        """`document` for each row, with `previous_id` if the row has one."""
        keep = [c for c in ("previous_id",) if c in rows.columns]
        return rows.select(self.encode().alias("document"), *keep)

    def rows(self, documents: DataFrame, *, column: str = "document") -> DataFrame:
        """The columns of the documents, beside the other columns of `documents`; deleted ones are left out."""
        if self.deleted is not None:
            documents = documents.where(~F.coalesce(self.deleted(F.col(column)), F.lit(False)))
        others = [c for c in documents.columns if c != column]
        return documents.select(*others, self.decode(F.col(column)).alias("_d")).select(*others, "_d.*")


def json_codec(schema: str, deleted: Callable[[Column], Column] | None = None) -> Codec:
    """Rows of a schema as JSON texts."""
    names = [f.split()[0].strip("`") for f in schema.split(",")]
    return Codec(lambda: F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), lambda c: F.from_json(c, schema), deleted)
