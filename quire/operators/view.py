"""Views: ordered, prefix-comparing selections over index, map and storage rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quire.errors import RecordNotFound
from quire.operators import keys as K
from quire.operators.storage import dense_ids


@dataclass(frozen=True)
class View:
    """Rows `df` under key columns `keys`; `tie` (the document id) orders rows of one key, None where keys are unique.

    Every selection gives a new view; nothing runs until rows are asked for. `reversed_` is the direction of the view, and
    a selection made backwards flips it. A comparison looks at as many leading key columns as the key has.
    """

    df: DataFrame
    keys: list[str | K.KeyColumn]
    tie: str | None = "doc_id"
    reversed_: bool = False
    storage: DataFrame | None = field(default=None, compare=False)

    def _where(self, condition: Column, backward: bool = False) -> View:
        return replace(self, df=self.df.where(condition), reversed_=self.reversed_ != backward)

    def select_all(self, *, backward: bool = False) -> View:
        return replace(self, reversed_=self.reversed_ != backward)

    def select(self, key: Any, *, backward: bool = False) -> View:
        return self._where(K.equal_to(self.keys, key), backward)

    select_equal_to = select

    def select_from(self, key: Any, *, backward: bool = False) -> View:
        """Forward: from the prefix on. Backward: the prefix's rows and all before, descending."""
        back = self.reversed_ != backward
        return self._where((K.less_equal if back else K.greater_equal)(self.keys, key), backward)

    def select_between(self, start: Any, end: Any, *, included: bool = False) -> View:
        """Rows from `start` to `end`, without the rows of `end` unless `included`; descending if `start` comes after `end`."""
        a, b = K.as_key(start), K.as_key(end)
        down = _comparable(a) > _comparable(b)
        if not down:
            return self._where(K.between(self.keys, a, b, included=included))
        low = K.greater_equal(self.keys, b) if included else K.greater_than(self.keys, b)
        return self._where(low & K.less_equal(self.keys, a), True)

    def select_greater_then(self, key: Any) -> View:
        return self._where(K.greater_than(self.keys, key))

    def select_less_then(self, key: Any) -> View:
        return self._where(K.less_than(self.keys, key))

    def select_greater_or_equal_then(self, key: Any) -> View:
        return self._where(K.greater_equal(self.keys, key))

    def select_less_or_equal_then(self, key: Any) -> View:
        return self._where(K.less_equal(self.keys, key))

    # comparison with a key selects; `key < view` arrives here as `view > key`
    def __eq__(self, key: object) -> View:  # type: ignore[override]
        return self.select(key)

    def __ne__(self, key: object) -> View:  # type: ignore[override]
        raise TypeError("an index has no selection for !=")

    def __gt__(self, key: Any) -> View:
        return self.select_greater_then(key)

    def __lt__(self, key: Any) -> View:
        return self.select_less_then(key)

    def __ge__(self, key: Any) -> View:
        return self.select_greater_or_equal_then(key)

    def __le__(self, key: Any) -> View:
        return self.select_less_or_equal_then(key)

    __hash__ = None  # type: ignore[assignment]

    def reverse(self) -> View:
        return replace(self, reversed_=not self.reversed_)

    def add_filter(self, condition: Column) -> View:
        """Rows that also meet `condition`; filters add up."""
        return self._where(condition)

    def without_deleted(self, is_deleted: Column) -> View:
        """Rows that the user's own predicate does not call deleted."""
        return self._where(~F.coalesce(is_deleted, F.lit(False)))

    def hide_duplicates(self) -> View:
        """One row per key: the lowest document id, in a reversed view the highest."""
        names = [k.name for k in K.key_columns(self.keys)]
        rest = [c for c in self.df.columns if c not in names]
        pick = F.max_by if self.reversed_ else F.min_by
        # an aggregate combines before the shuffle, which a window over the key would not
        one = self.df.groupBy(*names).agg(pick(F.struct(*rest), F.col(self.tie)).alias("_row"))
        return replace(self, df=one.select(*names, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*self.df.columns))

    def order(self) -> list[Column]:
        return K.order_by(self.keys, reverse=self.reversed_, tie=self.tie)

    def rows(self) -> DataFrame:
        """The selection in order."""
        return self.df.orderBy(*self.order())

    def limit(self, n: int) -> DataFrame:
        """The first `n` rows in order (a top-k, not a full sort)."""
        return self.rows().limit(n)

    def page(self, n: int, after: Row | None = None) -> DataFrame:
        """The next `n` rows after `after`, a row of an earlier page (None: from the start)."""
        if after is None:
            return self.limit(n)
        names = [k.name for k in K.key_columns(self.keys)] + ([self.tie] if self.tie else [])
        step = K.less_than if self.reversed_ else K.greater_than
        return replace(self, df=self.df.where(step(names, tuple(after[c] for c in names)))).limit(n)

    def page_before(self, n: int, before: Row) -> DataFrame:
        """The `n` rows before `before`, nearest first."""
        return self.reverse().page(n, before)

    def numbered(self) -> DataFrame:
        """The selection with `offset`, the number of rows before each; rows are dealt out by ranges and counted per range."""
        return dense_ids(self.df, 0, self.order()).select(*self.df.columns, F.col("id").alias("offset")) if "id" not in self.df.columns else dense_ids(self.df.withColumnRenamed("id", "_id"), 0, self.order()).withColumnsRenamed({"id": "offset", "_id": "id"})

    def find(self, key: Any) -> Row:
        """The first row of `key`; RecordNotFound if there is none."""
        found = self.select(key).limit(1).head(1)
        if not found:
            raise RecordNotFound(key)
        return found[0]

    def get(self, key: Any) -> Row | None:
        found = self.select(key).limit(1).head(1)
        return found[0] if found else None

    def empty(self) -> bool:
        return self.df.isEmpty()

    def count(self) -> int:
        return self.df.count()

    def approx_count(self, exact: int = 30, files: int = 8) -> int:
        """Exact up to `exact` rows, or where the rows lie in `files` files or fewer; else the rows of the selection in so many files,
        spread over all, extrapolated by bytes."""
        first = self.df.limit(exact + 1).count()
        paths = sorted(self.df.inputFiles())
        if first <= exact or len(paths) <= files:
            return first if first <= exact else self.df.count()
        picked = [paths[i * len(paths) // files] for i in range(files)]
        sizes = self._sizes(paths)
        try:
            # a condition on the file's path leaves the other files unread
            named = [*picked, *[p.replace("file:///", "file:/") for p in picked if p.startswith("file:///")]]
            found = self.df.where(F.col("_metadata.file_path").isin(named)).count()
        except AnalysisException:  # a selection that is no plain scan any more
            return self.df.count()
        return max(first, round(found * sum(sizes.values()) / max(1, sum(sizes[p] for p in picked))))

    def _sizes(self, paths: list[str]) -> dict[str, int]:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(paths[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return {p: int(fs.getFileStatus(path(p)).getLen()) for p in paths}

    def approx_bytes(self) -> int:
        """Bytes of files that the selection takes up: those of all its files, by the share of their rows."""
        paths = sorted(self.df.inputFiles())
        if not paths:
            return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        whole = self.df.sparkSession.read.parquet(*paths).count()  # from the footers
        return round(sum(self._sizes(paths).values()) * self.approx_count() / max(1, whole))

    def progress(self, at: Row) -> tuple[int, int, int]:
        """Approximate bytes of the selection: all, up to the row `at`, and after it."""
        names = [k.name for k in K.key_columns(self.keys)] + ([self.tie] if self.tie else [])
        key = tuple(at[c] for c in names)
        after = (K.less_than if self.reversed_ else K.greater_than)(names, key)
        total, rest = self.approx_bytes(), replace(self, df=self.df.where(after)).approx_bytes()
        return total, max(0, total - rest), rest

    def documents(self, storage: DataFrame | None = None) -> DataFrame:
        """Rows with the document of each (outer: a missing document gives nulls); `storage` (id, document, ...)."""
        storage = self.storage if storage is None else storage
        return self.df.join(storage.withColumnRenamed("id", self.tie), self.tie, "left")


def _comparable(key: tuple) -> tuple:
    return tuple((v is not None, v.text if isinstance(v, K.Prefix) else v) for v in key)
