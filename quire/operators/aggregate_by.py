"""Aggregation by key prefix or bucket: on the fly, materialized with deferred refresh, or kept by deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.common import cut
from quire.operators.aggregates import Spec, expressions, grouped


def value_group(c: Column | str, step: float) -> Column:
    """Lower end of the bucket of width `step` the number lies in; negative integers go down, as floats do."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(step, int):
        return c - F.pmod(c, F.lit(step))
    return F.floor(c / F.lit(step)) * F.lit(step)


def _order(keys: list[str], tie: str | None) -> Column:
    return F.struct(*[F.col(k) for k in keys], *([F.col(tie)] if tie else []))


def aggregate_by(df: DataFrame, group: list[str | Column], specs: list[Spec], *, keys: list[str] | None = None, tie: str | None = "doc_id") -> DataFrame:
    """Groups `df` by the columns `group` ([]: one global group). `keys` and `tie` give the order for First, Last and
    GroupConcat (default: the tie alone)."""
    return grouped(df, list(group), specs, _order(keys or [], tie) if keys or tie else F.lit(0))


def aggregate_runs(df: DataFrame, group: list[str], specs: list[Spec], *, keys: list[str], tie: str = "doc_id", within: list[str] | None = None) -> DataFrame:
    """One row per run of equal `group` values in key order, with `run` (from 1). `within`: columns that part the order, so
    runs are numbered in each part. Without them the order is one sequence; it is dealt out by ranges, and only the first and
    last group of each range are looked at together."""
    now = F.struct(*[F.col(g) for g in group])
    if within:
        w = Window.partitionBy(*within).orderBy(*[F.col(k) for k in keys], F.col(tie))
        marked = df.withColumn("_new", F.when(F.lag(now).over(w).eqNullSafe(now), 0).otherwise(1))
        runs = marked.withColumn("run", F.sum("_new").over(w))
        extra = [c for c in within if c not in group]
        return runs.groupBy(*extra, *group, "run").agg(*expressions(specs, _order(keys, tie)))
    order = [F.col(k).asc_nulls_first() for k in [*keys, tie]]
    parts = max(2, df.sparkSession.sparkContext.defaultParallelism)
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    w = Window.partitionBy("_part").orderBy("_at")
    marked = placed.withColumn("_new", F.when(F.lag(F.lit(1)).over(w).isNull() | F.lag(now).over(w).eqNullSafe(now), 0).otherwise(1))
    edges = marked.groupBy("_part").agg(F.min_by(now, "_at").alias("first"), F.max_by(now, "_at").alias("last"), F.sum("_new").alias("more")).orderBy("_part").collect()  # one row per partition
    base, run, last = {}, 0, None
    for e in edges:
        run += 0 if last is not None and e["first"] == last else 1
        base[e["_part"]] = run
        run, last = run + e["more"], e["last"]
    if not base:
        return df.groupBy(*group, F.lit(1).cast("long").alias("run")).agg(*expressions(specs, _order(keys, tie))).limit(0)
    start = F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))])
    runs = marked.withColumn("run", (start[F.col("_part")] + F.sum("_new").over(w)).cast("long"))
    return runs.groupBy(*group, "run").agg(*expressions(specs, _order(keys, tie)))


def refresh(old: DataFrame, rows: DataFrame, dirty: DataFrame, group: list[str], specs: list[Spec], **how) -> DataFrame:
    """Materialized aggregate brought up to date: only the groups of `dirty` (distinct keys, few against all) are computed
    again from `rows`, the index; groups without rows disappear."""
    dirty = dirty.select(*group).distinct()
    new = aggregate_by(rows.join(dirty, group, "left_semi"), group, specs, **how)
    return old.join(dirty, group, "left_anti").unionByName(new)


def apply_deltas(old: DataFrame, changes: DataFrame, group: list[str], specs: list[Spec], *, exact_from: DataFrame | None = None, **how) -> DataFrame:
    """Aggregate kept by deltas; `changes` has the group and input columns and `sign` (1: included, -1: excluded).

    `old` has the groups, `n` (rows) and the results. Count, Sum and Sum2 follow from the signs. Without `exact_from` the others
    look at included values only (a maximum stays when its document goes) and groups of no rows stay. With `exact_from`, the rows
    after the change, groups that lost a row are computed again and groups of no rows disappear.
    """
    sign = F.col("sign")
    parts = [F.sum(sign).alias("n")]
    for name, c, a in specs:
        change = a.included(F.col(c) if isinstance(c, str) else c, sign)
        if change is None:
            raise TypeError(f"{type(a).__name__} cannot be kept by deltas")
        parts.append(change.alias(name))
    delta = changes.groupBy(*group).agg(*parts)
    d = delta.select(*group, *[F.col(c).alias(f"_d_{c}") for c in delta.columns if c not in group], F.lit(True).alias("_touched"))
    both = old.join(d, group, "full_outer")

    out = both.select(*group, (F.coalesce("n", F.lit(0)) + F.coalesce("_d_n", F.lit(0))).alias("n"), *[a.merged(F.col(name), F.col(f"_d_{name}")).alias(name) for name, _, a in specs])
    if exact_from is None:
        return out
    lost = changes.where("sign < 0").select(*group).distinct()
    again = exact_from.join(lost, group, "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *expressions(specs, _order([], how.get("tie", "doc_id"))))
    return out.join(lost, group, "left_anti").where("n > 0").unionByName(again)
