"""Queries of the operators of the document store, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.common import cut
from quire.functions import scalar, structured
from quire.operators import aggregates as A
from quire.operators import index as ix
from quire.operators import keys as K
from quire.operators import storage as st
from quire.operators.aggregate_by import aggregate_by, aggregate_runs, apply_deltas, refresh, value_group
from quire.operators.docset import DocSet, DocSetStack
from quire.operators.view import View
from quire.sources import csv_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TABLES = "region nation customer supplier part orders lineitem events documents embeddings customers customer_lines doc_records index_updates exported_docs eval_items pack_specs".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the document log. Revisions derive from events: each event of a user replaces the one before.


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("id"), F.coalesce(before + 1, F.lit(0)).alias("previous_id"),
        (F.col("event_type") == "error").alias("deleted"), (F.col("event_type") != "error").alias("has_value"), F.col("props").alias("document"), "user_id",
    )


_LOG = """log AS (SELECT event_id + 1 AS id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1, 0) AS previous_id,
    event_type = 'error' AS deleted, event_type <> 'error' AS has_value, props AS document, user_id FROM events)"""
_REV = "id, previous_id, deleted, has_value, document"


def _rev(df: DataFrame) -> DataFrame:
    return df.select("id", "previous_id", "deleted", "has_value", "document")


@query(f"WITH {_LOG} SELECT {_REV} FROM log ORDER BY id")
def scan_storage(spark, sf):
    return _rev(st.select_all(log(spark, sf)))


@query(f"WITH {_LOG} SELECT {_REV} FROM log WHERE id >= 500")
def scan_from(spark, sf):
    return _rev(st.select_from(log(spark, sf), 500))


@query(f"WITH {_LOG} SELECT {_REV} FROM log WHERE id <= 500")
def scan_from_backward(spark, sf):
    return _rev(st.select_from(log(spark, sf), 500, backward=True))


@query(f"WITH {_LOG} SELECT {_REV} FROM log WHERE id >= 100 AND id < 400")
def scan_range(spark, sf):
    return _rev(st.select_range(log(spark, sf), 100, 400))


@query(f"WITH {_LOG} SELECT {_REV} FROM log WHERE id <= 400 AND id >= 100")
def scan_range_backward(spark, sf):
    return _rev(st.select_range(log(spark, sf), 400, 100, included=True))


@query("SELECT max(event_id) + 1 AS last_id FROM events")
def last_id(spark, sf):
    return st.last_id(table(spark, sf, "events").select((F.col("event_id") + 1).alias("id")))


@query(f"WITH {_LOG} SELECT {_REV} FROM log WHERE id = 321")
def point_find(spark, sf):
    return _rev(st.find(log(spark, sf), 321))


@query(f"WITH {_LOG} SELECT document FROM log WHERE id = 321 AND has_value")
def point_get(spark, sf):
    return st.get(log(spark, sf), 321)


@query(f"WITH {_LOG} SELECT {_REV} FROM log l WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM log r WHERE r.previous_id = l.id)")
def current_docs(spark, sf):
    return _rev(st.current(cut(log(spark, sf))))


def _compact_sql(n: int) -> str:
    return f"""WITH {_LOG} SELECT {_REV} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM log) WHERE r <= {n + 1}"""


@query(_compact_sql(0))
def compact_0(spark, sf):
    return _rev(st.compact(cut(log(spark, sf)), 0))


@query(_compact_sql(2))
def compact_2(spark, sf):
    return _rev(st.compact(cut(log(spark, sf)), 2))


@query(
    f"""WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r, max(id) OVER () AS newest,
        last_value(deleted) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dead FROM log)
    SELECT {_REV} FROM n WHERE r = 1 AND (NOT dead OR id = newest)"""
)
def compact_deleted(spark, sf):
    return _rev(st.compact(cut(log(spark, sf)), 0, deleted=True))


@query(f"WITH {_LOG} SELECT {_REV} FROM log WHERE id NOT IN (SELECT id FROM log WHERE previous_id = 0)")
def restore_missing(spark, sf):
    rev = cut(log(spark, sf))
    return _rev(st.restore(rev.where("previous_id = 0"), rev))


@query(f"WITH {_LOG} SELECT {_REV} FROM log WHERE NOT deleted")
def purge_deleted(spark, sf):
    rev = cut(log(spark, sf))
    return _rev(st.purge(rev, rev.where("deleted").select("id")))


@query(
    f"""WITH {_LOG} SELECT n.id AS new_doc_id, n.previous_id AS old_doc_id, coalesce(o.previous_id, 0) AS old_old_doc_id, n.deleted, n.document AS new_doc, o.document AS old_doc
    FROM log n LEFT JOIN log o ON o.id = n.previous_id"""
)
def change_feed(spark, sf):
    return st.change_feed(cut(log(spark, sf)))


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS id, o_orderkey FROM orders")
def put_dense_ids(spark, sf):
    return st.dense_ids(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), 1001, [F.col("o_orderdate"), F.col("o_orderkey")]).select("id", "o_orderkey")


@query(f"""WITH {_LOG}, e AS (SELECT (SELECT max(id) FROM log) + row_number() OVER (ORDER BY id) AS id, id AS previous_id FROM log WHERE previous_id = 0)
    SELECT id, previous_id, TRUE AS deleted, FALSE AS has_value FROM e""")
def erase_docs(spark, sf):
    rev = cut(log(spark, sf))
    top = st.last_id(rev).first()[0]
    return st.erase(rev, rev.where("previous_id = 0").select("id"), top + 1).select("id", "previous_id", "deleted", "has_value")


@query(f"""WITH {_LOG} SELECT (SELECT max(id) FROM log) + row_number() OVER (ORDER BY id) AS id, id AS previous_id, FALSE AS deleted, '{{"new":' || id || '}}' AS document FROM log WHERE deleted""")
def put_replacements(spark, sf):
    rev = cut(log(spark, sf))
    top = st.last_id(rev).first()[0]
    docs = rev.where("deleted").select(F.col("id").alias("previous_id"), F.concat(F.lit('{"new":'), F.col("id"), F.lit("}")).alias("document"))
    return st.put(rev, docs, top + 1, order=[F.col("previous_id")]).select("id", "previous_id", "deleted", "document")


# --- index selections, over parts keyed by (p_brand, p_size)

PART = ["p_brand", "p_size"]
_P = "SELECT p_brand, p_size, p_retailprice AS price, p_partkey AS doc_id FROM part"


def parts(spark, sf) -> View:
    fn = ix.IndexFunction(PART, ["price"], lambda: [{"p_brand": F.col("p_brand"), "p_size": F.col("p_size"), "price": F.col("p_retailprice")}])
    return View(fn.rows(table(spark, sf, "part"), id_col="p_partkey"), PART)


@query(f"{_P} WHERE p_brand = 'Brand#22' AND p_size = 36")
def idx_eq(spark, sf):
    return (parts(spark, sf) == ("Brand#22", 36)).rows()


@query(f"{_P} WHERE p_brand = 'Brand#22'")
def idx_prefix_eq(spark, sf):
    return (parts(spark, sf) == "Brand#22").rows()


@query(f"{_P} WHERE p_brand > 'Brand#22' OR (p_brand = 'Brand#22' AND p_size >= 36)")
def idx_from(spark, sf):
    return parts(spark, sf).select_from(("Brand#22", 36)).rows()


@query(f"{_P} WHERE p_brand < 'Brand#22' OR (p_brand = 'Brand#22' AND p_size <= 36)")
def idx_from_backward(spark, sf):
    return parts(spark, sf).select_from(("Brand#22", 36), backward=True).rows()


_LOW = "(p_brand > 'Brand#13' OR (p_brand = 'Brand#13' AND p_size >= 10))"


@query(f"{_P} WHERE {_LOW} AND (p_brand < 'Brand#32' OR (p_brand = 'Brand#32' AND p_size < 20))")
def idx_between_excl(spark, sf):
    return parts(spark, sf).select_between(("Brand#13", 10), ("Brand#32", 20)).rows()


@query(f"{_P} WHERE {_LOW} AND (p_brand < 'Brand#32' OR (p_brand = 'Brand#32' AND p_size <= 20))")
def idx_between_incl(spark, sf):
    return parts(spark, sf).select_between(("Brand#13", 10), ("Brand#32", 20), included=True).rows()


@query(f"{_P} WHERE (p_brand < 'Brand#32' OR (p_brand = 'Brand#32' AND p_size <= 20)) AND (p_brand > 'Brand#13' OR (p_brand = 'Brand#13' AND p_size > 10))")
def idx_between_down(spark, sf):
    return parts(spark, sf).select_between(("Brand#32", 20), ("Brand#13", 10)).rows()


@query(f"{_P} WHERE p_brand > 'Brand#22'")
def idx_gt(spark, sf):
    return (parts(spark, sf) > "Brand#22").rows()


@query(f"{_P} WHERE p_brand < 'Brand#22' OR (p_brand = 'Brand#22' AND p_size < 36)")
def idx_lt(spark, sf):
    return (parts(spark, sf) < ("Brand#22", 36)).rows()


@query(f"{_P} WHERE p_brand > 'Brand#22' OR (p_brand = 'Brand#22' AND p_size >= 36)")
def idx_ge(spark, sf):
    return (parts(spark, sf) >= ("Brand#22", 36)).rows()


@query(f"{_P} WHERE p_brand <= 'Brand#22'")
def idx_le(spark, sf):
    return (parts(spark, sf) <= ("Brand#22",)).rows()


@query("SELECT p_name, p_partkey AS doc_id FROM part WHERE starts_with(p_name, 'b')")
def idx_string_prefix(spark, sf):
    df = table(spark, sf, "part").select("p_name", F.col("p_partkey").alias("doc_id"))
    return View(df, ["p_name"]).select(K.Prefix("b")).rows()


@query(f"{_P} WHERE p_brand = 'Brand#22' AND p_retailprice > 950 AND p_size % 2 = 0")
def idx_filter(spark, sf):
    return parts(spark, sf).select("Brand#22").add_filter(F.col("price") > 950).add_filter(F.col("p_size") % 2 == 0).rows()


@query(f"SELECT * FROM ({_P}) QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY doc_id) = 1")
def idx_hide_dup(spark, sf):
    return parts(spark, sf).hide_duplicates().rows()


@query(f"SELECT * FROM ({_P}) QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY doc_id DESC) = 1")
def idx_hide_dup_rev(spark, sf):
    return parts(spark, sf).reverse().hide_duplicates().rows()


@query("SELECT p_brand, p_size, count(*) AS documents FROM part GROUP BY ALL HAVING count(*) > 1")
def idx_unique_violations(spark, sf):
    return ix.conflicts(parts(spark, sf).df, PART)


@query("SELECT p_brand, p_size, arg_max(p_retailprice, p_partkey) AS price, max(p_partkey) AS doc_id FROM part GROUP BY ALL")
def idx_last_wins(spark, sf):
    return ix.last_writer(parts(spark, sf).df, PART)


_EMIT = ix.IndexFunction(
    ["tag", "text"],
    ["acctbal"],
    lambda: [
        {"tag": F.lit(1), "text": F.col("c_name"), "acctbal": F.col("c_acctbal")},
        {"tag": F.lit(2), "text": F.col("c_mktsegment"), "acctbal": F.col("c_acctbal")},
        {"tag": F.lit(3), "text": F.col("c_nationkey").cast("string"), "acctbal": F.col("c_acctbal")},
        {"tag": F.lit(4), "text": F.lit("debtor"), "acctbal": F.col("c_acctbal"), "when": F.col("c_acctbal") < 0},
    ],
)


@query(
    """SELECT 1 AS tag, c_name AS text, c_acctbal AS acctbal, c_custkey AS doc_id FROM customer UNION ALL SELECT 2, c_mktsegment, c_acctbal, c_custkey FROM customer
    UNION ALL SELECT 3, c_nationkey::VARCHAR, c_acctbal, c_custkey FROM customer UNION ALL SELECT 4, 'debtor', c_acctbal, c_custkey FROM customer WHERE c_acctbal < 0"""
)
def idx_multi_emit(spark, sf):
    return _EMIT.rows(table(spark, sf, "customer"), id_col="c_custkey")


@query("SELECT c_mktsegment AS segment, c_custkey AS doc_id FROM customer WHERE c_acctbal < 0")
def idx_partial(spark, sf):
    fn = ix.IndexFunction(["segment"], [], lambda: [{"segment": F.col("c_mktsegment"), "when": F.col("c_acctbal") < 0}])
    return fn.rows(table(spark, sf, "customer"), id_col="c_custkey")


_EVENT = ix.IndexFunction(["k"], [], lambda: [{"k": F.get_json_object("document", "$.k").cast("int")}])


@query(
    f"""WITH {_LOG}, c AS (SELECT * FROM log l WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM log r WHERE r.previous_id = l.id))
    SELECT (document->>'$.k')::INT AS k, id AS doc_id FROM c"""
)
def idx_incremental(spark, sf):
    """An index built over the first half of the log and updated by the changes of the second equals one over all."""
    rev = cut(log(spark, sf))
    half = rev.agg(F.max("id")).first()[0] // 2
    first = rev.where(F.col("id") <= half)
    return ix.update(ix.build(st.current(first), _EVENT), st.change_feed(rev, rev.where(F.col("id") > half)), _EVENT)


@query(f"SELECT p.p_brand, p.p_size, p.price, p.doc_id, q.p_name AS document FROM ({_P}) p LEFT JOIN part q ON q.p_partkey = p.doc_id AND q.p_size > 20")
def lookup_docs(spark, sf):
    storage = table(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("document"))
    return parts(spark, sf).documents(storage)


@query("SELECT l_orderkey AS doc_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def chkref(spark, sf):
    index = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    return st.dangling(index, table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


# --- aggregation


def lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("doc_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def agg_prefix(spark, sf):
    out = aggregate_by(lines(spark, sf), ["l_returnflag"], [("n", "l_quantity", A.Count()), ("quantity", "l_quantity", A.Sum())])
    return out.withColumn("quantity", F.round("quantity", 2))


@query("SELECT count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def agg_global(spark, sf):
    return aggregate_by(lines(spark, sf), [], A.composite("l_quantity", n=A.Count(), low=A.Min(), high=A.Max()))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2")
def agg_two_cols(spark, sf):
    out = aggregate_by(lines(spark, sf), ["l_returnflag", "l_linestatus"], A.composite("l_extendedprice", n=A.Count(), price=A.Sum()))
    return out.withColumn("price", F.round("price", 2))


@query(
    """SELECT o_orderpriority, (CAST(o_totalprice AS BIGINT) // 50000) * 50000 AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high
    FROM (SELECT * REPLACE (trunc(o_totalprice) AS o_totalprice) FROM orders) GROUP BY 1, 2"""
)
def agg_bucket(spark, sf):
    """Orders by priority and price bucket."""
    df = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("bigint").alias("p"))
    df = df.withColumn("bucket", value_group("p", 50_000)).withColumn("p", F.col("p").cast("double"))
    out = aggregate_by(df, ["o_orderpriority", "bucket"], A.composite("p", n=A.Count(), total=A.Sum(), low=A.Min(), high=A.Max()))
    return out.withColumn("total", F.round("total", 2))


@query("SELECT CAST(floor(trunc(c_acctbal) / 1000) * 1000 AS BIGINT) AS bucket, count(*) AS n FROM customer GROUP BY 1")
def agg_bucket_signed(spark, sf):
    df = table(spark, sf, "customer").select(value_group(F.col("c_acctbal").cast("bigint"), 1000).alias("bucket"), F.col("c_custkey").alias("doc_id"))
    return aggregate_by(df, ["bucket"], [("n", "doc_id", A.Count())])


@query("SELECT floor(c_acctbal / 250.5) * 250.5 AS bucket, count(*) AS n FROM customer GROUP BY 1")
def agg_bucket_float(spark, sf):
    df = table(spark, sf, "customer").select(value_group("c_acctbal", 250.5).alias("bucket"), F.col("c_custkey").alias("doc_id"))
    return aggregate_by(df, ["bucket"], [("n", "doc_id", A.Count())])


@query(
    """WITH a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
    r AS (SELECT *, sum(CASE WHEN b IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
    SELECT user_id, event_type, run::BIGINT AS run, count(*) AS n, min(event_id) AS first FROM r GROUP BY 1, 2, 3"""
)
def agg_runs(spark, sf):
    df = table(spark, sf, "events").withColumnRenamed("event_id", "doc_id")
    return aggregate_runs(df, ["event_type"], [("n", "doc_id", A.Count()), ("first", "doc_id", A.Min())], keys=["user_id"], within=["user_id"])


@query("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1")
def agg_composite(spark, sf):
    out = aggregate_by(parts(spark, sf).df, ["p_brand"], A.composite("price", n=A.Count(), total=A.Sum(), low=A.Min(), high=A.Max()))
    return out.withColumn("total", F.round("total", 2))


@query("SELECT l_returnflag, sum(l_linenumber)::BIGINT AS l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def agg_rows(spark, sf):
    specs = A.aggregate_rows(["l_linenumber", "l_tax", "l_quantity"], [A.Sum(), A.Skip(), A.Max()])
    return aggregate_by(lines(spark, sf), ["l_returnflag"], specs)


@query("SELECT c_mktsegment, CAST(trunc(avg(trunc(c_acctbal))) AS BIGINT) AS mean, round(avg(c_acctbal), 4) AS exact FROM customer GROUP BY 1")
def agg_avg_int(spark, sf):
    df = table(spark, sf, "customer").withColumnRenamed("c_custkey", "doc_id")
    out = aggregate_by(df, ["c_mktsegment"], [("mean", F.col("c_acctbal").cast("bigint"), A.Avg(integer=True)), ("exact", "c_acctbal", A.Avg())])
    return out.withColumn("exact", F.round("exact", 4))


@query("SELECT l_returnflag, sum(l_quantity * l_quantity) AS squares, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem GROUP BY 1")
def agg_sum2(spark, sf):
    out = aggregate_by(lines(spark, sf), ["l_returnflag"], A.composite("l_quantity", squares=A.Sum2(), deviation=A.StdDev()))
    return out.withColumn("deviation", F.round("deviation", 6))


@query("SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def agg_first_last(spark, sf):
    df = table(spark, sf, "events").withColumnRenamed("event_id", "doc_id")
    return aggregate_by(df, ["user_id"], A.composite("event_type", first=A.First(), last=A.Last()))


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS types FROM events GROUP BY 1")
def agg_group_concat(spark, sf):
    df = table(spark, sf, "events").withColumnRenamed("event_id", "doc_id")
    return aggregate_by(df, ["user_id"], [("types", "event_type", A.GroupConcat("|"))])


@query(
    """SELECT c_mktsegment, max(3 * c_acctbal) AS scaled, min(c_acctbal + 100) AS moved, max(50 - c_acctbal) AS inverted, sum(trunc(c_acctbal))::BIGINT AS whole, max(abs(c_acctbal)) AS size
    FROM customer GROUP BY 1"""
)
def agg_modifiers(spark, sf):
    df = table(spark, sf, "customer").withColumnRenamed("c_custkey", "doc_id")
    specs = A.composite("c_acctbal", scaled=A.Scale(3, A.Max()), moved=A.Offset(100, A.Min()), inverted=A.Invert(50, A.Max()), whole=A.Convert("bigint", A.Sum()), size=A.Transform(F.abs, A.Max()))
    return aggregate_by(df, ["c_mktsegment"], specs)


@query("SELECT user_id, list_aggregate(list(value ORDER BY event_id), 'last') - list_aggregate(list(value ORDER BY event_id), 'first') AS change FROM events GROUP BY 1")
def agg_custom(spark, sf):
    df = table(spark, sf, "events").withColumnRenamed("event_id", "doc_id")
    return aggregate_by(df, ["user_id"], [("change", "value", A.Custom(lambda x: F.element_at(x, -1) - F.element_at(x, 1)))])


@query("SELECT n AS events, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def agg_cascade(spark, sf):
    per_user = aggregate_by(table(spark, sf, "events").withColumnRenamed("event_id", "doc_id"), ["user_id"], [("events", "doc_id", A.Count())])
    return aggregate_by(per_user, ["events"], [("users", "user_id", A.Count())], tie=None)


def _delta_input(spark, sf):
    """Order totals by status; orders whose key ends in 0 are excluded again, those ending in 1 come later."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("bigint").alias("price"), F.col("o_orderkey").alias("doc_id"))
    late, gone = F.col("doc_id") % 10 == 1, F.col("doc_id") % 10 == 0
    specs = A.composite("price", orders=A.Count(), total=A.Sum(), squares=A.Sum2(), low=A.Min(), high=A.Max())
    old = aggregate_by(o.where(~late), ["status"], [("n", "price", A.Count()), *specs])
    changes = o.where(late).withColumn("sign", F.lit(1)).unionByName(o.where(gone).withColumn("sign", F.lit(-1)))
    return o.where(~gone), old, changes, specs


_DELTA = "SELECT o_orderstatus AS status, CAST(trunc(o_totalprice) AS BIGINT) AS p, o_orderkey AS k FROM orders"


@query(f"SELECT status, count(*) AS n, count(*) AS orders, sum(p)::BIGINT AS total, sum(p * p)::BIGINT AS squares, min(p) AS low, max(p) AS high FROM ({_DELTA}) WHERE k % 10 <> 0 GROUP BY 1")
def agg_incremental_exact(spark, sf):
    now, old, changes, specs = _delta_input(spark, sf)
    return apply_deltas(old, changes, ["status"], specs, exact_from=now)


@query(
    f"""SELECT status, count(*) FILTER (k % 10 <> 0) AS n, count(*) FILTER (k % 10 <> 0) AS orders, sum(p) FILTER (k % 10 <> 0)::BIGINT AS total, sum(p * p) FILTER (k % 10 <> 0)::BIGINT AS squares,
    min(p) AS low, max(p) AS high FROM ({_DELTA}) GROUP BY 1"""
)
def agg_incremental_incl(spark, sf):
    _, old, changes, specs = _delta_input(spark, sf)
    return apply_deltas(old, changes, ["status"], specs)


@query("SELECT o_custkey AS customer, count(*) AS n, max(o_orderkey) AS newest FROM orders WHERE o_orderkey % 100 <> 7 GROUP BY 1")
def agg_dirty_refresh(spark, sf):
    """A materialized aggregate over all orders, refreshed for the customers whose orders went."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("doc_id"))
    specs = [("n", "doc_id", A.Count()), ("newest", "doc_id", A.Max())]
    gone = F.col("doc_id") % 100 == 7
    return refresh(aggregate_by(o, ["customer"], specs), o.where(~gone), o.where(gone), ["customer"], specs)


# --- sets of document ids: orders by priority, status and price


def _sets(spark, sf) -> list[DocSet]:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id")
    pick = lambda c: DocSet.of(o.where(c), value="o_orderpriority", distinct=True)
    return [pick(F.col("o_orderpriority") == "1-URGENT"), pick(F.col("o_orderstatus") == "F"), pick(F.col("o_totalprice") > 150_000)]


def _ids(s: DocSet) -> DataFrame:
    return s.all_items().select("id")


_A, _B, _C = (f"SELECT o_orderkey AS id FROM orders WHERE {c}" for c in ("o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'", "o_totalprice > 150000"))


@query(f"{_A} INTERSECT {_B}")
def set_and(spark, sf):
    a, b, _ = _sets(spark, sf)
    return _ids(DocSetStack().push(a).push(b).AND().pop())


@query(f"{_A} UNION {_B}")
def set_or(spark, sf):
    a, b, _ = _sets(spark, sf)
    return _ids(DocSetStack().push(a).push(b).OR().pop())


@query(f"(({_A}) UNION ({_B})) EXCEPT (({_A}) INTERSECT ({_B}))")
def set_xor(spark, sf):
    a, b, _ = _sets(spark, sf)
    return _ids(DocSetStack().push(a).push(b).XOR().pop())


@query(f"{_A} EXCEPT {_B}")
def set_diff(spark, sf):
    a, b, _ = _sets(spark, sf)
    return _ids(DocSetStack().push(a).push(b).NOT().AND().pop())


@query(f"{_C} EXCEPT (({_A}) UNION ({_B}))")
def set_not_and(spark, sf):
    """NOT (a OR b) AND c, by De Morgan's laws without a list of all ids."""
    a, b, c = _sets(spark, sf)
    return _ids(DocSetStack().push(a).push(b).OR().NOT().push(c).AND().pop())


@query("SELECT l_partkey % 500 AS id FROM lineitem WHERE l_quantity < 10 INTERSECT ALL SELECT l_suppkey % 500 FROM lineitem WHERE l_quantity > 40")
def set_multiset_and(spark, sf):
    li = table(spark, sf, "lineitem")
    a = DocSet.of(li.where("l_quantity < 10").select((F.col("l_partkey") % 500).alias("doc_id")))
    b = DocSet.of(li.where("l_quantity > 40").select((F.col("l_suppkey") % 500).alias("doc_id")))
    return a.and_(b).df.select("id")


@query("SELECT l_partkey % 500 AS id FROM lineitem WHERE l_quantity < 10 EXCEPT ALL SELECT l_suppkey % 500 FROM lineitem WHERE l_quantity > 40")
def set_multiset_diff(spark, sf):
    li = table(spark, sf, "lineitem")
    a = DocSet.of(li.where("l_quantity < 10").select((F.col("l_partkey") % 500).alias("doc_id")))
    b = DocSet.of(li.where("l_quantity > 40").select((F.col("l_suppkey") % 500).alias("doc_id")))
    return a.and_(~b).df.select("id")


@query("SELECT o_orderkey AS id, o_orderpriority AS value, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 150000")
def set_list(spark, sf):
    a, _, c = _sets(spark, sf)
    return a.and_(c).list(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"))


# --- order and pages


@query("SELECT c_acctbal, c_name, c_custkey AS doc_id FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 100")
def sort_desc_topk(spark, sf):
    df = table(spark, sf, "customer").select("c_acctbal", "c_name", F.col("c_custkey").alias("doc_id"))
    return View(df, ["c_acctbal"]).reverse().limit(100)


@query(f"SELECT p_brand, p_size, price, doc_id FROM ({_P}) ORDER BY p_brand, p_size, doc_id LIMIT 50 OFFSET 50")
def page_keyset(spark, sf):
    v = parts(spark, sf)
    last = v.page(50).orderBy(F.desc("p_brand"), F.desc("p_size"), F.desc("doc_id")).first()
    return v.page(50, last)


@query("SELECT vec_id, label FROM embeddings ORDER BY len(embedding), embedding, vec_id LIMIT 200")
def sort_array_length_first(spark, sf):
    df = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return View(df, [K.KeyColumn("embedding", "array")]).limit(200).select(F.col("doc_id").alias("vec_id"), "label")


# --- structured documents and scalar functions


@query("SELECT event_id, (props->>'$.k')::INT AS k, props->>'$.missing' AS missing FROM events")
def json_get(spark, sf):
    v = structured.parse(F.col("props"))
    return table(spark, sf, "events").select("event_id", structured.get(v, "$.k", "int").alias("k"), structured.get(v, "$.missing", "string").alias("missing"))


@query("SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.missing') AS has_missing FROM events")
def json_contains(spark, sf):
    v = structured.parse(F.col("props"))
    return table(spark, sf, "events").select("event_id", structured.contains(v, "$.k", "int").alias("has_k"), structured.defined(v, "$.missing").alias("has_missing"))


@query("SELECT event_id, json(props)::VARCHAR AS props FROM events")
def json_roundtrip(spark, sf):
    return table(spark, sf, "events").select("event_id", structured.text(structured.parse(F.col("props"))).alias("props"))


@query("SELECT id, try_cast(document->>'$.number' AS DOUBLE) AS number, document->>'$.text' AS text, CASE WHEN document IS NOT NULL THEN coalesce(json_array_length(document, '$.pole'), 0) END::INT AS poles FROM doc_records")
def json_documents(spark, sf):
    v = structured.parse(F.col("document"))
    poles = F.when(F.col("document").isNotNull(), F.coalesce(F.size(structured.get(v, "$.pole", "array<variant>")), F.lit(0)))
    return table(spark, sf, "doc_records").select("id", structured.get(v, "$.number", "double").alias("number"), structured.get(v, "$.text", "string").alias("text"), poles.alias("poles"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, len(embedding) + 1 AS longer, len(embedding) - 1 AS shorter FROM embeddings")
def array_functions(spark, sf):
    a = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", structured.front(a).cast("double").alias("first"), structured.back(a).cast("double").alias("last"),
        F.size(structured.push_back(a, F.lit(0.0).cast("float"))).cast("bigint").alias("longer"), F.size(structured.pop_back(a)).cast("bigint").alias("shorter"),
    )


@query("SELECT event_id, epoch_us(ts) AS ticks, strlen(event_type) AS bytes FROM events")
def scalar_functions(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.to_ticks(F.col("ts")).alias("ticks"), scalar.byte_length(F.col("event_type")).cast("bigint").alias("bytes"))


@query(
    """SELECT line_no, coalesce(try_cast(nullif(regexp_extract(raw_line, '^\\s*([+-]?\\d{1,18})', 1), '') AS BIGINT), 0) AS n,
    CASE WHEN lower(trim(substr(raw_line, 1, 1), ' ')) IN ('y', 't') THEN TRUE WHEN lower(trim(substr(raw_line, 1, 1), ' ')) IN ('n', 'f') THEN FALSE
    ELSE coalesce(try_cast(nullif(regexp_extract(substr(raw_line, 1, 1), '^\\d'), '') AS DOUBLE), 0) <> 0 END AS flag FROM customer_lines"""
)
def csv_conversions(spark, sf):
    df = table(spark, sf, "customer_lines")
    return df.select("line_no", csv_source.to_integer(F.col("raw_line")).alias("n"), csv_source.to_boolean(F.substring("raw_line", 1, 1)).alias("flag"))


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n FROM {t}" for t in TABLES)
)
def catalog_stats(spark, sf):
    out = None
    for t in TABLES:
        one = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("collection"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- maps and the engine


@query("SELECT n_nationkey AS key, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE lower(n_name) END AS value FROM nation WHERE n_regionkey <> 2")
def map_upsert_erase(spark, sf):
    """A map written, partly overwritten and partly erased, through the engine."""
    from quire.common import scratch
    from quire.plans.engine import MAP, Engine

    n = table(spark, sf, "nation")
    engine = Engine(spark, scratch(spark, "engine"))
    engine.open_table("names", MAP)
    engine.put_map("names", n.select(F.col("n_nationkey").alias("key"), F.lower("n_name").alias("value")), ["key"])
    engine.put_map("names", n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("key"), F.upper("n_name").alias("value")), ["key"])
    engine.erase_map("names", n.where("n_regionkey = 2").select(F.col("n_nationkey").alias("key")))
    return engine.view("names").rows()


@query("SELECT key_, n, low FROM (SELECT length(p_name) AS key_, count(*) AS n, min(p_size) AS low FROM part WHERE p_size <= 40 GROUP BY 1)")
def engine_aggregate(spark, sf):
    """Documents stored and partly erased, with index and materialized aggregate kept up to date."""
    from quire.common import scratch
    from quire.plans.engine import STORAGE, Engine

    docs = table(spark, sf, "part").select(F.to_json(F.struct("p_name", "p_size")).alias("document"))
    engine = Engine(spark, scratch(spark, "engine"))
    engine.open_table("parts", STORAGE)
    size = F.get_json_object("document", "$.p_size").cast("int")
    fn = ix.IndexFunction(["key_"], ["size"], lambda: [{"key_": F.length(F.get_json_object("document", "$.p_name")), "size": size}])
    engine.create_index("by_length", "parts", fn)
    engine.put("parts", docs)
    engine.create_aggregate("lengths", "by_length", ["key_"], [("n", "size", A.Count()), ("low", "size", A.Min())])
    gone = st.current(engine.read("parts")).where(size > 40).select("id")
    dirty = engine.read("by_length").where("size > 40").select("key_")
    dirty = cut(dirty)
    engine.erase("parts", gone)
    engine.refresh("lengths", dirty)
    return engine.read("lengths")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
