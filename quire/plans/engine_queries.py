"""Queries of the engine, files, streams and functions, each through the operator it is named for, and the SQL that gives the same
rows from the tables alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.common import cut, scratch
from quire.errors import DatabaseError, DuplicateKeyError
from quire.functions import scalar, structured
from quire.functions.codec import json_codec
from quire.operators import aggregates as A
from quire.operators import index as ix
from quire.operators import storage as st
from quire.operators.aggregate_by import aggregate_by, aggregate_runs, apply_deltas
from quire.operators.docset import DocSetStack
from quire.operators.keys import KeyColumn
from quire.operators.view import View
from quire.plans.engine import AGGREGATE, INDEX, MAP, STORAGE, BatchListener, Engine
from quire.plans.queries import _A, _B, _C, _LOG, _P, _REV, _ids, _rev, _sets, log, parts, table
from quire.sources import backup, csv_source, files
from quire.streaming import feed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def engine(spark: SparkSession) -> Engine:
    return Engine(spark, scratch(spark, "engine"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.to_json(F.struct("p_partkey", "p_name", "p_size")).alias("document"))


def _size() -> Column:
    return F.get_json_object("document", "$.p_size").cast("int")


BY_SIZE = ix.IndexFunction(["size"], ["part"], lambda: [{"size": F.get_json_object("document", "$.p_size").cast("int"), "part": F.get_json_object("document", "$.p_partkey").cast("long")}])


def stored_parts(spark: SparkSession, sf: str) -> Engine:
    e = engine(spark)
    e.open_table("parts", STORAGE)
    e.create_index("by_size", "parts", BY_SIZE)
    e.put("parts", documents(spark, sf))
    return e


def ids_where(e: Engine, condition) -> DataFrame:
    return cut(e.read("parts").where(condition).select("id"))


# --- export, import, backups, files


@query(f"WITH {_LOG} SELECT {_REV} FROM log")
def export_import(spark, sf):
    """The log imported into one storage, exported, and restored into another one that has a part of it."""
    rev = cut(_rev(log(spark, sf)))
    a, b = engine(spark), engine(spark)
    a.open_table("docs", STORAGE)
    b.open_table("docs", STORAGE)
    a.import_documents("docs", rev)
    b.import_documents("docs", rev.where("previous_id = 0"))
    b.restore_backup("docs", st.read_backup(spark, a.export("docs", scratch(spark, "export"))))
    return b.read("docs")


@query(f"WITH {_LOG} SELECT id, previous_id, document IS NULL AS deleted, document IS NOT NULL AS has_value, document FROM log WHERE id >= 100")
def backup_files(spark, sf):
    """A binary backup from id 100 on, written by many tasks and read again."""
    rev = cut(_rev(log(spark, sf)))
    name = backup.write_binary(rev, scratch(spark, "backup"), st.last_id(rev).first()[0] + 1, start=100)
    return backup.read_binary(spark, name, split_bytes=4096)


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment || ', \"' || c_nationkey || '\"' AS note, c_acctbal AS balance, '' AS missing FROM customer")
def csv_file(spark, sf):
    """Customers written as delimited files with a header, quotes and separators, and read in small splits."""
    path = scratch(spark, "csv")
    note = F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"'))
    table(spark, sf, "customer").select(F.col("c_custkey").alias("Key"), F.col("c_name").alias("Full Name"), note.alias("Note"), F.col("c_acctbal").alias("Balance"), F.lit("x").alias("Unknown")).write.csv(path, header=True, quote='"', escape='"')
    mapping = {"Key": "key", "Full Name": "name", "Note": "note", "Balance": "balance", "Nowhere": "missing"}
    return csv_source.read_csv(spark, path, mapping, types={"key": "long", "balance": "double"}, split_bytes=4096)


@query("SELECT o_orderkey AS key, o_orderpriority || ',\"' || o_orderstatus AS text, '' AS gone FROM orders")
def csv_strings(spark, sf):
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), F.col("o_orderpriority"), F.lit(',""'), F.col("o_orderstatus"), F.lit('"'))
    lines = table(spark, sf, "orders").select(line.alias("line"))
    return csv_source.parse_csv(lines, "line", ["k", "t"], {"k": "key", "t": "text", "z": "gone"}, types={"key": "long"})


@query("SELECT count(*) AS records, sum(strlen(raw_line))::BIGINT AS bytes FROM (SELECT regexp_replace(raw_line, '\\r$', '') AS raw_line FROM customer_lines WHERE length(raw_line) - length(replace(raw_line, '\"', '')) = 2 AND raw_line NOT LIKE '%' || chr(10) || '%' AND raw_line <> '')")
def split_records(spark, sf):
    """Raw records whose quotes are closed, written as files, found again by the parity of quotes in small splits."""
    path, line = scratch(spark, "raw"), F.col("raw_line")
    sound = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit(""))) == 2) & ~line.contains("\n") & (line != "")
    table(spark, sf, "customer_lines").where(sound).select("raw_line").write.text(path)
    return files.read_records(spark, path, split_bytes=2048).agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("raw_line")).alias("bytes"))


# --- maps, catalog, batches, observers


@query("SELECT n_name AS name, n_nationkey AS key FROM nation")
def map_scan(spark, sf):
    e = engine(spark)
    e.open_table("m", MAP)
    e.put_map("m", table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), ["name"])
    return e.view("m").reverse().rows()


@query("SELECT o_custkey AS key, max(o_orderkey) AS newest FROM orders GROUP BY 1")
def map_last_wins(spark, sf):
    """One put with many rows of one key: the last in the order of the frame stays."""
    e = engine(spark)
    e.open_table("m", MAP)
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("newest"))
    e.put_map("m", rows.orderBy("newest"), ["key"])
    return e.read("m")


@query("SELECT n_nationkey AS key, 'put' AS op FROM nation UNION ALL SELECT n_nationkey, 'delete' FROM nation WHERE n_regionkey = 1")
def map_observer(spark, sf):
    e, seen = engine(spark), []
    e.open_table("m", MAP)
    e.observe_keys("m", seen.append)
    n = table(spark, sf, "nation")
    e.put_map("m", n.select(F.col("n_nationkey").alias("key"), "n_name"), ["key"])
    e.erase_map("m", n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("key")))
    return seen[0].unionByName(seen[1])


@query("SELECT * FROM (VALUES (0, 'first', 'M'), (1, 'again', 'I'), (2, 'third', 'A')) t(kid, name, purpose)")
def catalog_list(spark, sf):
    """Numbers of deleted collections are used again."""
    e = engine(spark)
    for name, purpose in (("first", MAP), ("second", STORAGE), ("third", AGGREGATE)):
        e.open_table(name, purpose)
    e.delete_table("second")
    e.open_table("again", INDEX)
    return Engine(spark, e.files.root).list()


@query("SELECT 'cleared' AS name, 0::BIGINT AS n UNION ALL SELECT 'kept', count(*) FROM nation")
def catalog_clear(spark, sf):
    e = engine(spark)
    for name in ("cleared", "kept", "gone"):
        e.open_table(name, MAP)
        e.put_map(name, table(spark, sf, "nation"), ["n_nationkey"])
    e.clear_table("cleared")
    e.delete_table("gone")
    e.load()
    return spark.createDataFrame([(n, e.read(n).count()) for n in sorted(e.collections)], "name string, n long")


@query("SELECT * FROM (VALUES ('b', '2'), ('c', '4')) t(name, value)")
def variables(spark, sf):
    e = engine(spark)
    for name, value in (("a", "1"), ("b", "2"), ("c", "3"), ("c", "4"), ("a", "")):
        e.set_variable(name, value)
    return spark.createDataFrame(sorted(Engine(spark, e.files.root).variables.items()), "name string, value string")


@query("SELECT 'before' AS at, p_size AS size, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'after', p_size, count(*) FROM part WHERE p_size > 25 GROUP BY 2")
def snapshot_views(spark, sf):
    """Two views of one version stay as they were while documents are erased."""
    e = stored_parts(spark, sf)
    old = e.snapshot()
    old.indexes = dict(e.indexes)
    e.erase("parts", ids_where(e, _size() <= 25))
    one = lambda x, at: aggregate_by(x.view("by_size").df, ["size"], [("n", "part", A.Count())]).select(F.lit(at).alias("at"), "size", "n")
    return one(old, "before").unionByName(one(e, "after"))


@query("SELECT count(*) AS root, 2 * count(*) AS overlay FROM part")
def overlay_open(spark, sf):
    """Writes of an engine opened with an overlay leave the root as it is."""
    e = engine(spark)
    e.open_table("parts", STORAGE)
    e.put("parts", documents(spark, sf))
    o = Engine(spark, e.files.root, overlay=True)
    o.put("parts", documents(spark, sf))
    return Engine(spark, e.files.root).read("parts").agg(F.count(F.lit(1)).alias("root")).crossJoin(o.read("parts").agg(F.count(F.lit(1)).alias("overlay")))


@query("SELECT p_partkey AS part, 'new' AS kind FROM part UNION ALL SELECT p_partkey, 'erased' FROM part WHERE p_size > 25")
def commit_observers(spark, sf):
    """Observers of a batch with two changes of one storage see both."""
    e, seen = engine(spark), []
    e.open_table("parts", STORAGE)
    e.after_commit.append(lambda name, change: seen.append(change))
    key = lambda c: F.get_json_object(c, "$.p_partkey").cast("long").alias("part")
    with e.batch() as b:
        b.put("parts", documents(spark, sf))
        b.erase("parts", cut(b.read("parts").where(_size() > 25).select("id")))
    new = seen[0].select(key("new_doc"), F.lit("new").alias("kind"))
    return new.unionByName(seen[1].where("deleted").select(key("old_doc"), F.lit("erased").alias("kind")))


@query("SELECT count(*) FILTER (p_size > 25) AS erased, count(*) FILTER (p_size <= 25) AS kept FROM part")
def transaction_observer(spark, sf):
    """An observer before the commit refuses a batch; nothing of it stays."""
    e = stored_parts(spark, sf)

    def refuse(name: str, change: DataFrame) -> None:
        if change.where("deleted and get_json_object(old_doc, '$.p_size') <= 25").limit(1).count():
            raise ValueError("small parts stay")

    e.before_commit.append(refuse)
    try:
        e.erase("parts", ids_where(e, _size().isNotNull()))
    except ValueError:
        pass
    e.erase("parts", ids_where(e, _size() > 25))
    return e.read("parts").agg(F.count(F.when(F.col("deleted"), 1)).alias("erased")).crossJoin(e.view("by_size").df.agg(F.count(F.lit(1)).alias("kept")))


@query("SELECT p_size AS size, CASE WHEN p_size > 25 THEN 'delete' ELSE 'put' END AS op, count(*) AS n FROM part WHERE p_size > 25 OR p_size <= 5 GROUP BY 1, 2")
def key_observer(spark, sf):
    """Keys that come and go in an index, as changes are written."""
    e = stored_parts(spark, sf)
    seen: list[DataFrame] = []
    e.observe_keys("by_size", seen.append)
    e.erase("parts", ids_where(e, _size() > 25))
    e.put("parts", documents(spark, sf).where(_size() <= 5))
    return seen[0].unionByName(seen[1]).groupBy("size", "op").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LOG} SELECT id AS new_doc_id, previous_id AS old_doc_id, deleted FROM log WHERE id >= 300")
def replay_feed(spark, sf):
    e, seen = engine(spark), []
    e.open_table("docs", STORAGE)
    e.import_documents("docs", _rev(log(spark, sf)))
    e.replay("docs", seen.append, 300)
    return seen[0].select("new_doc_id", "old_doc_id", "deleted")


@query("SELECT TRUE AS failed, count(*) AS stored FROM part")
def observer_failure(spark, sf):
    """An observer that fails after a commit shows up at the next write, once."""
    e = engine(spark)
    e.open_table("parts", STORAGE)

    def fail(name: str, change: DataFrame) -> bool:
        raise RuntimeError("observer")

    e.after_commit.append(fail)
    e.put("parts", documents(spark, sf))
    e.after_commit.clear()
    failed = False
    try:
        e.set_variable("x", "1")
    except RuntimeError:
        failed = True
    e.set_variable("x", "2")
    return e.read("parts").agg(F.lit(failed).alias("failed"), F.count(F.lit(1)).alias("stored"))


@query("SELECT * FROM (VALUES ('before', 1), ('after', 1), ('rollback', 1)) t(call, n)")
def batch_listener(spark, sf):
    calls: list[str] = []

    class Told(BatchListener):
        def before_commit(self, batch):
            calls.append("before")

        def after_commit(self, version):
            calls.append("after")

        def on_rollback(self, batch):
            calls.append("rollback")

    e = engine(spark)
    e.open_table("m", MAP)
    e.batch_listeners.append(Told())
    e.put_map("m", table(spark, sf, "nation"), ["n_nationkey"])
    try:
        with e.batch() as b:
            b.put_map("m", table(spark, sf, "nation"), ["n_nationkey"])
            raise DatabaseError("given up")
    except DatabaseError:
        pass
    return spark.createDataFrame([(c,) for c in calls], "call string").groupBy("call").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT p_size AS size, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def engine_purge(spark, sf):
    """Purged records leave the index, and the aggregate after its update."""
    e = stored_parts(spark, sf)
    e.create_aggregate("sizes", "by_size", ["size"], [("n", "part", A.Count())])
    e.purge("parts", ids_where(e, _size() <= 10))
    e.update("sizes")
    return e.read("sizes")


@query("SELECT p_size AS size, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def engine_repair(spark, sf):
    """Index rows whose documents went unseen are removed by the check, and the aggregate follows."""
    e = stored_parts(spark, sf)
    e.create_aggregate("sizes", "by_size", ["size"], [("n", "part", A.Count())])
    gone = ids_where(e, _size() <= 10)
    known = dict(e.indexes)
    e.indexes.clear()
    e.purge("parts", gone)
    e.indexes.update(known)
    e.check_references("by_size", repair=True)
    e.update("sizes")
    return e.read("sizes")


@query("SELECT p_size AS size, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY 1")
def aggregate_auto_update(spark, sf):
    """An aggregate refreshed after every commit, on another thread."""
    e = stored_parts(spark, sf)
    e.create_aggregate("sizes", "by_size", ["size"], [("n", "part", A.Count())], auto_update=True, background=True)
    e.erase("parts", ids_where(e, _size() == 7))
    e.wait()
    out = e.read("sizes")
    e.close()
    return out


@query("SELECT TRUE AS first, FALSE AS second, count(DISTINCT p_size) AS sizes FROM part WHERE p_size > 7")
def aggregate_try_update(spark, sf):
    e = stored_parts(spark, sf)
    e.create_aggregate("sizes", "by_size", ["size"], [("n", "part", A.Count())])
    e.erase("parts", ids_where(e, _size() <= 7))
    first, second = e.try_update("sizes"), e.try_update("sizes")
    return e.read("sizes").agg(F.lit(first).alias("first"), F.lit(second).alias("second"), F.count(F.lit(1)).alias("sizes"))


@query("SELECT DISTINCT p_size AS size FROM part WHERE p_size BETWEEN 3 AND 9")
def dirty_keys(spark, sf):
    """Groups noted as touched, before any update."""
    e = stored_parts(spark, sf)
    e.create_aggregate("sizes", "by_size", ["size"], [("n", "part", A.Count())])
    e.erase("parts", ids_where(e, _size().between(3, 6)))
    e.erase("parts", ids_where(e, ~F.col("deleted") & _size().between(7, 9)))
    return e.dirty("sizes")


@query("SELECT substr(p_name, 1, 3) AS start, count(*) AS n FROM part GROUP BY 1")
def reindex_on_revision(spark, sf):
    """A changed index function builds the index anew; documents that came while no index was open are caught up with."""
    e = engine(spark)
    e.open_table("parts", STORAGE)
    e.put("parts", documents(spark, sf).where(_size() <= 20))
    e.create_index("i", "parts", ix.IndexFunction(["start"], [], lambda: [{"start": F.lit("old")}], revision=1))
    fn = ix.IndexFunction(["start"], [], lambda: [{"start": F.substring(F.get_json_object("document", "$.p_name"), 1, 3)}], revision=2)
    e = Engine(spark, e.files.root)
    e.create_index("i", "parts", fn)
    e = Engine(spark, e.files.root)
    e.put("parts", documents(spark, sf).where(_size() > 20))
    e.create_index("i", "parts", fn)
    return aggregate_by(e.read("i"), ["start"], [("n", "start", A.Count())])


@query("SELECT TRUE AS raised, count(*) AS stored FROM (SELECT DISTINCT p_size FROM part)")
def unique_raise(spark, sf):
    """A put that breaks a unique index fails as a whole."""
    e = engine(spark)
    e.open_table("parts", STORAGE)
    e.create_index("u", "parts", BY_SIZE, ix.UNIQUE)
    e.put("parts", table(spark, sf, "part").groupBy("p_size").agg(F.min("p_partkey").alias("p_partkey"), F.min("p_name").alias("p_name")).select(F.to_json(F.struct("p_partkey", "p_name", "p_size")).alias("document")))
    raised = False
    try:
        e.put("parts", documents(spark, sf))
    except DuplicateKeyError:
        raised = True
    return e.read("parts").agg(F.lit(raised).alias("raised"), F.count(F.lit(1)).alias("stored"))


@query(f"WITH {_LOG} SELECT (previous_id > 0) AS replaced, 'put' AS op, count(*) AS n FROM log l WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM log r WHERE r.previous_id = l.id) GROUP BY 1")
def emit_context(spark, sf):
    """An index function that looks at the predecessor and at what is done."""
    fn = ix.IndexFunction(["replaced", "op"], [], lambda: [{"replaced": F.col("previous_id") > 0, "op": F.col("op")}])
    return aggregate_by(ix.build(st.current(cut(_rev(log(spark, sf)))), fn), ["replaced", "op"], [("n", "op", A.Count())])


@query("SELECT p_brand AS brand, p_size AS size, p_name AS name, p_partkey AS doc_id FROM part")
def row_in_row(spark, sf):
    """A row appended to the row of an index, and taken out of it."""
    fn = ix.IndexFunction(["brand"], ["row"], lambda: [{"brand": F.col("p_brand"), "row": F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name"))}])
    return fn.rows(table(spark, sf, "part"), id_col="p_partkey").select("brand", "row.*", "doc_id")


@query("SELECT p_size AS size, p_partkey AS part, p_partkey AS doc_id FROM part WHERE p_size <> 3")
def nostorage_feed(spark, sf):
    """An index fed without storing documents, then without those erased."""
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct("p_partkey", "p_size")).alias("document"))
    source = ix.NoStorage({"by_size": BY_SIZE})
    rows = source.put(docs)
    return source.erase(rows, docs.where(_size() == 3).select("id"))["by_size"]


@query(f"SELECT * FROM ({_P}) WHERE price <= 1000")
def without_deleted(spark, sf):
    """A predicate of the user says which documents count as deleted."""
    return parts(spark, sf).without_deleted(F.col("price") > 1000).rows()


@query(f"SELECT *, row_number() OVER (ORDER BY p_brand, p_size, doc_id) - 1 AS \"offset\" FROM ({_P})")
def numbered_view(spark, sf):
    return parts(spark, sf).numbered()


@query(f"SELECT * FROM ({_P}) WHERE p_brand = 'Brand#22' ORDER BY p_size, doc_id LIMIT 1")
def optional_find(spark, sf):
    v = parts(spark, sf)
    found = [r for r in (v.get("Brand#22"), v.get("no such brand")) if r is not None]
    return spark.createDataFrame(found, v.df.schema)


@query("SELECT count(*) AS exact, TRUE AS close, TRUE AS adds_up FROM part WHERE p_size <= 25")
def approximate_count(spark, sf):
    """A selection over many files, estimated from a few of them."""
    path = scratch(spark, "many")
    table(spark, sf, "part").repartition(24).write.parquet(path)
    v = View(spark.read.parquet(path).withColumnRenamed("p_partkey", "doc_id"), ["p_size"]) <= 25
    n, near = v.count(), v.approx_count()
    total, before, after = v.progress(v.limit(50).tail(1)[0])
    return spark.createDataFrame([(n, abs(n - near) <= 0.5 * n, total == before + after and before <= total)], "exact long, close boolean, adds_up boolean")


@query("SELECT 1::BIGINT AS doc_id, count(*) AS found FROM (VALUES ('a'), ('b'))")
def find_everywhere(spark, sf):
    """A document number looked up in every storage."""
    e = engine(spark)
    for name in ("a", "b", "c"):
        e.open_table(name, STORAGE)
    for name in ("a", "b"):
        e.put(name, documents(spark, sf))
    return e.find_everywhere(1).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("found"))


@query("SELECT count(*) AS n, 1 AS folders, TRUE AS fewer FROM part")
def compact_files(spark, sf):
    """Physical compaction: the same rows in one folder, with fewer files."""
    e = engine(spark)
    e.open_table("parts", STORAGE)
    for rest in range(3):
        e.put("parts", documents(spark, sf).where(_size() % 3 == rest))
    before = e.stats().first()
    e.compact_files("parts")
    after = e.stats().first()
    return e.read("parts").agg(F.count(F.lit(1)).alias("n"), F.lit(after.folders).alias("folders"), F.lit(after.files < before.files).alias("fewer"))


@query("SELECT * FROM (VALUES ('added', 1), ('removed', 2)) t(change, n)")
def file_changes(spark, sf):
    """Folders by which two versions of a collection differ: rows and keys of a layer, and the rows written anew."""
    e = engine(spark)
    e.open_table("m", MAP)
    e.put_map("m", table(spark, sf, "nation"), ["n_nationkey"])
    first = e.version
    e.compact_files("m")
    return e.file_changes(first, e.version).groupBy("change").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"WITH {_LOG} SELECT id, 'repeated id' AS problem FROM log WHERE previous_id = 0 UNION ALL SELECT id + 1000000, 'predecessor is later' FROM log WHERE previous_id = 0 UNION ALL SELECT -id, 'id not positive' FROM log WHERE previous_id = 0")
def check_storage(spark, sf):
    """A log with planted faults."""
    rev = cut(_rev(log(spark, sf)))
    first = rev.where("previous_id = 0")
    bad = first.unionByName(first.withColumn("id", F.col("id") + 1_000_000).withColumn("previous_id", F.col("id") + 1)).unionByName(first.withColumn("id", -F.col("id")).withColumn("previous_id", F.lit(None).cast("long")))
    e = engine(spark)
    e.open_table("docs", STORAGE)
    with e.batch() as b:
        b.replace("docs", rev.unionByName(bad))
    return e.check_storage("docs")


# --- streams


def _stream_log(spark, sf) -> str:
    path = scratch(spark, "log")
    rev = cut(_rev(log(spark, sf)))
    half = rev.agg(F.max("id")).first()[0] // 2
    rev.where(F.col("id") <= half).coalesce(1).write.parquet(path)
    rev.where(F.col("id") > half).coalesce(1).write.mode("append").parquet(path)
    return path


_CURRENT = f"WITH {_LOG}, c AS (SELECT * FROM log l WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM log r WHERE r.previous_id = l.id))"
_K = ix.IndexFunction(["k"], [], lambda: [{"k": F.get_json_object("document", "$.k").cast("int")}])


@query(f"{_CURRENT} SELECT (document->>'$.k')::INT AS k, id AS doc_id FROM c")
def stream_index(spark, sf):
    """An index kept up to date by a stream over the log."""
    path = _stream_log(spark, sf)
    out = feed.Versions(spark, scratch(spark, "index"), "k int, doc_id long")
    q = feed.maintain_index(spark, path, out, _K, scratch(spark, "stream"))
    q.awaitTermination()
    return out.read()


@query(f"WITH {_LOG} SELECT (document->>'$.k')::INT AS k, sum(s)::BIGINT AS n FROM (SELECT document, 1 AS s FROM log WHERE NOT deleted UNION ALL SELECT o.document, -1 FROM log n JOIN log o ON o.id = n.previous_id WHERE o.document IS NOT NULL AND NOT o.deleted) GROUP BY 1")
def stream_aggregate(spark, sf):
    """Counts kept by deltas of a stream over the log; erased documents count off once, replaced ones too."""
    path = scratch(spark, "log")
    rev = cut(_rev(log(spark, sf)).withColumn("document", F.when(~F.col("deleted"), F.col("document"))))
    rev.coalesce(1).write.parquet(path)
    out = feed.Versions(spark, scratch(spark, "sums"), "k int, n long, c long", ["k"])
    q = feed.maintain_aggregate(spark, path, out, _K, ["k"], [("c", "k", A.Count())], scratch(spark, "stream"))
    q.awaitTermination()
    return out.read().select("k", "n")


# --- aggregates


@query("SELECT o_orderstatus AS status, count(*) FILTER (o_orderkey % 10 <> 0) AS n, bit_xor(o_orderkey) FILTER (o_orderkey % 10 <> 0) AS mark FROM orders GROUP BY 1")
def agg_incremental_user(spark, sf):
    """A user's aggregate that includes and excludes: the exclusive or of keys."""
    mark = A.Incremental(F.bit_xor, lambda c, sign: F.bit_xor(c), lambda old, change: F.coalesce(old, F.lit(0)).bitwiseXOR(F.coalesce(change, F.lit(0))))
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("doc_id"))
    late, gone = F.col("doc_id") % 10 == 1, F.col("doc_id") % 10 == 0
    old = aggregate_by(o.where(~late), ["status"], [("n", "doc_id", A.Count()), ("mark", "doc_id", mark)])
    changes = o.where(late).withColumn("sign", F.lit(1)).unionByName(o.where(gone).withColumn("sign", F.lit(-1)))
    return apply_deltas(old, changes, ["status"], [("mark", "doc_id", mark)])


@query("""WITH a AS (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS b FROM events),
    r AS (SELECT *, sum(CASE WHEN b IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS run FROM a)
    SELECT event_type, run::BIGINT AS run, count(*) AS n, min(event_id) AS first FROM r GROUP BY 1, 2""")
def agg_runs_whole(spark, sf):
    """Runs in one order over all events, which no task sees as a whole."""
    df = table(spark, sf, "events").withColumnRenamed("event_id", "doc_id")
    return aggregate_runs(df, ["event_type"], [("n", "doc_id", A.Count()), ("first", "doc_id", A.Min())], keys=[])


@query("SELECT l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def agg_skip(spark, sf):
    df = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    return aggregate_by(df, ["l_returnflag"], A.aggregate_rows(["l_tax", "l_quantity", "l_discount"], [A.Skip(), A.Max(), A.Skip()]))


@query("SELECT p_size AS size, sum(p_partkey * 3)::BIGINT AS total FROM part GROUP BY 1")
def aggregate_redefined(spark, sf):
    """An aggregate whose definition differs only in a captured value is built anew."""
    e = stored_parts(spark, sf)
    for by in (2, 3):
        e = Engine(spark, e.files.root)
        e.create_index("by_size", "parts", BY_SIZE)
        e.create_aggregate("sums", "by_size", ["size"], [("total", "part", A.Transform(lambda c, by=by: c * by, A.Sum()))])
    return e.read("sums")


# --- sets and order


@query(f"SELECT id FROM ({_C}) WHERE id IN (({_A}) INTERSECT ({_B})) OR id NOT IN (({_A}) UNION ({_B}))")
def set_xor_inverted(spark, sf):
    """(a XOR NOT b) AND c: one operand of XOR is inverted."""
    a, b, c = _sets(spark, sf)
    return _ids(DocSetStack().push(a).push(b).NOT().XOR().push(c).AND().pop())


@query(f"SELECT count(*) AS top, TRUE AS empty_top, FALSE AS empty, TRUE AS cleared FROM ({_A})")
def set_stack(spark, sf):
    a, b, _ = _sets(spark, sf)
    s = DocSetStack().push(a).push(a).NOT().push(a).AND()
    empty_top = s.is_top_empty()
    s.pop()
    s.push(b)
    s.pop()
    empty, top = s.empty(), s.top().df.count()
    s.clear()
    return spark.createDataFrame([(top, empty_top, empty, s.empty())], "top long, empty_top boolean, empty boolean, cleared boolean")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25")
def set_sorted(spark, sf):
    """A set pushed in any order comes out in order of ids."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"))
    return DocSetStack().push_unsorted(o, "o_orderkey").pop().all_items().limit(25).select("id")


@query("SELECT name, doc_id FROM (SELECT c_name || chr(97 + (c_custkey * 7 % 26)::INT) AS tail, CASE c_custkey % 4 WHEN 0 THEN 'hrad' WHEN 1 THEN 'chamrad' WHEN 2 THEN 'čáp' ELSE 'cena' END AS name, c_custkey AS doc_id FROM customer) ORDER BY name COLLATE cs, doc_id LIMIT 120")
def sort_collated(spark, sf):
    """The order of a language: Czech sorts ch after h, and č after c."""
    kind = F.col("c_custkey") % 4
    name = F.when(kind == 0, "hrad").when(kind == 1, "chamrad").when(kind == 2, "čáp").otherwise("cena")
    df = table(spark, sf, "customer").select(name.alias("name"), F.col("c_custkey").alias("doc_id"))
    return View(df, [KeyColumn("name", "collate:cs")]).limit(120)


# --- functions


@query("SELECT doc_id, strlen(text) AS bytes, text AS again FROM documents")
def utf8_codec(spark, sf):
    b = scalar.utf8(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.octet_length(b).cast("long").alias("bytes"), scalar.from_utf8(b).alias("again"))


@query("SELECT o_orderkey, round(round(o_totalprice / 10.0 ** (floor(log10(o_totalprice)) - 1)) * 10.0 ** (floor(log10(o_totalprice)) - 1), 4) AS short, CASE WHEN o_totalprice >= 1e6 THEN printf('%.1fM', o_totalprice / 1e6) WHEN o_totalprice >= 1e3 THEN printf('%.1fk', o_totalprice / 1e3) ELSE printf('%.1f', o_totalprice) END AS human FROM (SELECT o_orderkey, o_totalprice + 0.0123 AS o_totalprice FROM orders)")
def display_numbers(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") + 0.0123).alias("p"))
    return o.select("o_orderkey", F.round(scalar.significant(F.col("p")), 4).alias("short"), scalar.humanized(F.col("p")).alias("human"))


@query("SELECT vec_id, 7.5::DOUBLE AS set_, 1.5::DOUBLE AS padded, len(embedding) + 5 AS size, embedding[3]::DOUBLE AS third, NULL::DOUBLE AS beyond FROM embeddings")
def array_edit(spark, sf):
    """Items set within an array, and beyond its end, where the gap is filled."""
    a = F.col("embedding").cast("array<double>")
    n = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.size("embedding")).first()[0]
    longer = structured.set_item(structured.set_item(a, 1, F.lit(7.5)), n + 4, F.lit(9.5), F.lit(1.5))
    return table(spark, sf, "embeddings").select("vec_id", structured.at(longer, 1).alias("set_"), structured.at(longer, n + 2).alias("padded"), F.size(longer).cast("long").alias("size"), structured.at(longer, 2).alias("third"), structured.at(longer, n + 9).alias("beyond"))


@query("SELECT event_id, 'x' AS a, event_type AS b, NULL::VARCHAR AS c, 2 AS size FROM events")
def map_edit(spark, sf):
    """Fields set, replaced and, by a merge with null, deleted."""
    m = F.create_map(F.lit("a"), F.lit("old"), F.lit("c"), F.lit("gone"))
    m = structured.set_field(m, "a", F.lit("x"))
    m = structured.merge(m, F.create_map(F.lit("b"), F.col("event_type"), F.lit("c"), F.lit(None).cast("string")))
    return table(spark, sf, "events").select("event_id", *[structured.field(m, k).alias(k) for k in "abc"], F.size(m).alias("size"))


@query("SELECT event_id, (props->>'$.k')::INT = 7 AS same, FALSE AS other_type FROM events")
def json_equal(spark, sf):
    v = structured.parse(F.col("props"))
    return table(spark, sf, "events").select("event_id", structured.equal(v, structured.parse(F.lit('{"k": 7}'))).alias("same"), structured.equal(v, structured.parse(F.lit('{"k": 7.0}'))).alias("other_type"))


@query("SELECT event_id, 'k' AS key, props->>'$.k' AS value, '[undefined]' AS missing FROM events")
def json_pairs(spark, sf):
    v = structured.parse(F.col("props"))
    missing = structured.to_string(F.try_variant_get(v, "$.none", "variant"))
    return table(spark, sf, "events").select("event_id", F.explode(structured.pairs(v, "string")).alias("key", "value"), missing.alias("missing"))


@query("SELECT e.event_id, t.kind FROM events e, (VALUES (0, 'eof'), (1, 'key'), (2, 'colon'), (3, 'comma'), (4, 'keyword'), (5, 'dupkey'), (6, 'character'), (7, 'number'), (8, 'unknown'), (9, NULL)) t(n, kind) WHERE t.n = e.event_id % 10")
def json_errors(spark, sf):
    """Documents broken in ten ways; the kind of error of each."""
    t = F.col("props")
    broken = [F.concat(F.lit("["), t), F.replace(t, F.lit('"k"'), F.lit("k")), F.replace(t, F.lit(":"), F.lit(" ")), F.concat(F.lit("["), t, F.lit(" "), t, F.lit("]")), F.concat(F.lit("[truth, "), t, F.lit("]")), F.concat(F.lit('{"a": 1, "a": '), t, F.lit("}")), F.concat(F.lit('["\\x", '), t, F.lit("]")), F.concat(F.lit("[1.2.3, "), t, F.lit("]")), F.concat(F.lit("[@, "), t, F.lit("]"))]
    text = t
    for i, b in enumerate(broken):
        text = F.when(F.col("event_id") % 10 == i, b).otherwise(text)
    return table(spark, sf, "events").select("event_id", structured.json_error(text).alias("kind"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def codec_documents(spark, sf):
    """Rows of a user's own schema stored as documents and read back; the codec says which count as deleted."""
    codec = json_codec("c_custkey long, c_name string, c_acctbal double", lambda t: F.get_json_object(t, "$.c_acctbal").cast("double") < 0)
    e = engine(spark)
    e.open_table("customers", STORAGE)
    e.put("customers", codec.documents(table(spark, sf, "customer")))
    return codec.rows(e.read("customers").select("document"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
