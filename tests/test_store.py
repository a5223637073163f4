"""Golden cases of the document store: words, buckets, indexes, versions, unique keys, maps, catalog."""

import pytest
from pyspark.sql import functions as F

from quire.cli import Shell
from quire.errors import CommitConflict, DatabaseError, DuplicateKeyError, RecordNotFound, ReferencedDocumentNotFound
from quire.operators import aggregates as A
from quire.operators import index as ix
from quire.operators import storage as st
from quire.operators.aggregate_by import aggregate_by, aggregate_runs, apply_deltas, refresh, value_group
from quire.plans.engine import INDEX, MAP, STORAGE, Engine

TEXT = ix.IndexFunction(["text"], ["length"], lambda: [{"text": F.col("document"), "length": F.octet_length("document")}])
LENGTH = ix.IndexFunction(["length"], ["text"], lambda: [{"length": F.octet_length("document"), "text": F.col("document")}])
PAIR = ix.IndexFunction(["text"], ["value"], lambda: [{"text": F.get_json_object("document", "$.t"), "value": F.get_json_object("document", "$.v").cast("int")}])


def docs(spark, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r, 0) for r in rows], "document string, previous_id long")


def pair(spark, *rows):
    return docs(spark, *[(f'{{"t":"{t}","v":{v}}}', p) for t, v, p in rows])


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


def test_buckets(spark):
    numbers = [114, 192, 228, 285, 457, 985, -1, -100, -101, 0, 99]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "doc_id long, n long").withColumn("b", value_group("n", 100))
    got = {r.b: tuple(r)[1:] for r in aggregate_by(df, ["b"], A.composite("n", c=A.Count(), s=A.Sum(), lo=A.Min(), hi=A.Max())).collect()}
    assert got == {100: (2, 306, 114, 192), 200: (2, 513, 228, 285), 400: (1, 457, 457, 457), 900: (1, 985, 985, 985), -100: (2, -101, -100, -1), -200: (1, -101, -101, -101), 0: (2, 99, 0, 99)}
    assert df.select(value_group(F.lit(-0.3), 0.5).alias("x")).first().x == -0.5


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "g", 3.0, ""), (2, "g", -4.5, "b"), (3, "g", None, ""), (4, "h", None, "a")], "doc_id long, k string, x double, t string")
    specs = [("n", "x", A.Count()), ("s", "x", A.Sum()), ("q", "x", A.Sum2()), ("f", "t", A.First()), ("l", "t", A.Last()), ("c", "t", A.GroupConcat(",")), ("a", "x", A.Avg(integer=True)), ("u", "x", A.Custom(F.size)), ("z", "x", A.Skip())]
    got = {r.k: tuple(r)[1:] for r in aggregate_by(df, ["k"], specs).collect()}
    assert got == {"g": (3, -1.5, 29.25, "", "", "b,", 0, 3), "h": (1, None, None, "a", "a", "a", None, 1)}
    assert A.revision(specs, ["k"]) != A.revision(specs[:-2], ["k"]) and A.revision([("s", "x", A.Scale(2, A.Sum()))], []) != A.revision([("s", "x", A.Scale(3, A.Sum()))], [])
    runs = spark.createDataFrame([(i, t) for i, t in enumerate("aabba")], "doc_id long, t string")
    assert [tuple(r) for r in aggregate_runs(runs, ["t"], [("n", "t", A.Count())], keys=[]).orderBy("run").collect()] == [("a", 1, 2), ("b", 2, 2), ("a", 3, 1)]
    empty = aggregate_by(df.limit(0), [], [("n", "x", A.Count()), ("s", "x", A.Sum())]).collect()
    assert [tuple(r) for r in empty] == [(0, None)]


def test_incremental_equals_full(spark):
    words = [(i, f"{'x' * (3 + i % 4)}", i * 7 % 11) for i in range(1, 30)]
    all_ = spark.createDataFrame([(i, len(t), n) for i, t, n in words], "doc_id long, k int, x int")
    specs = A.composite("x", c=A.Count(), s=A.Sum(), lo=A.Min(), hi=A.Max())
    full = lambda df: {tuple(r) for r in aggregate_by(df, ["k"], [("n", "x", A.Count()), *specs]).collect()}
    first, late, gone = F.col("doc_id") <= 20, F.col("doc_id") > 20, F.col("k") == 3
    old = aggregate_by(all_.where(first), ["k"], [("n", "x", A.Count()), *specs])
    changes = all_.where(late).withColumn("sign", F.lit(1)).unionByName(all_.where(gone).withColumn("sign", F.lit(-1)))
    exact = apply_deltas(old, changes, ["k"], specs, exact_from=all_.where(~gone)).select("k", "n", "c", "s", "lo", "hi")
    assert {tuple(r) for r in exact.collect()} == full(all_.where(~gone))
    loose = {r.k: r for r in apply_deltas(old, changes, ["k"], specs).collect()}
    assert loose[3].n == 0 and loose[3].s == 0 and loose[3].hi is not None
    fresh = refresh(old, all_.where(~gone), changes, ["k"], [("n", "x", A.Count()), *specs])
    assert {tuple(r) for r in fresh.collect()} == full(all_.where(~gone))


def test_strings_and_two_indexes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.open_table("docs", STORAGE)
    e.create_index("a", "docs", TEXT)
    e.create_index("b", "docs", LENGTH)
    e.put("docs", spark.createDataFrame([("hello",), ("world",), ("bar",), ("foo",)], "document string"))
    by = {r.document: r.id for r in e.read("docs").collect()}
    assert sorted(by.values()) == [1, 2, 3, 4]
    world = e.view("a").find("world")
    assert (world.doc_id, world.length) == (by["world"], 5)
    assert (e.view("a") == "world").documents().first().document == "world"
    assert {r.text for r in (e.view("b") == 3).rows().collect()} == {"bar", "foo"}
    before = e.snapshot()
    e.put("docs", docs(spark, ("world2", by["world"])))
    assert e.view("a").get("world") is None and e.view("a").get("world2") is not None
    assert before.read("docs").count() == 4 and e.read("docs").count() == 5
    with pytest.raises(RecordNotFound):
        e.view("a").find("world")
    with pytest.raises(ReferencedDocumentNotFound):
        e.put("docs", docs(spark, ("x", 99)))
    e.erase("docs", ids(spark, 5))
    assert e.view("a").get("world2") is None
    e.compact("docs", deleted=True)
    e.purge("docs", ids(spark, by["bar"]))
    assert e.view("b").select(3).count() == 1
    # a copy from a backup, and a second opening of the same root
    name = e.export("docs", str(tmp_path / "backup"))
    e2 = Engine(spark, str(tmp_path / "e2"))
    e2.open_table("docs", STORAGE)
    e2.restore_backup("docs", st.read_backup(spark, name))
    assert {r.id for r in e2.read("docs").collect()} == {r.id for r in e.read("docs").collect()}
    assert Engine(spark, str(tmp_path / "e")).collections["docs"].next_id == e.collections["docs"].next_id == 7
    assert e.check_storage("docs").count() == 0 and e.check_references("a").count() == 0
    assert e.vacuum() == 0


def test_versions(spark):
    rev = spark.createDataFrame([(1, 0, "hello"), (2, 0, "world"), (3, 0, "bar"), (4, 0, "foo"), (5, 3, "baz")], "id long, previous_id long, document string")
    rev = rev.withColumn("deleted", F.lit(False)).withColumn("has_value", F.lit(True))
    assert sorted(r.id for r in st.compact(rev).collect()) == [1, 2, 4, 5]
    assert sorted(r.id for r in st.compact(rev, 1).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in st.current(rev).collect()) == [1, 2, 4, 5]
    assert [r.id for r in st.select_range(rev, 4, 2).collect()] == [4, 3]
    assert st.last_id(rev).first()[0] == 5 and st.last_id(rev.limit(0)).first()[0] == 0
    assert st.get(rev, 3).first()[0] == "bar" and st.get(rev, 9).count() == 0


def test_unique(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.open_table("docs", STORAGE)
    e.create_index("u", "docs", PAIR, ix.UNIQUE)
    e.put("docs", pair(spark, ("aaa", 5, 0), ("bbb", 3, 0)))
    with pytest.raises(DuplicateKeyError):
        e.put("docs", pair(spark, ("aaa", 2, 0)))
    assert e.read("docs").count() == 2
    aaa = e.view("u").find("aaa").doc_id
    e.put("docs", pair(spark, ("aaa", 12, aaa)))
    assert {(r.text, r.value) for r in e.read("u").collect()} == {("aaa", 12), ("bbb", 3)}
    last = e.view("u").find("aaa").doc_id
    with pytest.raises(DuplicateKeyError):
        e.put("docs", pair(spark, ("ccc", 1, last), ("ddd", 2, last)))
    assert {(r.text, r.value) for r in e.read("u").collect()} == {("aaa", 12), ("bbb", 3)}


def test_hide_duplicates(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.open_table("docs", STORAGE)
    e.create_index("h", "docs", PAIR, ix.UNIQUE_HIDE_DUP)
    for row in (("aaa", 5, 0), ("bbb", 3, 0), ("aaa", 2, 0), ("aaa", 12, 1)):
        e.put("docs", pair(spark, row))
    e.put("docs", pair(spark, ("aaa", 13, 4), ("aaa", 20, 4), ("aaa", 70, 4)))
    seen = lambda: {(r.text, r.value) for r in e.view("h").rows().collect()}
    assert seen() == {("aaa", 2), ("bbb", 3)}
    e.erase("docs", ids(spark, e.view("h").find("aaa").doc_id))
    assert seen() == {("aaa", 13), ("bbb", 3)}
    e.erase("docs", ids(spark, e.view("h").find("aaa").doc_id))
    assert seen() == {("aaa", 20), ("bbb", 3)}


def test_catalog_maps_and_batches(spark, tmp_path):
    root = str(tmp_path / "e")
    e = Engine(spark, root)
    assert e.open_table("tbl1", STORAGE).kid == 0 and e.open_table("tbl2", INDEX).kid == 1 and e.open_table("tbl1").kid == 0
    with pytest.raises(DatabaseError):
        e.open_table("tbl1", INDEX)
    e = Engine(spark, root)
    assert e.name_from_id(1) == "tbl2"
    e.delete_table("tbl1")
    e = Engine(spark, root)
    assert e.find_table("tbl1") is None and e.open_table("tbl1", INDEX).kid == 0
    e.open_table("m", MAP)
    e.put_map("m", spark.createDataFrame([(42, "Hello"), (56, "World")], "key long, value string"), ["key"])
    assert [tuple(r) for r in e.view("m").rows().collect()] == [(42, "Hello"), (56, "World")]
    e.erase_map("m", spark.createDataFrame([(42,)], "key long"))
    assert e.view("m").get(42) is None and e.view("m").find(56).value == "World"
    e.set_variable("x", "1")
    assert Engine(spark, root).get_variable("x") == "1"
    e.set_variable("x", "")
    assert e.variables == {}
    other = Engine(spark, root)
    e.set_variable("y", "2")
    with pytest.raises(CommitConflict):
        other.set_variable("z", "3")
    with pytest.raises(DatabaseError):
        Engine(spark, root, read_only=True).set_variable("z", "3")
    seen = []
    e.open_table("docs", STORAGE)
    e.before_commit.append(lambda name, feed: seen.append(("before", name, feed.count())))
    e.after_commit.append(lambda name, feed: seen.append(("after", name)) or False)
    with pytest.raises(RuntimeError), e.batch() as b:
        b.put("docs", docs(spark, "gone"))
        raise RuntimeError
    assert e.read("docs").count() == 0
    with e.batch() as b:
        b.put("docs", docs(spark, "kept"))
        b.put("docs", docs(spark, ("kept more", 1)))
    assert e.read("docs").count() == 2 and ("after", "docs") in seen and e.after_commit == []
    e.replay("docs", lambda feed: seen.append(("replay", feed.count())), 2)
    assert seen[-1] == ("replay", 1)
    e.compact_files("docs")
    assert e.stats().count() == 4 and e.find_everywhere(2).first().collection == "docs"


def test_shell(spark, tmp_path):
    import io

    e = Engine(spark, str(tmp_path / "e"))
    out = io.StringIO()
    shell = Shell(e, out)
    for line in ("create docs S", "list", "use docs", "count", "first", "document 1", "set_var a b", "variables", "levels", "chkstorage", "nonsense", "use nothing", 'backup "' + str(tmp_path / "b") + '"'):
        assert shell.run(line)
    assert not shell.run("quit")
    text = out.getvalue()
    assert "docs" in text and "a=b" in text and "unknown command" in text and "KeyError" in text


def test_index_types(spark):
    df = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, None, 3)], "id long, t string, v int")
    fn = ix.IndexFunction(["k"], ["v"], lambda: [{"k": F.col("t"), "v": F.col("v")}, {"k": F.col("t"), "v": F.col("v") + 10}, {"k": F.lit("all"), "v": F.col("v"), "when": F.col("v") > 1}])
    assert {tuple(r) for r in ix.build(df, fn).collect()} == {("x", 11, 1), ("x", 12, 2), ("all", 2, 2), (None, 13, 3), ("all", 3, 3)}
    assert {tuple(r) for r in ix.build(df, fn, ix.UNIQUE_NO_CHECK).collect()} == {("x", 12, 2), ("all", 3, 3), (None, 13, 3)}
    with pytest.raises(DuplicateKeyError):
        ix.build(df, fn, ix.UNIQUE)
    assert ix.build(df.limit(0), fn).count() == 0


def test_materialized_aggregate(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.open_table("docs", STORAGE)
    e.create_index("b", "docs", LENGTH)
    specs = [("n", "length", A.Count()), ("last", "text", A.Max())]
    e.put("docs", docs(spark, "hello", "world", "bar"))
    e.create_aggregate("lazy", "b", ["length"], specs)
    e.create_aggregate("eager", "b", ["length"], specs, auto_update=True)
    keys = []
    e.observe_keys("b", lambda df: keys.extend(tuple(r) for r in df.collect()))
    rows = lambda name: {tuple(r) for r in e.read(name).collect()}
    bar = (e.view("b") == 3).rows().first().doc_id
    e.put("docs", docs(spark, ("zebra", bar), "a"))
    assert sorted(keys) == [(1, "put"), (3, "delete"), (5, "put")]
    assert rows("lazy") == {(5, 2, "world"), (3, 1, "bar")} and rows("eager") == {(5, 3, "zebra"), (1, 1, "a")}
    assert e.update("lazy") and not e.try_update("lazy") and rows("lazy") == rows("eager")
    again = Engine(spark, str(tmp_path / "e"))
    again.create_index("b", "docs", LENGTH)
    again.create_aggregate("lazy", "b", ["length"], specs[:1])
    assert {tuple(r) for r in again.read("lazy").collect()} == {(5, 3), (1, 1)}


def test_overlay(spark, tmp_path):
    root = str(tmp_path / "e")
    e = Engine(spark, root)
    e.open_table("docs", STORAGE)
    e.put("docs", docs(spark, "one"))
    with Engine(spark, root, overlay=True) as o:
        o.put("docs", docs(spark, "two"))
        assert o.read("docs").count() == 2 and Engine(spark, root).read("docs").count() == 1
    assert Engine(spark, root).version == e.version


def test_python_functions(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "id long, document string")
    fn = ix.PythonIndexFunction(["c"], [], lambda b: b.assign(c=b["document"].map(list)).explode("c").rename(columns={"id": "doc_id"})[["c", "doc_id"]], "c string, doc_id long")
    assert {tuple(r) for r in ix.build(df, fn).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    out = aggregate_by(df.withColumn("doc_id", F.col("id")), [], [("m", "id", A.Pandas(lambda x: float(x.median()), "double"))]).first()
    assert out.m == 1.5
    feed = ix.NoStorage({"t": TEXT})
    rows = feed.put(df)
    assert rows["t"].count() == 2 and feed.next_id == 3 and feed.get(1) is None
    assert feed.erase(rows, ids(spark, 1))["t"].first().text == "c"


def test_purge_and_repair_reach_all(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.open_table("docs", STORAGE)
    e.create_index("b", "docs", LENGTH)
    e.put("docs", docs(spark, "hello", "bar"))
    e.create_aggregate("n", "b", ["length"], [("n", "length", A.Count())])
    seen, keys = [], []
    e.after_commit.append(lambda name, feed: seen.extend((r.new_doc_id, r.old_doc_id, r.old_doc) for r in feed.collect()))
    e.observe_keys("b", lambda df: keys.extend(tuple(r) for r in df.collect()))
    bar = (e.view("b") == 3).rows().first().doc_id
    e.purge("docs", ids(spark, bar, 77))
    assert seen == [(bar, bar, "bar")] and keys == [(3, "delete")]
    assert e.update("n") and {tuple(r) for r in e.read("n").collect()} == {(5, 1)}
    hello = e.view("b").rows().first().doc_id
    e.indexes.clear()  # a purge that the index does not see
    e.purge("docs", ids(spark, hello))
    e.indexes["b"] = ("docs", LENGTH, ix.MULTI)
    assert e.check_references("b", repair=True).count() == 1 and e.read("b").count() == 0
    assert e.update("n") and e.read("n").count() == 0
    # a purged record that comes back from a backup is found again
    e.restore_backup("docs", spark.createDataFrame([(hello, 0, False, True, "hello")], st.SCHEMA))
    assert e.view("b").get(5).doc_id == hello


def test_batches_and_listeners(spark, tmp_path):
    from quire.plans.engine import BatchListener

    class Told(BatchListener):
        def __init__(self):
            self.calls = []

        def before_commit(self, batch):
            self.calls.append(("before", len(batch.feeds)))
            if any(n == "forbidden" for n, _ in batch.feeds):
                raise ValueError("forbidden")

        def after_commit(self, version):
            self.calls.append(("after", version))

        def on_rollback(self, batch):
            self.calls.append("rollback")

    e = Engine(spark, str(tmp_path / "e"))
    e.open_table("docs", STORAGE)
    e.open_table("m", MAP)
    e.open_table("forbidden", MAP)
    told, seen, keys = Told(), [], []
    e.batch_listeners.append(told)
    e.after_commit.append(lambda name, feed: seen.append((name, feed.count())))
    e.observe_keys("m", lambda df: keys.extend(tuple(r) for r in df.collect()))
    pairs = lambda *x: spark.createDataFrame(list(x), "key long, value string").coalesce(1)
    with e.batch() as b:
        b.put("docs", docs(spark, "one", "two"))
        b.put("docs", docs(spark, ("three", 1)))
        b.put_map("m", pairs((1, "a"), (2, "b"), (1, "c"), (None, "x")), ["key"])
    assert seen == [("docs", 2), ("docs", 1), ("m", 3)] and told.calls[0] == ("before", 3) and told.calls[1][0] == "after"
    assert sorted((tuple(r) for r in e.read("m").collect()), key=str) == [(1, "c"), (2, "b"), (None, "x")]
    assert sorted(keys, key=str) == [(1, "put"), (2, "put"), (None, "put")]
    e.put_map("m", pairs((None, "y"), (2, "d")), ["key"])
    e.erase_map("m", spark.createDataFrame([(1,)], "key long"))
    assert sorted((tuple(r) for r in e.view("m").rows().collect()), key=str) == [(2, "d"), (None, "y")] and keys[-1] == (1, "delete")
    with pytest.raises(ValueError):
        e.put_map("forbidden", pairs((1, "a")), ["key"])
    assert told.calls[-1] == "rollback" and e.read("forbidden").count() == 0
    # writers of different collections do not disturb each other, those of one do
    one, two = Engine(spark, str(tmp_path / "e")), Engine(spark, str(tmp_path / "e"))
    with one.batch() as a:
        a.put_map("m", pairs((7, "q")), ["key"])
        two.put("docs", docs(spark, "four"))
    assert one.read("docs").count() == 4 and one.view("m").get(7).value == "q"
    with pytest.raises(CommitConflict), one.batch() as a:
        a.put_map("m", pairs((8, "q")), ["key"])
        two.load()
        two.put_map("m", pairs((9, "q")), ["key"])


def test_layers_equal_whole(spark, tmp_path):
    """Many small commits leave what one index built over all gives, whatever was written together meanwhile."""
    e = Engine(spark, str(tmp_path / "e"))
    e.open_table("docs", STORAGE)
    e.create_index("multi", "docs", PAIR)
    e.create_index("last", "docs", PAIR, ix.UNIQUE_NO_CHECK)
    e.create_aggregate("n", "multi", ["text"], [("n", "value", A.Count()), ("s", "value", A.Sum())], auto_update=True)
    model, last = {}, {}
    for i in range(12):
        t, old = f"t{i % 3}", max((d for d in model), default=0) if i % 4 == 3 else 0
        new = e.put("docs", pair(spark, (t, i, old))).first().id
        if old:
            gone = model.pop(old)
            if last.get(gone[0], (None, 0))[1] == old:
                del last[gone[0]]
        model[new], last[t] = (t, i), (i, new)
    assert {tuple(r) for r in e.read("multi").select("text", "value", "doc_id").collect()} == {(t, v, d) for d, (t, v) in model.items()}
    assert {tuple(r) for r in e.read("last").select("text", "value", "doc_id").collect()} == {(t, v, d) for t, (v, d) in last.items()}
    sums = {}
    for t, v in model.values():
        sums[t] = (sums.get(t, (0, 0))[0] + 1, sums.get(t, (0, 0))[1] + v)
    assert {r.text: (r.n, r.s) for r in e.read("n").collect()} == sums
    assert all(len(c.layers) <= 8 for c in e.collections.values()) and e.check_storage("docs").count() == 0
    e.purge("docs", ids(spark, 5))
    assert {r.id for r in e.read("docs").collect()} == set(range(1, 13)) - {5}


def test_background_refresh(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.open_table("docs", STORAGE)
    e.create_index("b", "docs", LENGTH)
    e.create_aggregate("n", "b", ["length"], [("n", "length", A.Count())], auto_update=True, background=True)
    for word in ("a", "bb", "cc", "a"):
        e.put("docs", docs(spark, word))
    e.wait()
    assert {tuple(r) for r in e.read("n").collect()} == {(1, 2), (2, 2)} and e.dirty("n") is None
    e.close()


def test_definition_hash():
    def by(k):
        return A.Transform(lambda c: c * k, A.Sum())

    assert A.revision([("s", "x", by(2))], []) != A.revision([("s", "x", by(3))], []) and A.revision([("s", "x", by(2))], []) == A.revision([("s", "x", by(2))], [])


def test_key_locks():
    import threading

    from quire.errors import DeadlockError
    from quire.plans.locks import KeyLocks

    locks, a, b, got = KeyLocks(), object(), object(), []
    locks.lock(a, 1)
    locks.lock(b, 2)
    assert not locks.try_lock(b, 1) and locks.try_lock(a, 1)
    t = threading.Thread(target=lambda: (locks.lock(a, 2), got.append(2)))
    t.start()
    while not locks._waits:
        pass
    with pytest.raises(DeadlockError):
        locks.lock(b, 1)
    locks.release(b)
    t.join(5)
    assert got == [2]


def test_incremental_user_aggregate(spark):
    product = A.Incremental(F.product, lambda c, sign: F.product(F.when(sign > 0, c).otherwise(1 / c)), lambda old, change: F.coalesce(old, F.lit(1.0)) * F.coalesce(change, F.lit(1.0)))
    rows = spark.createDataFrame([("a", 2.0, 1, 1), ("a", 4.0, 1, 2), ("b", 5.0, 1, 3)], "k string, x double, sign int, doc_id long")
    old = aggregate_by(rows, ["k"], [("n", "x", A.Count()), ("p", "x", product)])
    changes = spark.createDataFrame([("a", 4.0, -1, 2), ("b", 3.0, 1, 4), ("c", 7.0, 1, 5)], "k string, x double, sign int, doc_id long")
    assert {tuple(r) for r in apply_deltas(old, changes, ["k"], [("p", "x", product)]).collect()} == {("a", 1, 2.0), ("b", 2, 15.0), ("c", 1, 7.0)}
