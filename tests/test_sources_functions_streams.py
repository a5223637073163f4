import math
from datetime import datetime

from pyspark.sql import functions as F

from quire.functions import scalar, structured
from quire.operators import aggregates as A
from quire.operators import index as ix
from quire.sources import backup, csv_source
from quire.streaming import feed


def test_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Customer Id,First Name,Unknown,Last Name,Company,Subscription Date\n1,"A ""q""",u,"L,1",C,2020-01-01\n\n2,B\n3,"two\nlines",x,y,z,w,extra\n')
    rows = {r.id: r for r in csv_source.read_csv(spark, str(path), csv_source.CUSTOMER).collect()}
    assert rows["1"].fname == 'A "q"' and rows["1"].lname == "L,1" and rows["2"].lname == "" and rows["3"].fname == "two\nlines" and rows["1"].website == ""
    df = spark.createDataFrame([(" 12x", "1.5e2z", "Yes"), ("x", "-.5", "0"), (None, None, None), ("-7", "abc", "OFF"), ("+3", "1e", "2")], "a string, b string, c string")
    got = [tuple(r) for r in df.select(csv_source.to_integer(F.col("a")), csv_source.to_float(F.col("b")), csv_source.to_boolean(F.col("c"))).collect()]
    assert got == [(12, 150.0, True), (0, -0.5, False), (0, 0.0, False), (-7, 0.0, False), (3, 1.0, True)]
    lines = spark.createDataFrame([('5,"a,b"',), (" ",)], "l string")
    out = csv_source.parse_csv(lines, "l", ["n", "t"], {"n": "n", "t": "t", "z": "z"}, types={"n": "long", "z": "double"}).collect()
    assert [tuple(r) for r in out] == [(5, "a,b", 0.0)]


def test_binary_backup(spark, tmp_path):
    rows = [(1, 0, "hello"), (2, 1, None), (3, 0, "Příšerně")]
    (tmp_path / "b_4").write_bytes(backup.encode(rows))
    got = backup.read_binary(spark, str(tmp_path / "b_4")).orderBy("id").collect()
    assert [(r.id, r.previous_id, r.document) for r in got] == rows and got[1].deleted and not got[1].has_value


def test_structured(spark):
    value = {"aaa": "bbb", "true": True, "false": False, "neg": -15, "double": 12.25, "xyz": 12, "pole": [1, 2, 3, 4, 5], "unicode": "Příšerně žluťoučký kůň", "null1": None}
    text = structured.to_json(value)
    assert structured.to_json(structured.from_json(text)) == text
    v = structured.parse(F.col("t"))
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(
        structured.as_type(v, "$.neg", "int").alias("neg"), structured.get(v, "$.aaa", "int").alias("bad"), structured.contains(v, "$.xyz", "int").alias("has"), structured.defined(v, "$.null1").alias("d1"),
        structured.defined(v, "$.none").alias("d2"), structured.is_null(v, "$.null1").alias("n"), structured.text(structured.parse(structured.text(v))).alias("again"), structured.text(v).alias("text"),
        F.size(structured.items(F.try_variant_get(v, "$.pole", "variant"))).alias("items"), F.size(structured.items(v)).alias("none"), F.size(structured.pairs(v)).alias("pairs"),
        structured.equal(structured.parse(F.lit("1")), structured.parse(F.lit("1.0"))).alias("eq"), structured.equal(v, v).alias("same"),
    ).first()
    assert (r.neg, r.bad, r.has, r.d1, r.d2, r.n, r.items, r.none, r.pairs, r.eq, r.same) == (-15, None, True, True, False, True, 5, 0, 9, False, True) and r.again == r.text
    a, m = F.array(F.lit(1), F.lit(2)), F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))
    r = df.select(
        structured.at(a, 5).alias("at"), structured.front(a).alias("f"), structured.back(a).alias("b"), structured.push_back(a, F.lit(3)).alias("push"), structured.pop_back(a).alias("pop"),
        structured.set_item(a, 3, F.lit(9)).alias("set"), structured.field(m, "z").alias("z"), structured.set_field(m, "x", F.lit(5)).alias("m"), structured.merge(m, F.create_map(F.lit("x"), F.lit(None).cast("int"), F.lit("w"), F.lit(7))).alias("g"),
    ).first()
    assert (r.at, r.f, r.b, r.push, r.pop, r.set, r.z, r.m, r.g) == (None, 1, 2, [1, 2, 3], [1], [1, 2, None, 9], None, {"y": 2, "x": 5}, {"y": 2, "w": 7})
    assert structured.structured([["a", 1], ["b", structured.UNDEFINED]]) == {"a": 1} and structured.structured([1, structured.UNDEFINED, [2]]) == [1, [2]]
    assert structured.to_json({"i": math.inf, "n": math.nan, "t": datetime(2020, 1, 2), "s": "a/b"}, escape_slash=True) == '{"i":"∞","n":null,"s":"a\\/b","t":"2020-01-02T00:00:00"}'


def test_scalar(spark):
    assert scalar.humanize(1234) == "1.2k" and scalar.humanize(5) == "5" and scalar.round_significant(98765) == 99000.0
    raw = b'a\n"\x00\xff\\'
    assert scalar.escape(raw) == 'a\\n\\"\\0\\xFF\\\\' and scalar.unescape(scalar.escape(raw)) == raw
    assert scalar.tokens('select "a b\\n" 5') == ["select", "a b\n", "5"]
    r = spark.range(1).select(scalar.significant(F.lit(98765.0)).alias("s"), scalar.byte_length(F.lit("é")).alias("b"), scalar.to_ticks(scalar.from_ticks(F.lit(1_000_001))).alias("t")).first()
    assert (r.s, r.b, r.t) == (99000.0, 2, 1_000_001)


def test_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "LAYERS", 2)
    log = str(tmp_path / "log")
    fn = ix.IndexFunction(["k"], ["x"], lambda: [{"k": F.length("document"), "x": F.ascii("document")}])
    index = feed.Versions(spark, str(tmp_path / "index"), "k int, x int, doc_id long")
    sums = feed.Versions(spark, str(tmp_path / "sums"), "k int, n long, c long, s long, hi int", ["k"])
    specs = A.composite("x", c=A.Count(), s=A.Sum(), hi=A.Max())

    def step(rows):
        spark.createDataFrame(rows, "id long, previous_id long, deleted boolean, has_value boolean, document string").coalesce(1).write.mode("append").parquet(log)
        for q in (feed.maintain_index(spark, log, index, fn, str(tmp_path / "c1")), feed.maintain_aggregate(spark, log, sums, fn, ["k"], specs, str(tmp_path / "c2"))):
            q.awaitTermination(60)
            assert q.exception() is None

    step([(1, 0, False, True, "aa"), (2, 0, False, True, "b"), (3, 0, False, True, "cc")])
    assert {tuple(r) for r in index.read().collect()} == {(2, 97, 1), (1, 98, 2), (2, 99, 3)}
    step([(4, 1, False, True, "zzz"), (5, 2, True, False, None)])
    assert {tuple(r) for r in index.read().collect()} == {(2, 99, 3), (3, 122, 4)}
    got = {r.k: (r.n, r.s, r.hi) for r in sums.read().collect()}
    assert got == {2: (1, 99, 99), 1: (0, 0, 98), 3: (1, 122, 122)}
    for n in range(6, 10):  # more batches than layers: all rows are written together meanwhile
        step([(n, n - 1 if n > 6 else 4, False, True, "z" * n)])
    assert {tuple(r) for r in index.read().collect()} == {(2, 99, 3), (9, 122, 9)}
    got = {r.k: (r.n, r.s) for r in sums.read().collect()}
    assert got == {2: (1, 99), 1: (0, 0), 3: (0, 0), 6: (0, 0), 7: (0, 0), 8: (0, 0), 9: (1, 122)}
