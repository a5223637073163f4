import random

import pytest
from pyspark.sql import functions as F

from quire.operators import keys as K
from quire.operators.view import View

ROWS = [(a, b, c, i) for i, (a, b, c) in enumerate((a, b, c) for a in (None, "a", "ab", "b") for b in (-1, 0, 2) for c in (1.5, 2.5))]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k1 string, k2 int, k3 double, doc_id long")


def order(v):
    return (v is not None, v)


def test_ranges_against_tuples(df):
    keys = ["k1", "k2", "k3"]
    rnd = random.Random(1)
    cases = [(), ("a",), ("ab", 0), (None,), (None, 0), ("zz",), ("", 5)] + [tuple(rnd.choice(ROWS)[: rnd.randrange(1, 4)]) for _ in range(8)]
    marks = []
    for i, key in enumerate(cases):
        for name in ("equal_to", "greater_than", "less_than", "greater_equal", "less_equal"):
            marks.append((i, name, getattr(K, name)(keys, key)))
    out = df.select("doc_id", *[F.coalesce(c, F.lit(False)).alias(f"c{n}") for n, (_, _, c) in enumerate(marks)]).collect()
    for n, (i, name, _) in enumerate(marks):
        key = tuple(map(order, cases[i]))
        for r in out:
            k = tuple(map(order, ROWS[r.doc_id][: len(key)]))
            want = {"equal_to": k == key, "greater_than": k > key, "less_than": k < key, "greater_equal": k >= key, "less_equal": k <= key}[name]
            assert r[f"c{n}"] == want, (cases[i], name, ROWS[r.doc_id])


def test_view(spark, df):
    v = View(df, ["k1", "k2", "k3"])
    ids = lambda x: [r.doc_id for r in x.rows().collect()]
    assert ids(v) == sorted(range(len(ROWS)), key=lambda i: tuple(map(order, ROWS[i][:3])))
    assert ids(v.reverse()) == ids(v)[::-1]
    assert ids(v == "ab") == ids(v)[12:18] and ids("ab" < v) == ids(v)[18:] and ids(v <= ("ab", 0)) == ids(v)[:16]
    assert ids(v.select_between("a", "b")) == ids(v)[6:18]
    assert ids(v.select_between("b", "a", included=True)) == ids(v)[6:][::-1]
    assert ids(v.select(K.Prefix("a"))) == ids(v)[6:18]
    assert ids(v.select_from(("ab", 0), backward=True)) == ids(v)[:16][::-1]
    with pytest.raises(TypeError):
        v != "a"  # noqa: B015
    first = v.page(5).collect()
    assert [r.doc_id for r in first] + [r.doc_id for r in v.page(5, first[-1]).collect()] == ids(v)[:10]
    assert [r.doc_id for r in v.page_before(3, v.page(5).collect()[4]).collect()] == ids(v)[1:4][::-1]
    assert v.get("nothing") is None and v.select("nothing").empty() and v.count() == len(ROWS)
    assert v.approx_count(5) >= 5 and (v == "ab").approx_count() == 6
    dup = View(df, ["k1"])
    assert [r.doc_id for r in dup.hide_duplicates().rows().collect()] == [0, 6, 12, 18]
    assert [r.doc_id for r in dup.reverse().hide_duplicates().rows().collect()] == [23, 17, 11, 5]


def test_pushdown(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "k"))
    v = View(spark.read.parquet(str(tmp_path / "k")), ["k1", "k2"]).select_between(("a", 1), ("b", 2))
    plan = v.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_orders(spark):
    arrays = spark.createDataFrame([([2],), ([1, 5],), ([1, 4],), ([],), (None,)], "a array<int>")
    assert [r.a for r in arrays.orderBy(*K.order_by([K.KeyColumn("a", "array")])).collect()] == [None, [], [2], [1, 4], [1, 5]]
    words = spark.createDataFrame([(w,) for w in ("chamrad", "mamlas", "hrad", "brak")], "w string")
    assert [r.w for r in words.orderBy(*K.order_by([K.KeyColumn("w", "collate:cs")])).collect()] == ["brak", "hrad", "chamrad", "mamlas"]
    nums = [float("-inf"), -1.1e9, -25.21584, -4.8, -0.5, 0.0, 0.0007, 1.0, 6.0, 32.5, 12000.0, float("inf"), float("nan")]
    rows = spark.createDataFrame([(x,) for x in reversed(nums)], "x double")
    assert [str(r.x) for r in rows.orderBy(*K.order_by(["x"])).collect()] == [str(x) for x in nums]
