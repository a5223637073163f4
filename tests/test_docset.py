import random
from collections import Counter

import pytest

from quire.operators.docset import DocSet, DocSetStack

UNIVERSE = range(12)


def make(spark, ids):
    return DocSet.of(spark.createDataFrame([(i,) for i in ids], "doc_id long"))


def test_golden(spark):
    s = DocSetStack()
    s.push(make(spark, range(1, 11))).push(make(spark, [3, 5, 1, 6, 5])).NOT().AND()
    s.push(make(spark, [3, 12, 0, 33])).push(make(spark, [5, 12, 11, 33])).XOR().OR()
    assert [r.id for r in s.all_items().collect()] == [0, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    assert not s.is_top_empty() and not s.empty()
    s.clear()
    assert s.empty()


def test_random_expressions(spark):
    rnd = random.Random(3)
    for _ in range(6):
        stack, model = DocSetStack(), []
        for _ in range(3):
            ids = [rnd.choice(UNIVERSE) for _ in range(rnd.randrange(8))]
            stack.push(make(spark, ids))
            model.append((Counter(ids), False))
            if rnd.random() < 0.4:
                stack.NOT()
                model[-1] = (model[-1][0], True)
        for _ in range(2):
            op = rnd.choice(["AND", "OR", "XOR"])
            getattr(stack, op)()
            (b, nb), (a, na) = model.pop(), model.pop()
            if op == "XOR":
                model.append(((a - b) + (b - a), na != nb))
            elif op == "AND":
                model.append(((a | b, True) if na and nb else (b - a, False) if na else (a - b, False) if nb else (a & b, False)))
            else:
                model.append(((a & b, True) if na and nb else (a - b, True) if na else (b - a, True) if nb else (a | b, False)))
        got, want = stack.pop(), model.pop()
        assert got.inverted == want[1] and Counter(r.id for r in got.df.collect()) == want[0]


def test_values_and_lists(spark):
    a = DocSet.of(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, v string"), value="v")
    b = DocSet.of(spark.createDataFrame([(2, "z"), (3, "w")], "doc_id long, v string"), value="v")
    assert {tuple(r) for r in a.and_(b).all_items().collect()} == {(2, "z")}
    assert {tuple(r) for r in a.or_(b, lambda x, y: x).all_items().collect()} == {(1, "x"), (2, "y"), (3, "w")}
    docs = spark.createDataFrame([(2, "two")], "id long, document string")
    assert {(r.id, r.document) for r in a.list(docs).collect()} == {(1, None), (2, "two")}
    assert (~a).list(docs).count() == 0 and not (~a).is_empty()
    with pytest.raises(ValueError, match="inverted"):
        (~a).all_items()
