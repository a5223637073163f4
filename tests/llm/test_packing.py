import random

import numpy as np
import pytest

from quire.llm.packing import TOKENIZER, counter, PATTERN, faults, fit, pack, patterns, plan, token_counts, usage

SPECS = [(1, 64), (2, 500), (3, 4096)]


def check(rows, sizes, specs):
    for spec, capacity in specs:
        mine = [r for r in rows if r.spec_id == spec]
        fill, pieces = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.tokens))
        assert all(v <= capacity for v in fill.values())
        assert set(pieces) == {d for d, _ in sizes}
        for d, n in sizes:
            got = sorted(pieces[d])
            assert len(got) == max(1, -(-n // capacity)) and sum(p[2] for p in got) == n
            assert all(p[:2] == (i, i * capacity) for i, p in enumerate(got))
        total = sum(n for _, n in sizes)
        if total:
            assert sorted(fill) == list(range(len(fill)))
            yield len(fill) / max(1, -(-total // capacity))


@pytest.mark.parametrize("kind", ["mixed", "one", "long", "zero"])
def test_packing(spark, kind):
    rnd = random.Random(kind)
    size = {"mixed": lambda: int(rnd.lognormvariate(4, 1)), "one": lambda: 40, "long": lambda: rnd.randrange(5000, 20_000), "zero": lambda: rnd.choice([0, 0, 7])}[kind]
    sizes = [(i, size()) for i in range(1500 if kind == "mixed" else 200)]
    packed = pack(spark.createDataFrame(sizes, "doc_id long, tokens long"), spark.createDataFrame(SPECS, "spec_id int, capacity_tokens int"))
    ratios = list(check(packed.collect(), sizes, SPECS))
    if kind == "mixed":
        assert max(ratios) < 1.06


def test_empty_and_bad_specs(spark):
    sizes = spark.createDataFrame([], "doc_id long, tokens long")
    specs = spark.createDataFrame(SPECS, "spec_id int, capacity_tokens int")
    assert pack(sizes, specs).count() == 0 and usage(pack(sizes, specs), specs).count() == 0
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), specs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack(sizes, spark.createDataFrame([(1, 0)], "spec_id int, capacity_tokens int"))


def test_fit_and_plan():
    sizes, counts = np.array([2, 3, 5, 8]), np.array([40.0, 20.0, 30.0, 10.0])
    index, number = patterns(sizes, counts, 10)
    pats = [[(i, m) for i, m in zip(a, b) if i >= 0] for a, b in zip(index.tolist(), number.tolist())]
    assert len(pats) >= 5 and all(sum(int(sizes[i]) * n for i, n in p) == 10 and all(n > 0 for _, n in p) for p in pats)
    assert len({tuple(sorted(p)) for p in pats}) == len(pats) and all(len({i for i, _ in p}) == len(p) for p in pats)
    x = fit(index, number, counts)
    used = np.zeros(4)
    for p, n in zip(pats, x):
        for i, m in p:
            used[i] += m * n
    assert (x >= 0).all() and np.abs(used - counts).max() < 1
    rows, n = plan({2: 40, 3: 20, 5: 30, 8: 10}, 10)
    assert sum(r[2] for r in rows) == 100 and 37 <= n <= 38


def test_tokens(spark):
    count = counter(TOKENIZER, PATTERN)
    texts = ["", "Hello world", "é" * 30_000, "a" * 300_000, "some words and 123 numbers " * 2000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, tokens string")
    got = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    assert got[0] == got[5] == 0 and got[1] == 2 and got[4] == len("some words and 123 numbers".split()) * 2000 + 1
    assert [got[i] for i in range(5)] == count(texts)
    other = token_counts(df, tokenizer="/opt/tokenizers/byte_bpe_50k.json")
    assert {r.doc_id: r.tokens for r in other.where("doc_id < 2 or doc_id > 3").collect()} == {i: n for i, n in got.items() if i not in (2, 3)}


def test_faults(spark):
    sizes, specs = spark.createDataFrame([(1, 70), (2, 30), (3, 0)], "doc_id long, tokens long"), spark.createDataFrame([(1, 64)], "spec_id int, capacity_tokens int")
    assert tuple(faults(pack(sizes, specs), sizes, specs).first()) == (1, 3, 0, 0, 0)
    bad = spark.createDataFrame([(1, 0, 1, 0, 0, 64), (1, 0, 2, 0, 0, 10), (1, 1, 2, 1, 10, 20)], "spec_id int, container_id long, doc_id long, piece_no int, start_token long, tokens long")
    assert tuple(faults(bad, sizes, specs).first()) == (1, 2, 1, 2, 1)


def test_texts_around_the_limit_of_the_library():
    from quire.llm import packing

    count = counter(TOKENIZER, PATTERN)
    words = "Grüße, 12 more\t\nwords don't\u3000stop -- "
    text = words * (packing.LONG_TEXT // len(words) + 2)
    for n in (packing.LONG_TEXT - 1, packing.LONG_TEXT, packing.LONG_TEXT + 1):
        long, piece = count([text[:n]])[0], packing.LONG_TEXT
        try:
            packing.LONG_TEXT = 10 * n
            assert count([text[:n]])[0] == long
            packing.LONG_TEXT = 1
            assert count([text[:n]])[0] == long
        finally:
            packing.LONG_TEXT = piece
