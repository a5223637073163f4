import random
import unicodedata
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from quire import common
from quire.llm.duplicates import collisions, copies, copy_pairs

COLUMNS = "row_no long, email string, fname string, lname string, phone1 string, h string, row_id int"


def brute(row):
    texts = ["".join(c for c in (v or "").lower() if unicodedata.category(c)[0] not in "PSZC") for v in row[1:5]]
    return tuple(sorted(t for t in texts if t))


def rows(seed):
    rnd = random.Random(seed)
    base = [("Á.b@x.de", "Ann", "Lee", "(1) 2-3"), ("c@d.e", "Bo", None, ""), (None, "", " - ", None), ("q@r.s", "Straße", "Ŵ", "9"), ("x" * 20_000, "a", "b", "c")]
    noise = ["", " ", "　", " ", "\t", "\n", "\xa0", ".", "“", "‑", "'", "$"]
    out = []
    for i in range(300):
        v = list(rnd.choice(base[:2] if i % 3 == 0 else base))
        rnd.shuffle(v)
        v = [None if x is None else "".join(rnd.choice(noise) + (c.upper() if c != "ß" and rnd.random() < 0.3 else c) for c in x) if len(x) < 100 else x for x in v]
        out.append((i, *v, "clash", 1))
    return out


@pytest.mark.parametrize("hot", [50_000, 5])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)  # 5: frequent records go the broadcast way
    data = rows(hot)
    groups = defaultdict(list)
    for r in data:
        groups[brute(r)].append(r[0])
    df = spark.createDataFrame(data, COLUMNS).repartition(5)
    assert {(r.row_id, r.copies) for r in copies(df).collect()} == {(min(g), len(g)) for g in groups.values()}
    want = Counter((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert Counter((r.row_a, r.row_b) for r in copy_pairs(df).collect()) == want
    assert collisions(df).count() == 0
    # of a hash of one byte there are some: as many as md5 gives
    first = Counter(md5("\x01".join(g).encode()).digest()[:1] for g in groups)
    assert {(bytes(r.h128), r.records) for r in collisions(df, size=1).collect()} == {(b, n) for b, n in first.items() if n > 1}


def test_empty(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert copies(df).count() == copy_pairs(df).count() == 0
