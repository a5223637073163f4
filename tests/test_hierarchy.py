import random

import pytest

from quire.common import stored
from quire.operators import hierarchy as h
from quire.operators.hierarchy import ancestors, descendant_counts, descendants, hierarchy, path_pieces


def brute(parent):
    out = {}
    for v in parent:
        x, d, seen = v, 0, []
        while x in parent and parent[x] in parent and x not in seen:
            seen.append(x)
            x, d = parent[x], d + 1
        out[v] = (min(seen[seen.index(x) :]), -1) if x in seen else (x, d)
    return out


def forest(n, far, seed, cycles=3):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1, 50 * n), n)
    if not far:
        ids.sort()
    parent = {ids[0]: 0}
    for i in range(1, n):
        parent[ids[i]] = rnd.choice([0, 10**7, ids[i - 1], ids[i - 1], ids[i - 1], ids[rnd.randrange(max(0, i - 5), i)]])
    for _ in range(cycles):
        a = rnd.choice(ids)
        parent[a] = rnd.choice([a, *[v for v in ids if parent[v] == a][:1]])
    return parent


@pytest.mark.parametrize(("far", "bits", "base", "bucket"), [(False, 5, 10, 50), (True, 3, 20, 60), (True, 30, 10**6, 10), (True, 1, 5, 8)])
def test_random_forests(spark, far, bits, base, bucket):
    parent = forest(400, far, bits)
    rows = [(v, p or None, "x", 0) for v, p in parent.items()] + [(v, p, "y", 1) for v, p in list(parent.items())[:50]]
    df = spark.createDataFrame(rows, "id long, previous_id long, root_id string, depth int")
    got = {r.id: (r.root_id, r.depth) for r in hierarchy(df, bits=bits, base=base, bucket=bucket).collect()}
    assert got == brute(parent)


@pytest.mark.parametrize(("bits", "base", "bucket"), [(4, 5, 8), (6, 30, 20), (1, 5, 8), (15, 10, 16)])
def test_cycles_over_blocks(spark, bits, base, bucket):
    rnd = random.Random(bits)
    parent = {100: 200, 200: 40000, 40000: 100}
    free = rnd.sample(range(1000, 1600), 400) + rnd.sample(range(50_000, 10**6), 200)
    for size in (2, 3, 7, 40, 120):
        ring, free = free[:size], free[size:]
        if size % 2:  # in runs of neighbours, whose smallest ids are no exits
            ring.sort()
            ring = ring[size // 3 :] + ring[: size // 3][::-1]
        parent |= dict(zip(ring, ring[1:] + ring[:1]))
    for v in free:
        parent[v] = rnd.choice([*parent, *list(parent)[-3:] * 50])
    df = spark.createDataFrame(list(parent.items()), "id long, previous_id long")
    assert {r.id: (r.root_id, r.depth) for r in hierarchy(df, bits=bits, base=base, bucket=bucket).collect()} == brute(parent)


def test_star_chain_and_empty(spark):
    parent = {1: 0, **{v: 1 for v in range(2, 500)}, **{v + 1000: v for v in range(2, 300)}}
    df = spark.createDataFrame(list(parent.items()), "id long, previous_id long")
    assert {r.id: (r.root_id, r.depth) for r in hierarchy(df, bits=2, base=5, bucket=16).collect()} == brute(parent)
    chain = {v: v - 1 for v in range(1, 2000)}
    df = spark.createDataFrame(list(chain.items()), "id long, previous_id long")
    assert {r.id: r.depth for r in hierarchy(df, bits=6, base=5).collect()} == {v: v - 1 for v in chain}
    none = spark.createDataFrame([(None, 5), (None, None)], "id long, previous_id long")
    assert hierarchy(none).count() == 0 and path_pieces(none).count() == 0


def test_paths(spark):
    parent = forest(200, False, 9)
    df = spark.createDataFrame(list(parent.items()), "id long, previous_id long")
    rows = {r.id: r for r in path_pieces(df, bits=5, base=10).collect()}
    assert set(rows) == set(parent)
    member = {(r.piece_id, r.position): v for v, r in rows.items() if r.depth >= 0}
    for v, (_, depth) in brute(parent).items():
        r = rows[v]
        if depth < 0:
            assert r.depth == -1 and r.piece_id is None
            continue
        path, piece, place = [], r.piece_id, r.position
        while piece is not None:
            path = [member[piece, i] for i in range(place + 1)] + path
            head = rows[member[piece, 0]]
            piece, place = head.from_piece, head.from_position
        assert len(path) == depth + 1 and path[-1] == v and all(parent[b] == a for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("span", [3, 1024])
def test_ancestors_and_descendants(spark, monkeypatch, span):
    monkeypatch.setattr(h, "SPAN", span)
    parent = forest(150, False, 3)
    df = spark.createDataFrame(list(parent.items()), "id long, previous_id long")
    pieces = stored(path_pieces(df, bits=5, base=10), "pieces")
    asked = pieces.where("id % 3 = 0").select("id")
    depth = {v: d for v, (_, d) in brute(parent).items()}
    up = set()
    for v, d in depth.items():
        x = v
        for k in range(d + 1):
            up.add((v, x, k))
            x = parent.get(x)
    assert {tuple(r) for r in ancestors(pieces, asked).collect()} == {t for t in up if t[0] % 3 == 0}
    got = [tuple(r) for r in descendants(pieces, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, v, k) for v, a, k in up if a % 3 == 0 and k}
    assert ancestors(pieces, asked.limit(0)).count() == descendants(pieces, asked.limit(0)).count() == 0


@pytest.mark.parametrize("far", [False, True])
def test_descendant_counts(spark, far):
    parent = forest(150, far, 4)
    df = spark.createDataFrame(list(parent.items()), "id long, previous_id long")
    want = {v: 0 if d >= 0 else -1 for v, (_, d) in brute(parent).items()}
    for v, (_, d) in brute(parent).items():
        x = v
        for _ in range(d):
            x = parent[x]
            want[x] += 1
    rows = descendant_counts(df, bits=5, base=10).collect()
    assert len(rows) == len(want) and {r.id: r.descendants for r in rows} == want
    assert descendant_counts(df.limit(0)).count() == 0


def test_few_changes_of_piece(spark):
    """A path along which every branching has the smallest id off the path: it stays on one piece."""
    n = 60
    rows = [(1000 + i, 999 + i if i else 0) for i in range(n)] + [(1 + i, 1000 + i) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, previous_id long")
    pieces = {r.id: r for r in path_pieces(df, bits=4, base=10).collect()}
    assert pieces[1000 + n - 1].piece_id == 1000 and pieces[1000 + n - 1].from_piece is None
    # complete binary tree: no path has more than log2 n pieces
    df = spark.createDataFrame([(i, i // 2) for i in range(1, 128)], "id long, previous_id long")
    pieces = {r.id: r for r in path_pieces(df, bits=4, base=10).collect()}
    changes = lambda p: 0 if p.from_piece is None else 1 + changes(pieces[p.from_piece])
    assert max(map(changes, pieces.values())) <= 6
