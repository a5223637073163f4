import random

from quire.llm.leakage import Items, leaks, scan_batch
from quire.llm.words import words

VOCABULARY = [f"w{i}" for i in range(40)] + ["don't", "Café", "10"]


def brute(doc, item, k):
    a, b = words(doc or ""), words(item or "")
    grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    return any(tuple(a[i : i + k]) in grams for i in range(len(a) - k + 1))


def dress(rnd, text):
    kind = rnd.randrange(6)
    parts = text.split()
    if kind == 0:
        return text.upper()
    if kind == 1:
        return "<br>\n".join("&gt; " + p for p in parts)
    if kind == 2:
        return " ".join(f"[b]{p}[/b]" if rnd.random() < 0.3 else p for p in parts)
    if kind == 3:
        return "".join(f"&#{ord(c)};" if rnd.random() < 0.2 else c for c in text)
    if kind == 4:
        return "<blockquote class='q'>" + ", ".join(parts) + "</blockquote>"
    return "   ".join(parts)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.choice([3, 12, 30, 60])))) for i in range(25)] + [(25, None), (26, "")]
    docs = []
    for d in range(300):
        text = [rnd.choice(VOCABULARY) for _ in range(rnd.randrange(40))]
        if rnd.random() < 0.6:
            w = (rnd.choice(items[:25])[1]).split()
            a = rnd.randrange(len(w))
            text[rnd.randrange(len(text) + 1) : 0] = [dress(rnd, " ".join(w[a : a + rnd.choice([6, 11, 12, 13, 40])]))]
        docs.append((d, " ".join(text), "clash"))
    docs += [(300, None, ""), (301, "", ""), (302, ("x " * 100_000) + items[3][1] + " \x00 " + items[4][1], "")]
    docs.append(docs[5])
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((x[0], y[0]) for x in docs for y in items if brute(x[1], y[1], 12))
    assert want and sorted((r.doc_id, r.item_id) for r in leaks(d, i).collect()) == want
    blocks = leaks(d, i, block_bytes=500)
    assert sorted((r.doc_id, r.item_id) for r in blocks.collect()) == want
    assert leaks(d.limit(0), i).count() == leaks(d, i.limit(0)).count() == 0


def test_reordered_passages(spark):
    text = [f"a{i}" for i in range(60)]
    item = " ".join(text)
    mixed = " ".join(text[40:60] + ["between"] + text[20:40] + ["and"] + text[0:20])
    df = lambda t: spark.createDataFrame([(1, t)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    r = leaks(df(mixed), items).first()
    assert (r.tiles, r.words, r.longest, r.coverage) == (3, 60, 20, 1.0)
    r = leaks(df(item + " " + item), items).first()
    assert (r.tiles, r.words) == (1, 60)  # the item's words are covered once only
    assert leaks(df(mixed), items, min_coverage=1.0).count() == 1 and leaks(df(" ".join(text[:30])), items, min_coverage=0.6).count() == 0


def naive_tiles(a, b, k):
    """Greedy string tiling by looking at every pair of places; ties: the first in the text, then the first diagonal."""
    used_a, used_b, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n >= k and (best is None or (-n, i, i - j) < best):
                    best = (-n, i, i - j)
        if best is None:
            return tiles
        n, i, d = -best[0], best[1], best[2]
        tiles.append((i, i - d, n))
        for x in range(n):
            used_a[i + x] = used_b[i - d + x] = True


def test_tiling_against_every_pair():
    rnd = random.Random(4)
    for k in (2, 3):
        for _ in range(150):
            letters = "ab" if rnd.random() < 0.5 else "abcd"
            texts = [" ".join(rnd.choice(letters) for _ in range(rnd.randrange(25))) for _ in range(3)]
            rows = [(i, " ".join(rnd.choice(letters) for _ in range(rnd.randrange(14)))) for i in range(3)]
            got = {(d, i): (n, w, longest) for d, i, n, w, longest in scan_batch(texts, Items(rows, k))}
            want = {(d, i): (len(t), sum(x[2] for x in t), max(x[2] for x in t)) for d, text in enumerate(texts) for i, (_, item) in enumerate(rows) if (t := naive_tiles(text.split(), item.split(), k))}
            assert got == want


def test_one_word_over_and_over():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = scan_batch(["spam " * 100_000, "x " * 5_000], Items([(7, "spam " * 300), (8, "spam " * 20_000), (9, "x y " * 100)], 12))
    assert got == [(0, 0, 1, 300, 300), (0, 1, 1, 20_000, 20_000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kilobytes
