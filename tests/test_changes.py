import random

from quire.operators.changes import apply_changes, current, current_documents

BASE = "id long, previous_id long, deleted boolean, commit_seq long, coll_name string, document string, doc_id int, purged string"
FEED = "new_doc_id long, old_doc_id long, deleted boolean, commit_seq long, coll_name string, new_doc string, seq string"


def brute(base, feed):
    rows = {}
    for d, p, x, s, gone in [(r[0], r[1] or 0, bool(r[2]), -1 if r[3] is None else r[3], False) for r in base] + [(r[0], r[1] or 0, bool(r[2]), -1 if r[3] is None else r[3], r[0] == r[1]) for r in feed]:
        if d:
            rows[d] = max(rows.get(d, (-2,)), (s, gone, x, p))
    kept = {d: r for d, r in rows.items() if not r[1]}
    replaced = {r[3] for r in kept.values()}
    return {(d, r[0]) for d, r in kept.items() if not r[2] and d not in replaced}


def test_random_feed(spark):
    rnd = random.Random(2)
    base = [(i, rnd.choice([0, None, rnd.randrange(1, i + 1)]), rnd.random() < 0.2, i, "c", None, 0, "x") for i in range(1, 300)]
    seq = list(range(200, 900))
    feed = []
    for s in seq:
        d = rnd.choice([7, rnd.randrange(1, 500), rnd.randrange(1, 500)])  # a third of the changes for one document
        feed.append((d, rnd.choice([0, None, d, rnd.randrange(1, 500)]), rnd.choice([True, False, False, None]), s, "c", str(s), "x"))
    feed += rnd.sample(feed, 200) + [(None, 3, False, 5000, "c", None, "x"), (0, 3, False, 5000, "c", "y", "x"), (499, 0, False, None, "c", "y", "x")]
    rnd.shuffle(feed)
    b, f = spark.createDataFrame(base, BASE), spark.createDataFrame(feed, FEED).repartition(3)
    state = apply_changes(b, f, bucket_rows=100)
    now = current(state)
    assert {(r.doc_id, r.seq) for r in now.collect()} == brute(base, feed)
    docs = current_documents(b, f, now.select("doc_id", "seq")).collect()
    assert len(docs) == now.count()
    assert apply_changes(b.limit(0), f.limit(0)).count() == 0


def test_publish_once(spark, tmp_path):
    b, f = spark.createDataFrame([], BASE), spark.createDataFrame([(1, 0, False, 1, "c", "x", "")], FEED)
    target = str(tmp_path / "state")
    assert apply_changes(b, f, target=target).count() == 1
    assert (tmp_path / "state").is_dir() and not (tmp_path / "state.staged").exists()
    try:
        apply_changes(b, f, target=target)
        raise AssertionError
    except RuntimeError:
        pass
