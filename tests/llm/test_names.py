import random
from collections import defaultdict

from quire.llm.names import abbreviates, edits, entities, entity_pairs, linked, org_likelihood, org_words, person_keys, person_likelihood, person_words, Person

SCHEMA = "row_no long, fname string, lname string, company string, email string, phone1 string, org_id string"
#: Rows of one number name the same entity.
ROWS = [
    (1, "Katherine", "Dranlarfin", "Rimwal Dranlarstan Packaging Company"),
    (1, "Kathy", "Dranlarfin", "Rimwal Dranlarstan Packaging Co."),
    (1, "K.", "Dranlarfin", "Dranlarstan Rimwal Packaging"),
    (1, "Dranlarfin, Katherine", None, "Rimwal Dranlarztan Pkg Co"),
    (1, "DRANLARFIN", "kathreine", "RimwalDranlarstanPackaging"),
    (1, "Dr. Katherine B.", "Dranlarfin, PhD", "The Rimwal-Dranlarstan Packaging Company"),
    (2, "Robert", "Dranlarfin", "Rimwal Dranlarstan Packaging Company"),
    (2, "Bob", "Dránlarfin", "Rimwal Dranlarstan Packaging Company"),
    (3, "Katherine", "Dranlarfin", "Rimwal Dranlarstan Timber Company"),
    (4, "Katherine", "Dranlarfin", "Palfin Barbexdul Holdings Limited"),
    (4, "Katie", "Dranlarfn", "PALFIN BARBEXDLU HLDGS LIMITED"),
    (5, None, None, "Palfin Barbexdul Holdings Limited"),
    (5, "", None, "Barbexdul Palfin Holdings Ltd"),
    (6, "Zoë", "O'Brien-Smith", "Erzan Selmelgor Partners and Sons Corporation"),
    (6, "Zoe", "OBrienSmith", "Erzan Selmelgor Ptnrs & Sons Corp"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, f, ln, c, f"{i}@x.test", str(i) * 9, "clash") for i, (_, f, ln, c) in enumerate(rows)], SCHEMA)


def test_variants(spark):
    got = {(r.row_a, r.row_b) for r in entity_pairs(table(spark, ROWS)).collect()}
    want = {(i, j) for i in range(len(ROWS)) for j in range(i + 1, len(ROWS)) if ROWS[i][0] == ROWS[j][0]}
    assert got == want


def test_words_of_one_frequent_organisation_are_its_own(spark):
    own = ["Rimwal Dranlarstan", "Dranlarstan Rimwal", "Rimwal Dranlarztan", "Rimwla Dranlarstan", "Rimwal Dranlarstna", "Rimwall Dranlarstan", "Rimwal Dranlastan", "Rinwal Dranlarstan", "Rimwal Drnlarstan", "Rimwal Dranlarstaan"]
    rows = [(1, "Ann", "Torbelan", f"{o} {b}") for o in own for b in ("Packaging", "Pkg", "Packagign")] * 2
    others = ["Palfin Barbexdul", "Erzan Selmelgor", "Vexlor Tamrinda", "Bexdor Bristangal", "Quonset Hulmark", "Sildur Wexomar", "Jastep Morfinel"]
    rows += [(2 + i, "Ann", "Torbelan", f"{o} {b}") for i, o in enumerate(others) for b in ("Packaging", "Pkg")]
    df = table(spark, rows)
    groups = defaultdict(set)
    for r in entities(df).collect():
        groups[r.org_id].add(r.row_id)
    assert sorted(map(sorted, groups.values())) == sorted([i for i, r in enumerate(rows) if r[0] == k] for k in range(1, 9))


def test_family_name_of_a_frequent_person_is_no_given_name(spark):
    same = [("Katherine", "Dranlarfin"), ("Dranlarfin, Katherine", None), ("K.", "Dranlarfin"), ("Dranlarfin", "Katherine"), ("Katherine Dranlarfin", None)]
    rows = [(1, *n, "Rimwal Dranlarstan Packaging") for n in same + same[:1] * 40]
    rows += [(2 + i, f, "Dranlarfin", f"{o} Timber") for i, o in enumerate(["Palfin", "Erzan", "Vexlor", "Bexdor", "Quonset"]) for f in ("Robert", "Bob", "R.", "Robert J.", "Robert A.", "Robert C.")]
    groups = defaultdict(set)
    for r in entities(table(spark, rows)).collect():
        groups[r.org_id, r.person_id].add(r.row_id)
    assert sorted(map(sorted, groups.values())) == sorted([i for i, r in enumerate(rows) if r[0] == k] for k in range(1, 7))


def test_names_of_given_names_only():
    p = lambda *x: Person(person_words(*x), frozenset(["katherine", "dranlarfin"]))
    a, b, c = p("Katherine", "Dranlarfin"), p("Dranlarfin, Katherine", None), p("K.", "Dranlarfin")
    assert person_likelihood(a, b) == (0.0, False) and person_likelihood(b, c) is not None and person_likelihood(a, c) is not None
    assert person_keys(a) & person_keys(b) and person_keys(b) & person_keys(c)
    assert person_likelihood(p("Thomas", "James"), p("Thomas", "Robert")) is None


def test_large_entities_in_blocks(spark):
    rows = [(1, None, None, "Vexlor Tamrinda Optics Inc")] * 40 + [(2, "Ann", "Torbelan", "Vexlor Tamrinda Optics")] * 30
    df = table(spark, rows)
    pairs = [(r.row_a, r.row_b) for r in entity_pairs(df, part=7).collect()]
    assert len(pairs) == len(set(pairs)) == 40 * 39 // 2 + 30 * 29 // 2
    groups = defaultdict(set)
    for r in entities(df).collect():
        groups[r.org_id, r.person_id].add(r.row_id)
    assert sorted(map(len, groups.values())) == [30, 40]


def test_copies_do_not_count(spark):
    rows = [(i, f, "Torbelan", "Vexlor Tamrinda Optics", "same@x.test", "1") for i, f in enumerate(["Ann", "ANN ", "Anne-Marie", None])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert {(r.row_a, r.row_b) for r in entity_pairs(df).collect()} <= {(0, 3), (1, 3), (0, 2), (1, 2)}
    assert entity_pairs(df.limit(0)).count() == 0


def test_nulls_and_long_texts(spark):
    rows = [(1, None, None, None), (2, "A", "B", ""), (3, "-", None, " "), (4, "x" * 50_000, "y", "z" * 50_000), (5, "Ann", None, "Co"), (6, "181-290-6608", "Torbelan", "Vexlor Tamrinda Optics")]
    assert entity_pairs(table(spark, rows)).count() == 0


def test_likelihoods():
    assert edits("kathreine", "katherine", 2) == 1 and edits("abc", "xyz", 2) == 3 and edits("", "ab", 2) == 2
    assert abbreviates("mfg", "manufacturing") and abbreviates("ptnrs", "partners") and not abbreviates("tech", "textiles")
    common = frozenset(["timber", "textiles", "packaging"])
    assert org_likelihood(["a", "timber"], ["a", "textiles"], common) is None
    assert org_words("The X-Y Packaging G.m.b.H.") == ["packaging"] and org_words(None) == [] and org_words("BexdorBristangalBrewingLtd") == ["bexdor", "brewing", "bristangal"]
    p = lambda *x: Person(person_words(*x), frozenset())
    assert person_likelihood(p("John", "Smithson"), p("James", "Smithson")) is None
    assert person_likelihood(p("Jim", "Smithson"), p("James", "Smitson"))[0] < 0
    assert person_words("181-290-6608", "Lee", ["ann", "x@y.z"]) == ["lee", "ann"]


def groups(df, **how):
    found = defaultdict(set)
    for r in entities(df, **how).collect():
        found[r.org_id, r.person_id].add(r.row_id)
    return sorted(map(sorted, found.values()))


def test_large_blocks_in_parts(spark):
    df = table(spark, ROWS)
    want = sorted([i for i, r in enumerate(ROWS) if r[0] == k] for k in range(1, 7))
    assert groups(df) == want and groups(df, block=2) == want
    # one block of many people, some of them variants of each other
    people = [(i, f, x, "Vexlor Tamrinda Optics") for i, (f, x) in enumerate((f, x) for x in ("Torbelan", "Tomarund", "Tolvexis") for f in ("Ann", "Boris", "Carla", "Dmitri", "Edda", "Fiona"))]
    rows = [*people, (0, "Ann", "Torbelna", "Vexlor Tamrinda Optics")]
    assert groups(table(spark, rows), block=3)[0] == [0, len(people)]


def test_many_words():
    a, b = "alpha beta gamma delta epsilon zeta".split(), "alpa beta gama delta epsilom zeta".split()
    assert org_likelihood(a, b, frozenset()) == 3 * -4.0 + 2.0  # one of the errors sounds alike
    assert org_likelihood("alphabeta gammadelta epsilonzeta".split(), a, frozenset()) == -1.0
    assert org_likelihood("alphabeta gammadelta epsilonzeta".split(), [*a[:5], "chicken"], frozenset()) is None
    assert org_likelihood(["a", "b", "c", "d", "e"], ["v", "w", "x", "y", "z"], frozenset()) is None


def test_links(spark):
    got = {r.row_id: r.links for r in linked(table(spark, [*ROWS, ROWS[0]])).collect()}
    assert [got[i] for i in range(len(ROWS) + 1)] == [6] * 6 + [1] * 2 + [0] + [1] * 6 + [6]


def noisy(rng, word):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + rng.choice("aeiourst") + word[i + 1 :]])


def labelled(seed=5, people=400):
    """Rows (entity, fname, lname, company) made by a generator of its own: syllable names, and what typists do to them."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") + rng.choice(["", "n", "r", "l"]) for _ in range(n))
    orgs = [(word(3).title(), word(3).title(), rng.choice(["Packaging", "Timber", "Optics", "Textiles"])) for _ in range(people // 8)]
    nick = [("William", "Bill"), ("Robert", "Bob"), ("Elizabeth", "Beth"), ("Thomas", "Tom"), ("Margaret", "Peggy"), ("Andrew", "Andy")]
    rows = []
    for e in range(people):
        (full, short), family, (a, b, c) = rng.choice(nick), word(4).title(), rng.choice(orgs)
        rows += [(e, full, family, f"{a} {b} {c} Ltd")] * 2
        for _ in range(3):
            first, last, org = full, family, [a, b]
            kind = rng.randrange(7)
            if kind == 0:
                last = noisy(rng, last)
            elif kind == 1:
                first = short
            elif kind == 2:
                first = full[0] + "."
            elif kind == 3:
                first, last = f"{last}, {first}", None
            elif kind == 4:
                org = [noisy(rng, a), b]
            elif kind == 5:
                org = [b, a]
            else:
                first, last = first.upper(), last.lower()
            rows.append((e, first, last, " ".join([*org, c, rng.choice(["", "Ltd", "Limited"])])))
    return rows


def test_recall_on_labelled_rows(spark):
    rows = labelled()
    got = {(r.row_a, r.row_b) for r in entity_pairs(table(spark, rows)).collect()}
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[r[0]].append(i)
    want = {(a, b) for m in members.values() for x, a in enumerate(m) for b in m[x + 1 :]}
    right = len(got & want)
    print(f"recall {right / len(want):.4f} precision {right / len(got):.4f}")
    assert right >= 0.99 * len(want) and right >= 0.99 * len(got)
