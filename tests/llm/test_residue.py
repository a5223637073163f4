import pytest

from quire.llm.residue import ANY, SLOT, Tree, classify, messages, open_slots, own_text, residue

CASES = {
    "slots": [
        "Hello {{name}}, welcome to {{board}}! Your account was created on {{date}}.",
        "<p>Thread ${a.b} was moved to ${c} by ${d}.</p>",
        "*|NAME|* wrote on *|DATE|*: *|TEXT|*",
        "Dear {0}, you have {1} unread messages since {2}.\n-- \nbob | likes tea",
        "Sehr geehrte/r [YOUR NAME], Ihre Bestellung [TBD] vom [DATE] ist unterwegs.",
        "Thread undefined was moved to undefined by undefined.",
        "Thread  was moved to  by .",
        "null null null",
    ],
    "error": [
        "Error 404: Not Found\nContact the administrator.",
        "Home | Forum | Search | Log in\n\n502 Bad Gateway\n\nThe server at www.x.test could not complete your request. Reference ab12.9.",
        "Traceback (most recent call last):\n  File \"/a/b.py\", line 3, in render\nKeyError: 'x'",
        "Warning: db_connect(): too many connections in /srv/a/b.php on line 437",
        "[b]Your session has expired. Please log in again to continue.[/b]",
    ],
    "script": ["JavaScript is disabled in your browser. Please enable it to view this page.", "Bitte aktivieren Sie JavaScript, um diesen Beitrag anzuzeigen.", "This site requires scripts and cookies. Switch them on in your browser and reload."],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor.", "asdf qwer asdf test", "Sample text. Sample text.", "This is a placeholder post. Replace it with your own story.", "TODO: write summary"],
}
FINE = [
    None,
    "",
    "   ",
    "[deleted]",
    "[removed by moderator]",
    "I had to enable JavaScript before the gallery showed up.",
    "In the script you write echo ${NAME} and it prints the count, works for me.",
    "The label maker came with lorem ipsum printed on the sheet.",
    "Their page said 'page not found', so I called them and it came anyway.\nError 404: Not Found",
    "> Error 404: Not Found\nThat is what I get since Monday.",
    "<blockquote>Error 404: Not Found</blockquote>",
    "Thread was great, thanks to you.",
    "None of them works.",
    "word " * 20_000,
]


def test_cases(spark):
    rows = [(t, k) for k, texts in CASES.items() for t in texts] + [(t, None) for t in FINE]
    rows += [("Error 404: Not Found", "error")] * 30  # a frequent post
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "doc_id long, text string, kind string").repartition(3)
    got = {r.doc_id: r.kind for r in residue(df).collect()}
    assert got == {i: k for i, (_, k) in enumerate(rows) if k}
    assert residue(df.limit(0)).count() == 0


def test_tree():
    tree = Tree()
    a = tree.add("the pump in hall red is broken")
    b = tree.add("the pump in hall blue is broken")
    assert a is b and " ".join(a) == f"the pump in hall {ANY} is broken"
    assert tree.add("the pump in hall red is broken today") is not a
    assert tree.add("the pump in hall red is closed") is not a  # a telling word is no variable
    assert tree.add(f"dear {SLOT} see you") is not tree.add("dear friend see you")


@pytest.mark.parametrize(("text", "kind"), [(f"read the reply here {SLOT}", "slot"), (f"i wrote {SLOT} and {SLOT}", None), ("not found", "error"), ("we found the pump", None), ("lorem", "filler")])
def test_classify(text, kind):
    assert classify(text) == kind


def test_messages():
    assert messages("Hi  there.\n~ bob | tea") == [("hi there", True)]
    assert messages("a  b  c  d  e  f") == [("a b c d e f", False)]
    assert messages("See {{x}}.")[0][0] == f"see {SLOT}"


USED = [
    # an unknown sentence that stands beside different error pages only, and one that people write
    *[(t + " The hamsters have gone home.", "error") for t in ("Error 404: Not Found.", "502 Bad Gateway.", "Error 404: Not Found.", "Internal server error.")],
    *[(t + " See you on Monday then.", None) for t in ("Error 404: Not Found.", "502 Bad Gateway.", "Error 404: Not Found.", "I painted the old shed.", "We went to the lake.", "My bike is blue.")],
    ("The hamsters have gone home.", "error"),
    # posts that consist of a sentence with one open slot, and talk about a slot
    *[(f"Hello {{{{{n}}}}}, welcome to our board!", "slots") for n in ("name", "user", "first_name")],
    ("Somebody in our {{room}} has painted the shed.", None),
    *[(f"Mails begin with {{{{name}}}} at our {c} club. They answered within a week.", None) for c in ("chess", "bike", "moss")],
]


def _kinds(spark, rows):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(3)
    return {r.doc_id: r.kind for r in residue(df).collect()}


def test_verdicts_from_use(spark):
    assert _kinds(spark, USED) == {i: k for i, (_, k) in enumerate(USED) if k}


def test_the_tree_decides(spark):
    """Posts that only the mined template tells: the sentence varies, so no single message is frequent."""
    pages = ("Error 404: Not Found.", "502 Bad Gateway.", "Internal server error.", "Error 404: Not Found.")
    rows = [(f"{page} Our keeper of the {w} machines went fishing.", "error") for page, w in zip(pages, ("red", "big", "old", "loud"), strict=True)]
    assert len(_kinds(spark, rows)) == 4
    texts = [messages(t)[1][0] for t, _ in rows]
    tree, none = Tree(), Tree(similar=1.1)
    assert len({id(tree.add(t)) for t in texts}) == 1 and len({id(none.add(t)) for t in texts}) == 4


def test_templates_made_up_later():
    """Held out: written after the rules were fixed, by no source that the rules come from; figures are in the README."""
    from tests.llm.residue_held_out import CONTENT, RESIDUE

    hit = [t for t in RESIDUE if all(classify(m) not in (None, "slot") for m, _ in messages(t))]
    wrong = [t for t in CONTENT if (got := messages(t)) and all(classify(m) not in (None, "slot") for m, _ in got)]
    assert (len(hit), len(RESIDUE), len(wrong), len(CONTENT)) == (33, 36, 3, 40)  # measured, not tuned


def test_open_slots(spark):
    rows = ["I painted the shed. {{signature}}", "{{a}} meets {{b}}", "nothing open", None, "Use %NAME_X% or ${b}. It works for me."]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {tuple(r) for r in open_slots(df).collect()} == {(0, 1, 1), (4, 1, 2)}
    assert open_slots(df.limit(0)).count() == 0


def test_nested_quotations():
    text = "[quote]" * 2000 + "x" + "[/quote]" * 2000 + "mine"
    assert own_text(text).strip() == "mine"
    assert own_text("<blockquote>a [quote]b</blockquote> own").split() == ["own"]
    assert own_text("[quote]never closed").split() == ["never", "closed"]
