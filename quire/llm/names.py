"""Variant spellings of people and organisations, linked by a noisy channel.

Distinct spellings are counted; the frequent, complete ones are candidates for canonical forms. A variant is compared with
the candidates that share a blocking key with it (a word, a word with one letter left out, a word with initials), and goes to
the one with the highest posterior: log of the candidate's count plus log likelihood of what was typed, be it typing errors,
abbreviations, initials, nicknames, reordered or run-together words. Organisations are resolved first, people within
their organisation. Attachments point from the less to the more canonical spelling, so they form trees; their roots are
the entities.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.common import cut, parallelism, skew_lookup, slices, spread
from quire.llm.duplicates import FIELDS, record_key
from quire.operators.hierarchy import hierarchy

# Legal forms of organisations, which need not be given.
LEGAL = set("llc gmbh plc inc incorporated corp corporation co company ltd limited ag kg ohg sa sas sarl srl spa bv nv oy ab as aps pty llp lp lllp kgaa ug ev eg se".split())
# Words that name nobody.
STOP = set("the and of und et y e".split())
# Titles, degrees and generations.
TITLES = set("mr mrs ms miss mx dr prof professor sir dame rev hon herr frau monsieur madame mme mlle sr sra dipl ing mag phd md mba msc bsc ba ma dds jd esq cpa jr snr ii iii iv".split())
# Particles of surnames.
PARTICLES = set("de d del della di da du des la le van von der den ter ten zu zur al el bin ibn mac o".split())
# Given names with their short and pet forms.
NICKNAMES = {
    k: v.split()
    for k, v in (
        line.split(": ")
        for line in """abigail: abby gail
albert: al bert bertie
alexander: alex al sandy xander
alexandra: alex sandra lexi
andrew: andy drew
anthony: tony
barbara: barb barbie babs
benjamin: ben benny benji
charles: charlie chuck chas chip
christine: chris chrissy tina
christopher: chris kit topher
cynthia: cindy cyndi
daniel: dan danny
deborah: deb debbie debby
donald: don donnie donny
dorothy: dot dottie dolly
edward: ed eddie ted teddy ned
eleanor: ellie nell nellie nora ella
elizabeth: liz lizzie beth betty betsy eliza lisa bess libby
florence: flo flossie florrie
francis: frank frankie fran
frederick: fred freddie freddy
gabriel: gabe
gregory: greg
harold: hal harry
isabella: izzy bella isa belle
jacqueline: jackie jacqui
james: jim jimmy jamie
jennifer: jen jenny jenn
john: jack johnny jon
jonathan: jon jonny nathan
joseph: joe joey
josephine: josie jo
katherine: kate kathy katie kat kit kitty
kenneth: ken kenny
lawrence: larry laurie
leonard: len lenny leo
margaret: peggy maggie meg marge margie greta
matthew: matt matty
michael: mike mick mickey micky
nathaniel: nate nat nathan
nicholas: nick nicky nico
olivia: liv livvy ollie
patricia: pat patty tricia trish
penelope: penny nell
peter: pete
philip: phil pip
raymond: ray
rebecca: becky becca
richard: dick rick ricky rich richie
robert: bob bobby rob robbie bert
ronald: ron ronnie
samuel: sam sammy
stephanie: steph steffi
steven: steve stevie
susan: sue susie suzy
thomas: tom tommy
timothy: tim timmy
victoria: vicky vicki tori vic
vincent: vince vinny vin
walter: walt wally
william: bill billy will willy liam
zachary: zach zack zac""".splitlines()
    )
}
_FORMAL: dict[str, frozenset[str]] = {}
for _k, _short in NICKNAMES.items():
    for _n in (_k, *_short):
        _FORMAL[_n] = _FORMAL.get(_n, frozenset()) | {_k}

#: A word is taken for a given name, or a common word of organisations, from these shares and numbers on; so each list is bounded.
GIVEN_SHARE, GIVEN_ROWS = 0.0005, 20
COMMON_SHARE, COMMON_FORMS = 0.01, 5
#: From these on a word of organisations is one that others may have been typed for, when organisations are counted.
KNOWN_SHARE, KNOWN_FORMS = 0.0025, 3
#: Log likelihood of one typing error, of a sound-alike letter, an abbreviation, a nickname, an initial, a missing given name.
EDIT, SOUND, SHORT, NICK, INITIAL, MISSING = -4.0, -2.0, -2.0, -1.0, -3.0, -5.0
#: By how much a candidate must beat the next where the variant leaves the given name open.
MARGIN = 0.7
#: Spellings of a block that are compared one by one in one task; larger blocks are dealt into parts, which meet in pairs.
BLOCK = 256
#: An organisation of at most so many spellings is worked off as a whole by one task; those of larger ones are dealt out by keys.
GROUP = 20_000
#: A spelling this much more frequent than typing errors of the candidate would be is no typing error.
ERROR_SHARE, ERROR_ROWS = 0.2, 10

_DEGREE = re.compile(r"\b(?:ph\.? ?d|m\.? ?b\.? ?a|[bm]\.? ?(?:sc|eng|ed|phil)|[bm]\.a|m\.d|ll\.? ?[bmd]|d\.d\.s|j\.d)\b\.?")
_SPECIAL = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ı": "i"})


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case without marks on letters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold().translate(_SPECIAL))
    return "".join(c for c in text if not unicodedata.combining(c))


def org_words(company: str | None) -> list[str]:
    """Words of an organisation's name, sorted, without legal form."""
    return list(_org_words(company)) if company else []


@lru_cache(maxsize=100_000)
def _org_words(company: str) -> tuple[str, ...]:
    if re.search(r"[a-z][A-Z]", company) and not re.search(r"\b[a-z]+[A-Z]{2,}", company) and not re.search(r"\b[a-z][A-Z]+\b", company) and re.search(r"[a-z]{2}[A-Z][a-z]{2}", company) and not re.search(r"[a-z][A-Z][a-z][A-Z]", company):
        company = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", company)  # words run together, told apart by their capitals
    text = re.sub(r"['’`´‘.*_]", "", fold(company))
    words = [w for w in re.split(r"[\W_]+", text) if w]
    out = [w for w in words if w not in LEGAL and w not in STOP and (len(w) > 1 or w.isdigit())]
    if len(out) == 1 and len(out[0]) > 14:  # run together without capitals: the legal form is the end
        for form in sorted(LEGAL, key=len, reverse=True):
            if len(form) > 2 and out[0].endswith(form) and len(out[0]) - len(form) >= 8:
                out[0] = out[0][: -len(form)]
                break
    return tuple(sorted(out))


@lru_cache(maxsize=100_000)
def _is_name(value: str | None) -> bool:
    return bool(value) and "@" not in value and sum(c.isdigit() for c in value) < 3 and any(c.isalpha() for c in value)


@lru_cache(maxsize=100_000)
def _value_words(value: str) -> tuple[str, ...]:
    if value.isascii() and value.replace(" ", "").isalpha():
        plain = tuple(value.lower().split())
        if min(map(len, plain)) > 5:  # no title or degree is that long
            return plain
    text = re.sub(r"(?<=\w)['’`´‘](?=\w)|[*_\"“”]", "", fold(value))
    text = re.sub(r"(?<=\w)[-‐-―](?=\w)", "", text)
    text = re.sub(r"(?<=\w\w\w)\.(?=\w{3})", "", text)  # a stop within a word
    return tuple(w for w in re.split(r"[\W_]+", _DEGREE.sub(" ", text)) if w)


def _untitled(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(w for w in words if w not in TITLES) or words


@lru_cache(maxsize=100_000)
def _field(value: str | None) -> tuple[str, ...]:
    """Words of one field of names."""
    return _untitled(_value_words(value)) if _is_name(value) else ()


def named_words(fname: str | None, lname: str | None, others: list[str | None]) -> tuple[tuple[str, ...], int | None]:
    """Words of a person's name, and how many of them stand in the field of given names (None where not both fields hold some);
    values that stand in the wrong field (`others`) are used where a name field holds none."""
    values = [v for v in (fname, lname) if v and v.strip()]
    odd = [v for v in values if not _is_name(v) and any(c.isalnum() for c in v)]
    values = [v for v in values if _is_name(v)]
    if odd:
        values += [v for v in others if _is_name(v)]
    words = _untitled(tuple(w for v in values for w in _value_words(v)))
    a = _field(fname)
    return words, len(a) if 0 < len(a) < len(words) and a + _field(lname) == words else None


def person_words(fname: str | None, lname: str | None, others: list[str | None] = []) -> list[str]:  # noqa: B006
    return list(named_words(fname, lname, others)[0])


letters = lru_cache(maxsize=50_000)(frozenset)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int) -> int:
    """Typing errors between `a` and `b` (insertion, deletion, replacement, swap of neighbours), or most + 1."""
    if a == b:
        return 0
    # each letter that only one of them has takes an edit; that settles most comparisons
    if abs(len(a) - len(b)) > most:
        return most + 1
    la, lb = letters(a), letters(b)
    if len(la - lb) > most or len(lb - la) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return max(len(a), len(b))
    if most == 1:  # what is left must be one letter replaced, or two swapped
        return 1 if len(a) == len(b) == 1 or (len(a) == len(b) == 2 and a[0] == b[1] and a[1] == b[0]) else 2
    # only cells near the diagonal can stay within `most`
    far, width = most + 1, len(b)
    before, row = [], [*range(most + 1), *[far] * max(0, width - most)][: width + 1]
    for i, x in enumerate(a, 1):
        last, before = before, row
        row = [far] * (width + 1)
        low, high = max(1, i - most), min(width, i + most)
        if i <= most:
            row[0] = i
        least = row[0]
        for j in range(low, high + 1):
            y = b[j - 1]
            v = before[j - 1] if x == y else 1 + min(before[j], row[j - 1], before[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and last[j - 2] + 1 < v:
                v = last[j - 2] + 1
            row[j] = v
            if v < least:
                least = v
        if least > most:
            return most + 1
    return min(row[width], most + 1)


_SOUNDS = (("ph", "f"), ("qu", "kv"), ("kw", "kv"), ("x", "ks"), ("ck", "k"), ("c", "k"), ("q", "k"), ("z", "s"), ("y", "i"), ("w", "v"), ("oe", "o"), ("ue", "u"), ("ae", "a"))


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1", r"\1", word)


@lru_cache(maxsize=200_000)
def typed(a: str, b: str) -> float | None:
    """Log likelihood that one word was typed for the other; None: it was not."""
    if a == b:
        return 0.0
    short = min(len(a), len(b))
    most = 0 if short < 4 else 1 if short < 6 else 2 if short < 12 else 3
    n = edits(a, b, most)
    if n > most:
        n = edits(sound(a), sound(b), 1) if short >= 5 else 2
        return SOUND * 2 + EDIT * n if n <= 1 else None
    return SOUND * n if sound(a) == sound(b) else EDIT * n


def abbreviates(a: str, b: str) -> bool:
    """Whether `a` shortens `b`: same first letter, its letters in order, at least two fewer."""
    if len(a) < 2 or len(b) - len(a) < 2 or a[0] != b[0]:
        return False
    left = iter(b)
    return all(c in left for c in a)


def _matched(ra: list[str], rb: list[str], common: frozenset[str]) -> float | None:
    """Best likelihood of words `ra` written one each for words `rb`, of which one at most may be shortened without being common;
    over subsets of `rb`, so the number of words is no matter. None below 5 * EDIT."""
    best: dict[tuple[int, bool], float] = {(0, False): 0.0}
    for x in ra:
        scores = []
        for j, y in enumerate(rb):
            s, shortened = typed(x, y) if not (x in common and y in common) else None, False
            if s is None and (abbreviates(x, y) and y in common or abbreviates(y, x) and x in common):
                s = SHORT
            elif s is None and (abbreviates(x, y) and len(x) <= 6 and len(y) >= 5 or abbreviates(y, x) and len(y) <= 6 and len(x) >= 5):
                s, shortened = 2 * SHORT, True  # a word that is not known for being shortened, one at most
            if s is not None:
                scores.append((1 << j, s, shortened))
        after: dict[tuple[int, bool], float] = {}
        for (used, once), total in best.items():
            for bit, s, shortened in scores:
                if not used & bit and not (once and shortened) and total + s >= 5 * EDIT:
                    k = (used | bit, once or shortened)
                    if k not in after or after[k] < total + s:
                        after[k] = total + s
        if not after:
            return None
        best = after
    return max(best.values())


def _joined(few: list[str], many: list[str]) -> float | None:
    """Best likelihood of two lists of words whose letters run together alike, in whatever order each list is joined.

    Both texts grow word by word, the shorter one first; what cannot stay within the errors that `typed` allows is left."""
    size = max(sum(map(len, few)), sum(map(len, many)))
    best = None

    def near(s: str, t: str) -> bool:
        """Whether `s` is within 3 edits of a beginning of `t`."""
        row = list(range(len(s) + 1))
        low = row[-1]
        for i, y in enumerate(t[: len(s) + 3], 1):
            before, row = row, [i]
            for j, x in enumerate(s, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            low = min(low, row[-1])
        return low <= 4  # a swap of neighbours counts twice here

    def grow(a: str, left: list[str], b: str, right: list[str]) -> None:
        nonlocal best
        if not left and not right:
            for s in (typed(a, b),):
                if s is not None and (best is None or s > best):
                    best = s
            return
        take_left = bool(left) and (len(a) <= len(b) or not right)
        for i, w in enumerate(left if take_left else right):
            if take_left:
                x, y, rest, other = a + w, b, left[:i] + left[i + 1 :], right
            else:
                x, y, rest, other = a, b + w, left, right[:i] + right[i + 1 :]
            s, t = (x, y) if len(x) <= len(y) else (y, x)
            if near(s, t) or near(t[: len(s)], s):
                grow(x, rest, y, other)

    if size and abs(sum(map(len, few)) - sum(map(len, many))) <= 3:
        grow("", few, "", many)
    return best


def org_likelihood(a: list[str], b: list[str], common: frozenset[str]) -> float | None:
    """Log likelihood that words `a` were written for organisation `b`."""
    ra, rb = list(a), list(b)
    for w in a:
        if w in rb:
            ra.remove(w)
            rb.remove(w)
    if not ra and not rb:
        return 0.0
    if len(ra) == len(rb):
        best = _matched(ra, rb, common)
        if best is not None:
            return best
    if ra and rb and len(ra) != len(rb):  # words run together or torn apart
        few, many = (ra, rb) if len(ra) < len(rb) else (rb, ra)
        if abs(sum(map(len, few)) - sum(map(len, many))) > 3:
            return None
        if len(many) > 4:
            best = _joined(few, many)
        else:
            best = None
            for p in permutations(many):
                for q in permutations(few):
                    s = typed("".join(q), "".join(p))
                    if s is not None and (best is None or s > best):
                        best = s
        return best if best is None else best - 1.0
    return None


def mender(frequent: list[str]) -> Callable[[str], str]:
    """From words, the most frequent first, what any word was written for: one of these, two of them run together, or itself."""
    known: dict[str, str] = {}
    near: dict[str, list[str]] = {}

    def seek(w: str) -> str | None:
        best = None
        for f in dict.fromkeys([*near.get(w[:1], ()), *near.get("*" + w[-2:], ())]):
            s = typed(w, f)
            if s is None and (abbreviates(w, f) or abbreviates(f, w)):
                s = 4 * EDIT
            if s is not None and (best is None or s > best[0]):
                best = (s, f)
        return None if best is None else best[1]

    for w in frequent:
        known[w] = seek(w) or w
        if known[w] == w:
            near.setdefault(w[:1], []).append(w)
            near.setdefault("*" + w[-2:], []).append(w)

    @lru_cache(maxsize=200_000)
    def mend(w: str) -> str:
        got = known.get(w) or seek(w)
        if got is None and 8 <= len(w) <= 60:
            for i in range(3, len(w) - 2):
                a, b = known.get(w[:i]), known.get(w[i:])
                if a or b:
                    a, b = a or seek(w[:i]), b or seek(w[i:])
                    if a and b:
                        return f"{a} {b}"
        return got or w

    return mend


def _common(forms: DataFrame) -> frozenset[str]:
    """Words of many organisations, which say little about which one is meant.

    Spellings of `forms` (`form`) that differ only by errors in frequent words, or by how these are shortened or run together,
    count as one organisation, so that one with very many rows does not make its own words common."""
    words = forms.select(F.explode(F.split("form", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    frequent = words.where(F.col("n") >= max(KNOWN_FORMS, KNOWN_SHARE * forms.count())).orderBy(F.desc("n"), "w")
    held = forms.sparkSession.sparkContext.broadcast([r.w for r in frequent.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mend = mender(held.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            meant = [" ".join(sorted({x for w in f.split(" ") for x in mend(w).split(" ")})) for f in texts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(meant, pa.string())], ["form", "meant"])

    meant = cut(forms.select("form").mapInArrow(run, "form string, meant string"))
    total = meant.select("meant").distinct().count()
    spread_ = meant.select(F.explode(F.split("form", " ")).alias("w"), "meant").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r.w for r in spread_.where(F.col("n") >= max(COMMON_FORMS, COMMON_SHARE * total)).collect())


class Person:
    """A spelling of a person's name, split by what is known of given names."""

    __slots__ = ("given", "initials", "family", "splits", "unsure", "words")

    def __init__(self, words: list[str], given: frozenset[str]):
        full = [w for w in words if len(w) > 1 and w not in PARTICLES]
        self.initials = [w for w in words if len(w) == 1]
        self.given = [w for w in full if w in given or w in _FORMAL]
        self.family = [w for w in full if w not in self.given]
        self.unsure = not self.family and (len(self.given) > 1 or bool(self.given and self.initials))
        if self.unsure:  # a family name that is also a given name: the last word, or any other where names are compared
            self.family = [self.given.pop()]
        self.words = full
        # a given name with an error looks like a family name: each word may be the family name, the others given names
        self.splits = [("".join(self.family), self.given)] if self.family else []
        if len(self.family) > 1:
            self.splits += [(w, self.given + [x for x in self.family if x is not w]) for w in self.family]
        if self.unsure:
            self.splits += [(w, [x for x in self.words if x is not w]) for w in self.given]

    def rank(self) -> int:
        """How complete the spelling is."""
        if not self.family:
            return 0
        if not self.given and len(self.family) < 2:
            return 2 if self.initials else 1
        return 4 if any(g in NICKNAMES or g not in _FORMAL for g in self.given) else 3


def _given(a: list[str], ia: list[str], b: list[str], ib: list[str]) -> tuple[float, bool] | None:
    """Likelihood of given names, and whether it leaves open who is meant."""
    if a and b:
        x, y = "".join(a), "".join(b)
        if x == y or a[0] == b[0]:
            return (0.0, False) if x == y else (-1.0, False)
        if len(a) > 1 and _FORMAL.get(a[0]):
            x = a[0]
        if len(b) > 1 and _FORMAL.get(b[0]):
            y = b[0]
        fx, fy = _FORMAL.get(x, frozenset([x])), _FORMAL.get(y, frozenset([y]))
        if fx & fy:
            return NICK, False
        s = typed(x, y)
        if s is not None and not (x in _FORMAL and y in _FORMAL):
            return s, False
        best = None  # an error in a nickname
        for p in fx | fy:
            for n in [p, *NICKNAMES.get(p, [])]:
                wrong = x if p in fy else y
                t = typed(wrong, n) if len(n) > 3 and wrong not in _FORMAL else None
                if t is not None and (best is None or t > best):
                    best = t
        return None if best is None else (best + NICK, True)
    if not a and not ia or not b and not ib:
        return MISSING, True
    letters = lambda g, i: {f[0] for w in g[:1] for f in (_FORMAL.get(w, frozenset()) | {w})} if g else set(i[:1])
    if letters(a, ia) & letters(b, ib):
        return INITIAL, True
    # the initial of a short form that was not written out
    nicks = lambda g: {n[0] for w in g[:1] for f in _FORMAL.get(w, ()) for n in NICKNAMES[f]}
    return (INITIAL + NICK, True) if (nicks(a) & set(ib[:1]) if a else nicks(b) & set(ia[:1])) else None


def person_likelihood(a: Person, b: Person) -> tuple[float, bool] | None:
    """Log likelihood that `a` was written for `b`, both at one organisation, and whether that leaves open who is meant."""
    best = None
    for fa, ga in a.splits:
        for fb, gb in b.splits:
            s = typed(fa, fb)
            if s is None:
                continue
            g = _given(ga, a.initials, gb, b.initials)
            if g is not None and s < EDIT and (g[1] or g[0] == NICK) and fa[:2] != fb[:2]:
                continue  # too little of the name is as it should be
            if g is not None and (best is None or s + g[0] > best[0]):
                best = (s + g[0], g[1])
    return best


@lru_cache(maxsize=20_000)
def _less(word: str) -> frozenset[str]:
    """Keys of the word and of all it becomes by leaving out one letter."""
    return frozenset(["-" + word, *("-" + word[:i] + word[i + 1 :] for i in range(len(word)))])


def org_keys(words: list[str], common: frozenset[str]) -> set[str]:
    own = sorted((w for w in words if w not in common), key=lambda w: (-len(w), w))
    keys = {"=" + " ".join(words)}
    for w in own[:2]:
        if len(w) >= 7:
            keys |= _less(w)
    for w in own:
        if len(w) >= 4:
            keys |= {f"~{sound(w)}|{x[0]}" for x in words if x != w}
    # words run together: the whole, and its two ends
    whole = [own[0] + own[1], own[1] + own[0]] if len(own) >= 2 else []
    for w in [*whole, *(w for w in own[:1] if len(w) >= 10)]:
        keys |= {"+" + w, f"+{w[:5]}..{w[-5:]}"}
    return keys


def person_keys(p: Person) -> set[str]:
    keys = set()
    for w in {*p.family, "".join(p.family), *(p.given if p.unsure else ())}:
        if len(w) >= 4:
            keys |= _less(w)
            keys.add("~" + sound(w))
            for g in [x for x in p.words if x != w][:1] if p.unsure else p.given[:1]:
                for f in _FORMAL.get(g, frozenset([g])):
                    keys |= {f"{f}|{w[:2]}", f"{f}|*{w[-2:]}"}
        else:
            keys.add("=" + w)
    return keys


def _forms(rows: list[tuple[str, int]], kind: str, words: frozenset[str]) -> list[tuple[tuple, str, int, object]]:
    """(place in the order of canonical forms, spelling, count, parsed), the most canonical first."""
    if kind == "org":
        return sorted([((-n, -len(f), f), f, n, f.split(" ")) for f, n in rows], key=lambda x: x[0])
    people = [(f, n, Person(f.split(" "), words)) for f, n in rows]
    return sorted([((-x.rank(), -n, -len(f), f), f, n, x) for f, n, x in people], key=lambda x: x[0])


@lru_cache(maxsize=200_000)
def _org_fit(a: str, b: str, common: frozenset[str]) -> float | None:
    return org_likelihood(a.split(" "), b.split(" "), common)


def _fit(kind: str, words: frozenset[str], f: str, n: int, x: object, g: str, m: int, y: object) -> tuple[float, bool] | None:
    """Posterior of `f` (`n` rows, parsed `x`) as a variant of `g`, and whether it leaves open who is meant; None: it is none."""
    got = _org_fit(f, g, words) if kind == "org" else person_likelihood(x, y)
    if got is None:
        return None
    s, open_ = (got, False) if kind == "org" else got
    return None if s <= EDIT and not open_ and n > max(ERROR_ROWS, ERROR_SHARE * m) else (s + math.log(m), open_)


def _attach_block(forms: list[tuple[str, int, object]], kind: str, words: frozenset[str], seen: dict | None = None) -> Iterator[tuple[str, str, float]]:
    """Within a block of spellings (text, count, parsed), the most canonical first: (variant, candidate, posterior). `seen` keeps what
    was compared in other blocks."""
    leaders: list[tuple[str, int, object]] = []
    others: list[tuple[str, int, object]] = []
    seen = {} if seen is None else seen

    def fits(candidates: list, f: str, n: int, x: object) -> list[tuple[float, bool, str]]:
        found = []
        for g, m, y in candidates:
            k = (f, g)
            if k in seen:
                got = seen[k]
            else:
                got = seen[k] = _fit(kind, words, f, n, x, g, m, y)
            if got is not None:
                found.append((*got, g))
        return sorted(found, key=lambda t: (-t[0], t[2])) if len(found) > 1 else found

    for f, n, x in forms:
        found = fits(leaders, f, n, x)
        if not found:  # too far from any canonical form, but maybe a variant of a variant
            found = [t for t in fits(others, f, n, x) if not t[1]]
            if not found:
                leaders.append((f, n, x))
                continue
        elif found[0][1] and len(found) > 1 and found[0][0] - found[1][0] < MARGIN:
            continue
        others.append((f, n, x))
        yield f, found[0][2], found[0][0]


def _attach_group(rows: list[tuple[str, int]], kind: str, words: frozenset[str], block: int) -> Iterator[tuple]:
    """Links within all blocks of one organisation of bounded size (form, parent, score, key, n); the spellings of blocks larger than
    `block` come out with their key and without a parent."""
    blocks: dict[str, list[tuple[str, int, object]]] = {}
    for _, f, n, x in _forms(rows, kind, words):
        for k in org_keys(x, words) if kind == "org" else person_keys(x):
            blocks.setdefault(k, []).append((f, n, x))
    seen: dict = {}
    for k, forms in blocks.items():
        if len(forms) > block:
            number = int.from_bytes(blake2b(k.encode(), digest_size=8).digest(), "little", signed=True)
            for f, n, _ in forms:
                yield f, None, None, number, n
        elif len(forms) > 1:
            for x in _attach_block(forms, kind, words, seen):
                yield *x, None, None


def _attach_parts(rows: list[tuple[str, int, int, bool | None]], crossed: bool, kind: str, words: frozenset[str]) -> Iterator[tuple[str, str, float, bool]]:
    """Of two parts of a large block (spelling, count, part, leads), or of one with itself: (variant, candidate, posterior, open).

    Where `leads` is null, the best candidate of each variant that says who is meant, and the best that leaves it open, out of all
    more canonical spellings. Else the two best candidates of each spelling that does not lead, out of those that do."""
    known = {f: (p, leads) for f, _, p, leads in rows}
    before: list[tuple[str, int, object]] = []
    for _, f, n, x in _forms([(f, n) for f, n, _, _ in rows], kind, words):
        p, leads = known[f]
        if not leads:
            found = [(*got, g) for g, m, y in before if not (crossed and known[g][0] == p) and (got := _fit(kind, words, f, n, x, g, m, y)) is not None]
            found.sort(key=lambda t: (-t[0], t[2]))
            if leads is None:
                found = [*[t for t in found if not t[1]][:1], *[t for t in found if t[1]][:1]]
            for score, open_, g in found[:2]:
                yield f, g, score, open_
        if leads is not False:
            before.append((f, n, x))


def _grouped(batches: Iterator[pa.RecordBatch], width: int = 2, most: int | None = None) -> Iterator[tuple[tuple, list[list], bool]]:
    """Runs of equal first `width` columns of sorted batches: (these, the other columns, whether the run is cut off at `most` rows)."""
    now, rows, part = None, [], False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != now:
                if rows:
                    yield now, rows, part
                now, rows, part = row[:width], [], False
            elif most and len(rows) >= most:
                yield now, rows, True
                rows, part = [], True
            rows.append(row[width:])
    if rows:
        yield now, rows, part


def _attach(forms: DataFrame, kind: str, words: frozenset[str], block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(`org`, `form`, `parent`): the candidate each variant of `forms` (`org`, `form`, `n`) goes to."""
    spark = forms.sparkSession
    held = spark.sparkContext.broadcast(words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            got = [sorted(org_keys(f.split(" "), known) if kind == "org" else person_keys(Person(f.split(" "), known))) for f in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(got)), [len(k) for k in got]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([k for x in got for k in x], pa.string()), batch.column(1).take(at), batch.column(2).take(at)], ["org", "key", "form", "n"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of blocks of at most `block` spellings; the spellings of larger ones pass through, with their key."""
        known, out = held.value, []
        for (org, key), rows, part in _grouped(map(_shared, batches), most=block):
            if part or len(rows) > block:
                out += [(org, f, None, None, key, n) for f, n in rows]
            elif len(rows) > 1:
                out += [(org, *x, None, None) for x in _attach_block([x[1:] for x in _forms(rows, kind, known)], kind, known)]
            if len(out) > 10_000:
                yield _columns(out, small_schema)
                out = []
        if out:
            yield _columns(out, small_schema)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within whole organisations: their blocks need no shuffle."""
        known, out = held.value, []
        for (org,), rows, _ in _grouped(batches, 1):
            if len(rows) > 1:
                out += [(org, *x) for x in _attach_group(rows, kind, known, block)]
            if len(out) > 10_000:
                yield _columns(out, small_schema)
                out = []
        if out:
            yield _columns(out, small_schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = held.value, []
        for (org, key, i, j), rows, _ in _grouped(batches, 4):
            out += [(org, key, *x) for x in _attach_parts(rows, i != j, kind, known)]
            if len(out) > 10_000:
                yield _columns(out, parts_schema)
                out = []
        if out:
            yield _columns(out, parts_schema)

    small_schema = {"org": pa.int64(), "form": pa.string(), "parent": pa.string(), "score": pa.float64(), "key": pa.int64(), "n": pa.int64()}
    parts_schema = {"org": pa.int64(), "key": pa.int64(), "form": pa.string(), "parent": pa.string(), "score": pa.float64(), "open": pa.bool_()}
    forms = forms.select("org", "form", "n")
    many = cut(forms.groupBy("org").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > group).select("org"))
    whole = forms.join(many, "org", "left_anti").repartition(parallelism(spark), "org").sortWithinPartitions("org")
    links_schema = "org long, form string, parent string, score double, key long, n long"
    keyed = forms.join(many, "org", "left_semi").mapInArrow(emit, "org long, key string, form string, n long")
    # sorted by number, which is short; rows of two keys that share one part where the organisation changes
    numbered = keyed.select("org", F.xxhash64("org", "key").alias("key"), "form", "n")
    blocks = numbered.repartition(parallelism(spark), "key").sortWithinPartitions("key", "org")
    done = cut(blocks.mapInArrow(small, links_schema).unionByName(whole.mapInArrow(inside, links_schema)))
    links = done.where("parent is not null").select("org", "form", "parent", "score")
    large = done.where("parent is null").select("org", "key", "form", "n")
    if not large.isEmpty():
        place = ["org", "key", "form"]
        sizes = large.groupBy("org", "key").agg(F.count(F.lit(1)).alias("of")).withColumn("of", F.ceil(F.col("of") / block).cast("int"))
        placed = cut(large.join(sizes, ["org", "key"]).withColumn("p", F.pmod(F.xxhash64("form"), F.col("of")).cast("int")))

        def compared(rows: DataFrame) -> DataFrame:
            # every pair of parts meets in one task, so all pairs are compared, and no task compares more than two parts
            dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("q")).select("org", "key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "form", "n", "p", "leads")
            tasks = dealt.repartition(4 * parallelism(spark), "org", "key", "i", "j").sortWithinPartitions("org", "key", "i", "j")
            return cut(tasks.mapInArrow(parts, "org long, key long, form string, parent string, score double, open boolean"))

        # as within a small block: what is sure first; what is open goes to a spelling that is nobody's variant
        best = F.max(F.when(~F.col("open"), F.struct("score", "parent"))).alias("b")
        first = cut(compared(placed.withColumn("leads", F.lit(None).cast("boolean"))).groupBy(*place).agg(best))
        sure = first.where("b is not null").select("org", "form", F.col("b.parent").alias("parent"), F.col("b.score").alias("score"))
        roles = placed.join(first.withColumn("hangs", F.lit(True)), place, "left").where("b is null").drop("b").withColumn("leads", F.col("hangs").isNull()).drop("hangs")
        found = compared(roles)
        top = found.groupBy(*place).agg(F.max(F.struct("score", "parent", "open")).alias("b"))
        next_ = found.join(top, place).where("parent <> b.parent").groupBy(*place).agg(F.max("score").alias("next"))
        clear = top.join(next_, place, "left").where(~F.col("b.open") | F.col("next").isNull() | (F.col("b.score") - F.col("next") >= MARGIN))
        links = links.unionByName(sure).unionByName(clear.select("org", "form", F.col("b.parent").alias("parent"), F.col("b.score").alias("score")))
    return links.groupBy("org", "form").agg(F.max_by("parent", F.struct("score", "parent")).alias("parent"))


def _shared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted rows without those alone in their block, but for the blocks at either end, which may go on in other batches."""
    if batch.num_rows < 3:
        return batch
    org, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    new = (org[1:] != org[:-1]) | (key[1:] != key[:-1])
    alone = np.concatenate([[False], new[:-1] & new[1:], [False]])
    return batch.filter(pa.array(~alone))


def _columns(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.values(), strict=True)], list(schema))


def _numbered(forms: DataFrame) -> DataFrame:
    """`forms` with `id`, a number of their own; written, so that it stays the same."""
    return cut(forms.withColumn("id", F.monotonically_increasing_id() + 1))


def _roots(forms: DataFrame, links: DataFrame) -> DataFrame:
    """(`org`, `form`, `root`): number of the entity of each spelling of `forms` (`org`, `form`, `id`), which is that of its most
    canonical spelling. Only spellings that are linked go through the forest."""
    ids = forms.select("org", "form", "id")
    up = ids.select("org", F.col("form").alias("parent"), F.col("id").alias("up"))
    edges = cut(links.join(ids, ["org", "form"]).join(up, ["org", "parent"]).select("id", "up"))
    nodes = edges.unionByName(edges.select(F.col("up").alias("id"), F.lit(None).cast("long").alias("up")))
    found = hierarchy(nodes, id_col="id", parent_col="up").select("id", F.col("root_id").alias("root"))
    return ids.join(found, "id", "left").select("org", "form", F.coalesce("root", "id").alias("root"))


def parsed(df: DataFrame, key: str) -> DataFrame:
    """(`row_id`, `person`, `company`, `named`, `first`, `copy`): words of person and organisation as one string each; whether a
    person is named; how many of the person's words stand in the field of given names, null where not both fields hold some;
    the key of the record by which written copies are told."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fn, ln, co, em, ph = (c.to_pylist() for c in batch.columns[1:6])
            people = [named_words(a, b, [e, p]) for a, b, e, p in zip(fn, ln, em, ph, strict=True)]
            named = [any(c.isalnum() for c in (a or "") + (b or "")) for a, b in zip(fn, ln, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([" ".join(w) for w, _ in people], pa.string()), pa.array([" ".join(org_words(c)) for c in co], pa.string()), pa.array(named, pa.bool_()), pa.array([n for _, n in people], pa.int32()), batch.column(6)],
                ["row_id", "person", "company", "named", "first", "copy"],
            )

    cols = [F.col(c).cast("string").alias(c) for c in ("fname", "lname", "company", "email", "phone1")]
    return spread(df.select(F.col(key).alias("row_id"), *cols, record_key(FIELDS).alias("copy"))).mapInArrow(run, f"row_id {kind}, person string, company string, named boolean, first int, copy binary")


def _mined(rows: DataFrame) -> frozenset[str]:
    """Given names: words of many spellings of people (`org`, `person`, `first`), copies counted once, that stand more often in
    the field of given names than in that of family names, or never where the fields tell; so the family name of a frequent person or family is none."""
    forms = cut(rows.where("person <> ''").select("org", "person", "first").distinct())
    total = forms.select("org", "person").distinct().count()
    words = forms.select("org", "person", "first", F.posexplode(F.split("person", " ")).alias("at", "w")).where(F.length("w") > 1)
    seen = words.groupBy("w", "org", "person").agg(F.max((F.col("at") < F.col("first")).cast("int")).alias("front"), F.max((F.col("at") >= F.col("first")).cast("int")).alias("back"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("front", "back")]
    counts = seen.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *sums)
    many = counts.where((F.col("n") >= max(GIVEN_ROWS, GIVEN_SHARE * total)) & F.expr("front > back or front + back = 0"))
    return frozenset(r.w for r in many.collect())


def entities(df: DataFrame, *, key: str = "row_no", block: int = BLOCK) -> DataFrame:
    """(`row_id`, `org_id`, `person_id`, `copy`) of each row whose organisation is given; `person_id` 0 where no person is named;
    `copy` is equal for rows that are written copies of each other.

    Rows without an organisation, or that name a person without any family name, are left out: who is meant is open. Null
    and blank fields count as missing, empty tables give no rows, repeated rows get the same ids.
    """
    rows = cut(parsed(df, key).where("company <> '' and (person <> '' or not named)"))
    org_forms = _numbered(rows.groupBy(F.col("company").alias("form")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("org"), "form", "n"))
    common = _common(org_forms)
    orgs = _roots(org_forms, _attach(org_forms, "org", common, block))
    counts = org_forms.select(F.col("form").alias("company"), "n")
    rows = skew_lookup(rows, "company", orgs.select(F.col("form").alias("company"), F.col("root").alias("org")), counts=counts, how="inner")
    rows = cut(rows)
    given = _mined(rows)
    forms = _numbered(rows.where("person <> ''").groupBy("org", F.col("person").alias("form")).agg(F.count(F.lit(1)).alias("n")))
    roots = _roots(forms, _attach(forms, "person", given, block)).select(F.struct("org", "form").alias("k"), "root")
    named = rows.where("person <> ''").select("row_id", "org", "copy", F.struct("org", F.col("person").alias("form")).alias("k"))
    who = skew_lookup(named, "k", roots, counts=forms.select(F.struct("org", "form").alias("k"), "n"), how="inner")
    who = who.select("row_id", F.col("org").alias("org_id"), F.col("root").alias("person_id"), "copy")
    return who.unionByName(rows.where("person = ''").select("row_id", F.col("org").alias("org_id"), F.lit(0).cast("long").alias("person_id"), "copy"))


def linked(df: DataFrame, *, key: str = "row_no") -> DataFrame:
    """`entities` with `links`, the number of rows each is linked to: those of its entity that are no written copies of it."""
    rows = cut(entities(df, key=key).withColumn("k", F.struct("org_id", "person_id")))
    same = cut(rows.groupBy("k", "copy").agg(F.count(F.lit(1)).alias("same")))
    whole = same.groupBy("k").agg(F.sum("same").alias("n"))
    table = same.withColumn("c", F.struct("k", "copy")).select("c", F.col("same").alias("n"))
    out = skew_lookup(rows, "k", whole.withColumnRenamed("n", "whole"), counts=whole, how="inner")
    out = skew_lookup(out.withColumn("c", F.struct("k", "copy")), "c", table.withColumnRenamed("n", "same"), counts=table, how="inner")
    return out.select("row_id", "org_id", "person_id", (F.col("whole") - F.col("same")).alias("links"))


def entity_pairs(df: DataFrame, *, key: str = "row_no", part: int = 1000) -> DataFrame:
    """(`row_a`, `row_b`), `row_a` < `row_b`: all pairs of rows of one entity that are not written copies of each other.

    Large entities are dealt into parts of about `part` rows; a key of the join is a pair of parts, so it has the rows of two.
    """
    rows = cut(entities(df, key=key).select("row_id", F.struct("org_id", "person_id").alias("k"), "copy"))
    sizes = cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = sizes.select("k", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    member = skew_lookup(rows, "k", parts, counts=sizes, how="inner").withColumn("p", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))
    left = member.select("k", F.col("p").alias("i"), F.explode(F.sequence(F.col("p"), F.col("parts") - 1)).alias("j"), F.col("row_id").alias("a"), F.col("copy").alias("copy_a"))
    right = member.select("k", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("i"), F.col("p").alias("j"), F.col("row_id").alias("b"), F.col("copy").alias("copy_b"))
    both = left.join(right, ["k", "i", "j"]).where("(i < j or a < b) and copy_a <> copy_b")
    return both.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))
