"""Posts that are nothing but template residue, filler, error pages or notices that scripts are required.

The own text of a post, without markup, quotations, navigation lines and signature, falls into messages (lines and
sentences), in which variable parts are masked. A fixed-depth prefix tree (number of tokens, then the first tokens) sorts the
distinct messages into leaves, where similar ones merge into templates; words that tell what a template is never become
variable. Each template is classified once and its verdict goes to all its messages by hash. Two verdicts come from how
templates are used in all posts, not from their words: a template without verdict that stands almost only beside different
ones with a verdict belongs to these pages, and a sentence with one open slot is a template, not talk about the slot, if
posts consist of it. Messages that say what a template with open slots says, with gaps or non-values in these places, count
as its instances. A post is residue if all of its messages are. Open slots inside ordinary posts are reported apart.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.common import cut, parallelism, skew_lookup, slices, spread, stored
from quire.llm.words import BBCODE_BLOCK, BBCODE_INLINE, HTML_BLOCK, HTML_INLINE

#: Depth of the prefix tree below the root: number of tokens, then so many leading tokens.
DEPTH = 3
#: Share of equal tokens from which a message joins a template.
SIMILAR = 0.6
#: A leaf with more messages than this is dealt into parts of about so many by hash; templates of the same text are one.
LEAF = 20_000
#: A template without verdict belongs to pages of residue if it stands in so many posts or more whose other messages all have
#: verdicts of at least two templates, and these are at least this share of all its occurrences.
COMPANY_POSTS, COMPANY_SHARE = 3, 0.8
#: A sentence with one open slot is residue by itself if so many posts or more, and this share of its posts, consist of residue.
SLOT_POSTS, SLOT_SHARE = 2, 0.5
#: Distinct messages a task remembers as sent; others are sent again, which costs a row but changes nothing.
SEEN = 200_000

#: Open slot, non-value, variable value (a number, path or address), and any word (a letter, so that it counts as a word).
SLOT, NIL, VAR, ANY = "‹slot›", "‹nil›", "‹*›", "ǂ"

_names = lambda *x: "|".join(sorted({n for y in x for n in y.split()} - {"link", "title", "data", "label", "address", "time", "summary", "source", "user", "email", "caption", "section", "header", "footer", "option", "object", "code", "img", "quote"}))
_INLINE = re.compile(rf"</?(?:{_names(HTML_INLINE)})(?:[\s/][^<>]*)?>|\[/?(?:{_names(BBCODE_INLINE)})(?:[=\s][^\[\]]*)?\]|\[email=[^\[\]]*\]|\[/(?:email|user)\]", re.I)
_BLOCK = re.compile(rf"<!--.*?-->|</?(?:{_names(HTML_BLOCK)}|code|img|section|header|footer)(?:[\s/][^<>]*)?>|</(?:link|title|time|address)>|<(?:link|time|object|source)\s[^<>]*>|\[/?(?:{_names(BBCODE_BLOCK)})(?:[=\s][^\[\]]*)?\]|\[/?(?:code|img)(?:[=\s][^\[\]]*)?\]", re.I | re.S)
_QUOTE_MARK = re.compile(r"</?blockquote[^<>]*>|\[/?quote[^\[\]]*\]", re.I)
_QUOTE_LINE = re.compile(r"^[ \t\xa0]*(?:[>|»][^\n]*|[^\n]{1,60}\b(?:wrote|said|schrieb|escribió|dijo)(?: on [^\n]*)?:)[ \t\xa0]*$", re.M)
_SIGNATURE = re.compile(r"(?:^|\n)[ \t\xa0]*(?:--+|_{3,}|~[ \t\xa0]+\S[^\n]{0,80})[ \t\xa0]*(?:\n[^\n]{0,80}){0,3}\s*\Z")
_PICTURE = re.compile(r"\[url=[^\[\]]*\]\w{1,12}\[/url\]", re.I)
_EDIT = re.compile(r"^[ \t\xa0*(\[]*(?:(?:last |zuletzt )?(?:edited|geändert|bearbeitet|editado)\b[^\n]{0,80})$", re.I | re.M)
_NAVIGATION = re.compile(r"^[ \t\xa0]*\w[\w ]{0,20}(?:[ \t\xa0]*[|»›/·][ \t\xa0]*\w[\w ]{0,20}){2,}[ \t\xa0]*$", re.M)

# Notations of slots in template languages, mail-merge tools and forms.
_SLOTS = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{0,60}%\}|\$\{[^{}\n]{0,60}\}|#\{[^{}\n]{0,60}\}|\{[$@]?\w[\w .|:-]{0,40}\}|<%[^<>\n]{0,60}%>|<\?[^<>\n]{0,60}\?>|<[A-Za-z][\w.]{1,40}>|\[\[[^\[\]\n]{0,60}\]\]"
    r"|@@[\w.]{1,40}@@|\*\|[\w.: ]{1,40}\|\*|%%[\w.]{1,40}%%|%[A-Z_][A-Z_0-9.]{1,40}%|%[a-z]\w*_\w+%|%\w+\.\w+%|%[a-z]{3,40}%|__[A-Za-z][\w.]{0,40}?__|«[\w. ]{1,40}»|\$[A-Za-z][\w.]{0,40}\$|##[\w.]{1,40}##"
    r"|\[(?!DELETED|REMOVED|GEL|ELIMINAD|BORRAD|QUOTE|URL|IMG|CODE)(?:[A-Z]{2,}(?:[ _][A-Z]{2,}){0,4}|(?:your|insert|place|enter|add|the) [a-z ]{2,30}|TBD)\]"
)
# What programs print for a missing value.
_NILS = re.compile(r"(?<![\w'-])(?:undefined|null|None|NaN|nil|NULL|N/A|n/a|\(null\)|\[object Object\]|\(none\)|#N/A|#REF!|#VALUE!)(?![\w'-])|(?<!\S)\?{2,}")
_NIL_PARTS = ("undefined", "null", "None", "NaN", "nil", "NULL", "N/A", "n/a", "[object Object]", "(none)", "#REF!", "#VALUE!", "??")
_VARS = re.compile(r"https?://\S+|(?<!\w)/[\w.-]+(?:/[\w.-]+)+(?:[:(]\d+\)?:?)?|(?<!\w)(?=[\w.-]*\d)[\w-]+(?:\.[\w-]+)*|\b[\w-]+(?:\.[\w-]+)+\.(?:example|invalid|test|com|org|net)\b")
_SENTENCE = re.compile(r"([.!?…])[\"')\]]*\s+")
_GAP_SIGNS = ("  ", " ,", " .", " !", " ?", " :", " ;", ":.", ":\n", ": \n", "\t")
_GAP = re.compile(r"[ \t\xa0]{2,}|\s[,.!?:;](?=\s|$)|:\s*$|:\s*\.|^\s+\S")
_TOKEN = re.compile(rf"{SLOT}|{NIL}|{re.escape(VAR)}|[^\W_]+(?:['’][^\W_]+)?|#\d+|[{{}}()]")


def _unquoted(text: str) -> str:
    """The text without quotations between marks, in one pass however deep they are nested; a mark without its partner is dropped."""
    opened: dict[str, list[int]] = {"b": [], "q": []}
    spans, marks = [], []
    for m in _QUOTE_MARK.finditer(text):
        mark = m[0].lower()
        kind = "b" if "blockquote" in mark else "q"
        if mark[1] != "/":
            opened[kind].append(m.start())
        elif opened[kind]:
            spans.append((opened[kind].pop(), m.end()))
            continue
        marks.append((m.start(), m.end()))
    out, at = [], 0
    for a, b in sorted(spans + marks):
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    return "\n".join([*out, text[at:]])


def own_text(text: str) -> str:
    """The post's own text: no markup, quotation, navigation or signature."""
    if "<" in text or "[" in text:
        text = _unquoted(text)
        text = _BLOCK.sub("\n", _INLINE.sub("", _PICTURE.sub(" ", text)))
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("\xa0", " ").strip("\n")
    if "--" in text or "___" in text or "~" in text:
        text = _SIGNATURE.sub("\n", text)
    text = _EDIT.sub("", _QUOTE_LINE.sub("", text))
    return _NAVIGATION.sub("", text) if any(c in text for c in "|»›/·") else text


class _Words(dict):
    """What a chunk between blanks becomes; chunks repeat, so each is looked at once."""

    def __init__(self, mask: bool):
        super().__init__()
        self.mask = mask

    def __missing__(self, chunk: str) -> str:
        if len(self) > 200_000:
            self.clear()
        text = _VARS.sub(f" {VAR} ", chunk) if self.mask else chunk
        self[chunk] = out = " ".join(_TOKEN.findall(text.lower()))
        return out


_MASKED, _PLAIN = _Words(True), _Words(False)


def messages(text: str) -> list[tuple[str, bool]]:
    """Messages of a post, masked, and whether a gap in it may be an empty slot."""
    own = own_text(text)
    gaps = any(x in own for x in _GAP_SIGNS) or own.rstrip()[-1:] == ":"
    # doubled white space throughout is a way of writing; a gap here and there is a slot without a value
    if gaps and "  " in own and len(re.findall(r"\S +(?=\S)", own)) <= 2 * len(re.findall(r"\S  +(?=\S)", own)) > 4:
        gaps = False
    own = _SLOTS.sub(f" {SLOT} ", own)
    if any(n in own for n in _NIL_PARTS):
        own = _NILS.sub(f" {NIL} ", own)
    out, masked = [], _MASKED.__getitem__
    for part in _SENTENCE.sub("\\1\n", own).split("\n"):
        message = " ".join(filter(None, map(_PLAIN.__getitem__ if part[:1] == "#" else masked, part.split())))
        if message:
            out.append((message, gaps and _gap(part)))
    return out


def _gap(part: str) -> bool:
    if "‹" in part:
        part = part.replace(f" {SLOT} ", "x").replace(f" {NIL} ", "x")
    return _GAP.search(part.strip()) is not None


def skeleton(message: str) -> str:
    """What is constant in a message with slots."""
    return " ".join(t for t in message.split() if t not in (SLOT, NIL, VAR)) if "‹" in message else message


# Vocabulary of the usual filler passage.
LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
# What is typed to fill a field.
MASH = set("asdf asdfg asdfgh asdfghjkl asd qwe qwer qwert qwerty qwertz jkl jklö zxcv yxcv foo bar baz qux foobar blah bla test testing tests aaa bbb ccc xxx xyz yyy zzz abc abcd lala dummy sample hjkl fdsa sdf dfg fgh ‹*›".split())
# The status phrases of HTTP.
_STATUS = "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request timeout|conflict|gone|length required|precondition failed|payload too large|request entity too large|uri too long|unsupported media type|too many requests|unavailable for legal reasons|internal server error|not implemented|bad gateway|service unavailable|service temporarily unavailable|gateway timeout|http version not supported|access denied|permission denied|page not found|file not found|server error"
_V = rf"(?:{re.escape(VAR)} ?)"
_SELF = re.compile(r"\b(?:i|i'm|i've|me|my|mine|myself|ich|mir|mich|mein\w*|yo|mí|mis)\b")

_ERROR = re.compile(
    rf"^(?:(?:http|https|error|status|fehler|code|estado|erreur) ){{0,2}}{_V}?(?:{_STATUS})$"
    rf"|^(?:http |server )?(?:error|status|fehler|erreur)(?: code)? {_V}$"
    r"|^(?:please )?(?:contact|notify|tell) the (?:site |server |board )?(?:administrator|admin|webmaster)$|^(?:go|return|back)(?: back)? to the (?:home|front|start|main) ?page$"
    r"|^the (?:requested )?(?:address|url|page|resource|file|document|thread|content|host|site|server) .*(?:was not found|not be found|does not exist|no longer exists|could not (?:be|complete|process|handle|fulfil))"
    rf"|^while serving\b|^(?:reference|incident|request id|ray id|trace id|error id|ticket)(?: {_V}){{1,3}}(?:was logged|has been logged)?$|^cannot (?:get|post|put|delete) {_V}?$"
    r"|^(?:sorry |oops |whoops )*something went wrong\b|^(?:sorry )?an? (?:unexpected |internal |fatal |unknown )*error (?:has )?occurred|^incident .*logged$"
    r"|^database error\b|^(?:error establishing a|could not|cannot|failed to|unable to) (?:database )?connect|^please (?:reload|try again|retry|refresh|come back|check back|wait)\b.{0,40}$"
    r"|^(?:php )?(?:warning|notice|fatal error|parse error|deprecated|strict standards) .*(?:on line|\(\)|\( \)|uncaught|exception|undefined|in ‹\*›)|^(?:uncaught )?exception\b|^stack ?trace$|^#\d+ ?|^traceback \( most recent call last \)$|^file .*\bline ‹\*› in \w+$|^\w*(?:error|exception)(?: \w+){0,3}$"
    r"|^java (?:lang|io|util) \w*(?:exception|error)\b|^at \w+ .*\bjava\b|^\w+ \w+ \w*(?:exception|error) |^caused by \w+"
    r"|^página no encontrada$|^error ‹\*›$|^vuelva a la página\b|^seite nicht gefunden\b|^der angeforderte inhalt\b|^(?:die |diese )seite (?:wurde|existiert|konnte)\b.*nicht|^la página (?:que busca|solicitada)\b|^zugriff verweigert$|^acceso denegado$|^interner serverfehler$"
    r"|^(?:your|the) session (?:has )?(?:expired|timed out)\b|^please (?:log|sign) in\b.{0,40}$|^(?:log|sign) in or register\b|^you (?:do not|don't) have (?:the )?permissions?\b|^you are not (?:allowed|authorized|permitted)\b|^you must be logged in\b"
    r"|^the (?:board|forum|site|page|server|service|database|website)s? (?:is|are) (?:currently |temporarily )*(?:closed|down|unavailable|offline|under maintenance|undergoing maintenance|overloaded|not available)\b|^(?:we are )?(?:down for|scheduled) maintenance\b"
    r"|^no \w+ (?:was|were) (?:given|specified|found|selected)$|^(?:no|invalid) (?:thread|post|forum|page|topic|user) (?:specified|id)\b|^if a link on this (?:board|site|forum|page)\b|^if you followed a (?:valid )?link\b"
    r"|^(?:your|this|the) (?:request|access|connection|ip|address) (?:was|has been|is) (?:blocked|denied|rejected|refused|banned)\b"
    r"|^upstream\b.*\b(?:dropped|disconnect\w*|reset|header\w*)\b|^(?:upstream|connection) (?:timed out|refused|reset)\b|^(?:connection|request) (?:timed out|refused)$"
)
_SCRIPT_WORD = re.compile(r"\b(?:javascript|java script|scripts?|noscript|cookies|skripte?|scripting)\b")
_SCRIPT = re.compile(
    r"\b(?:enable\w*|disabled?|turn\w* (?:it |them )?(?:on|off)|turned (?:on|off)|switch\w* (?:it |them )?(?:on|off)|switched (?:on|off)|allow\w*|needs?|requires?|required|must|support\w*|available|unavailable|aktivier\w*|deaktiviert|erlauben|benötigt|erforderlich|ohne|activ\w+|desactivad\w*|habilit\w+|necesita\w*|requiere\w*|permit\w*|block\w*|runs?|works?)\b"
)
_SCRIPT_MORE = re.compile(
    r"^(?:please )?(?:enable|allow|activate|switch|turn) (?:it|them|this)\b(?: on)?(?: in your (?:web )?(?:browser|client|device))?(?: (?:to|and) .{0,60})?$|^your (?:web browser|browser|client|device|program|app) (?:is not|does not|is no longer|doesn't)\b.*support|^(?:please )?(?:reload|refresh) .{0,40}$"
    r"|^(?:one moment|please wait|just a moment|checking)\b.*\b(?:browser|client|device|connection)\b|^this (?:takes|may take|will take|process)\b.*\b(?:seconds?|moments?|automatic)\b.*$|^loading\b.{0,40}$"
)
_FILLER = re.compile(
    r"^(?:this is )?(?:a |an |the |some |your )?(?:sample|placeholder|dummy|filler|example|demo|default|test) (?:text|content|post|paragraph|page|entry|copy|description|article|message|title)(?: here| goes here)?$"
    r"|^this is (?:a|an|the|your) (?:first|sample|demo|default|placeholder|example|test|dummy) (?:post|page|article|entry|text|message|topic|thread)$|^(?:replace|edit|overwrite|change|delete|remove|modify) (?:it|this|me)(?: \w+)? with your own \w+$|^(?:edit|replace|delete|overwrite) (?:or \w+ )?(?:it|this)(?: .{0,40})?$"
    r"|^(?:\w+ ){1,3}(?:(?:is |are |will be )?(?:coming soon|pending|to follow|to come)|(?:goes|comes|belongs) (?:here|in this (?:box|field|area|space)))$|^\( (?:\w+ ){1,4}(?:goes|comes|belongs) (?:here|in this (?:box|field|area|space)) \)$|^(?:content|text|description|details|more) (?:follows|here|will follow)$|^coming soon$|^under construction$|^blindtext\b.*|^(?:hier steht|hier kommt|hier folgt) (?:ihr|dein|der|bald|ein)\b.{0,30}$|^platzhalter\w*$|^(?:beispieltext|mustertext|fülltext)$"
    r"|^(?:texto|contenido|título) de (?:ejemplo|relleno|prueba|muestra)$|^aquí va (?:su|tu|el) \w+$|^(?:contenido|texto) (?:próximamente|pendiente)$|^próximamente\b.{0,20}$"
    r"|^todo (?:write|add|insert|fill|finish|complete|update|fix)\b.{0,40}$|^(?:todo|tbd|tba|fixme|wip)(?: .{0,30})?$|^(?:your|insert|enter|add|type|put|write) (?:your |the |some |a )?(?:post |page |article |thread |body |sample |main )?(?:text|content|contents|title|description|name|message|summary|introduction|reply|comment|answer|body|something|anything|subject|signature)(?: goes)?(?: here)?$|^(?:el )?texto (?:simulado|falso)\b.{0,20}$|^advertisement placeholder$"
)


class _Telling(dict):
    """Whether a token takes part in the verdict on a template: the words of the rules, and what they take for such."""

    def __init__(self) -> None:
        super().__init__()
        rules = " ".join(x.pattern for x in (_ERROR, _SCRIPT_WORD, _SCRIPT, _SCRIPT_MORE, _FILLER, _SELF))
        rules = re.sub(r"\\[a-zA-Z]", " ", rules)
        self.words = frozenset(re.findall(r"[^\W\d_]+", rules)) | LOREM | MASH
        self.stems = tuple(sorted(w for w in self.words if len(w) >= 6))

    def __missing__(self, t: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        self[t] = out = t in (SLOT, NIL, VAR) or not t[0].isalpha() or t in self.words or t.startswith(self.stems) or t.endswith(("error", "exception")) or (len(set(t)) == 1 and len(t) > 2)
        return out


TELLING = _Telling()


class Tree:
    """Fixed-depth prefix tree of message templates.

    A leaf groups its templates by their telling words and the places of these, which must be the same; among such templates
    the one with the most equal tokens takes a message, if enough are equal. Other tokens that differ become variable.
    """

    def __init__(self, depth: int = DEPTH, similar: float = SIMILAR):
        self.depth, self.similar = depth, similar
        self.leaves: dict[tuple[str, tuple], list[list[str]]] = {}

    @staticmethod
    def path(message: str, depth: int = DEPTH) -> str:
        n = message.count(" ") + 1
        return " ".join([str(n), *[VAR if t in (SLOT, NIL) else t for t in message.split(" ", depth - 1)[: depth - 1]]])

    def add(self, message: str) -> list[str]:
        """The template the message belongs to; its variable tokens may grow later."""
        tokens = message.split()
        told = tuple([(i, t) for i, t in enumerate(tokens) if TELLING[t]])
        templates = self.leaves.setdefault((self.path(message, self.depth), told), [])
        best, most = None, max(1, math.ceil(self.similar * len(tokens) - 1e-9)) - 1
        for template in templates:
            same = sum(map(str.__eq__, template, tokens))
            if same > most:
                best, most = template, same
        if best is None:
            templates.append(tokens)
            return tokens
        if most < len(tokens):
            for i, t in enumerate(tokens):
                if best[i] != t:
                    best[i] = ANY
        return best


def classify(template: str) -> str | None:
    """Kind of residue the template is, by its words: 'slots', 'slot' (one only, left open), 'nils', 'filler', 'error', 'script', or None."""
    tokens = template.split()
    slots, nils = tokens.count(SLOT), tokens.count(NIL)
    own = _SELF.search(template) is not None
    if slots + nils and not own:
        if slots and (slots + nils > 1 or len(tokens) - slots <= 3):
            return "slots"
        if slots:
            return "slot"
        if nils > 1 or len(tokens) == 1:
            return "nils"
    words = [t for t in tokens if t not in (VAR, SLOT, NIL)]
    if words and (sum(t in LOREM for t in words) >= 0.8 * len(words)) and (len(words) > 2 or "lorem" in words or "ipsum" in words or len(words) == sum(t in LOREM and len(t) > 3 for t in words)):
        return "filler"
    if all(t in MASH or (len(set(t)) == 1 and len(t) > 2) for t in tokens) and words:
        return "filler"
    if _FILLER.match(template):
        return "filler"
    if own:
        return None
    if _ERROR.match(template):
        return "error"
    if (_SCRIPT_WORD.search(template) and _SCRIPT.search(template)) or _SCRIPT_MORE.match(template):
        return "script"
    return None


_UNITS = "doc_id {0}, h binary, gap boolean, slots int, leaf long, message string"


def _hash(text: str) -> bytes:
    return blake2b(text.encode(), digest_size=16).digest()


def units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per message: `doc_id`, `h` (128 bits of the message), `gap`, `slots` (open ones in it), and, where a task meets it
    first, else null, `leaf` (32 bits of the leaf of the tree it belongs to; leaves that share them share a task) and `message`, the text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, bytes] = {}
        for batch in slices(batches):
            got = [messages(t) if t else [] for t in batch.column(1).to_pylist()]
            n = np.array([len(g) for g in got])
            flat = pa.array([m for g in got for m, _ in g], pa.string()).dictionary_encode()
            index, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
            if len(hashes) + len(distinct) > SEEN:
                hashes.clear()
            new = [m not in hashes for m in distinct]
            for m, fresh in zip(distinct, new, strict=True):
                if fresh:
                    hashes[m] = _hash(m)
            leaf = [crc32(Tree.path(m).encode()) if fresh else None for m, fresh in zip(distinct, new, strict=True)]
            first = np.zeros(len(index), bool)
            first[np.unique(index, return_index=True)[1]] = True
            sent = pa.array(index, pa.int64(), mask=~(first & np.array(new, bool)[index])) if len(index) else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([hashes[m] for m in distinct], pa.binary()).take(flat.indices), pa.array([g for x in got for _, g in x], pa.bool_()),
                    pa.array([m.count(SLOT) for m in distinct], pa.int32()).take(flat.indices), pa.array(leaf, pa.int64()).take(sent), flat.dictionary.take(sent),
                ],
                ["doc_id", "h", "gap", "slots", "leaf", "message"],
            )

    return spread(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, _UNITS.format(kind))


_MINED = "h binary, template binary, verdict string, nil boolean, bones binary"


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages (`message`) of whole parts of leaves -> (h, template, verdict, nil, bones), one row per distinct message; `template`
    and `bones` are hashes of the template's text and of what is constant in the message. A template is classified once."""
    got = sorted({m for b in batches for m in b.column(0).to_pylist()})
    if not got:
        return
    tree = Tree()
    placed = [(m, tree.add(m)) for m in got]
    done: dict[int, tuple[bytes, str | None]] = {}
    rows = []
    for m, t in placed:
        known = done.get(id(t))
        if known is None:
            text = " ".join(t)
            known = done[id(t)] = (_hash(text), classify(text))
        h = _hash(m)
        rows.append((h, *known, NIL in m, _hash(skeleton(m)) if "‹" in m else h))
        if len(rows) == 20_000:
            yield _mined_batch(rows)
            rows = []
    if rows:
        yield _mined_batch(rows)


def _mined_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.string(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "template", "verdict", "nil", "bones"])


def templates(texts: DataFrame) -> DataFrame:
    """(`h`, `template`, `verdict`, `nil`, `bones`) of each distinct message of `texts` (`leaf`, `message`)."""
    spark, leaf = texts.sparkSession, texts
    large = leaf.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF).select("leaf", F.ceil(F.col("n") / LEAF).alias("parts"))
    dealt = leaf.join(large, "leaf", "left").select("message", "leaf", F.coalesce(F.pmod(F.xxhash64("message"), "parts"), F.lit(0)).alias("part"))
    return dealt.repartition(parallelism(spark), "leaf", "part").select("message").mapInArrow(_mine, _MINED)


_KINDS = ("error", "filler", "script", "slots")


def _posts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per post with a message: `doc_id`, `messages`, of how many kind (`error`, `filler`, `script`, `slots`) these are, `slot`
    (sentences with one open slot that nothing else tells about), `with_slots` (messages with open slots), `open_slots`."""
    rows = stored(units(docs, key, text), "units")
    counts = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    mined = stored(templates(rows.where("message is not null").select("leaf", "message")), "templates")
    # what templates with open slots say around them; where the same is said with gaps or non-values, they apply
    bones = mined.where("verdict in ('slots', 'slot')").select("bones").distinct().withColumn("known", F.lit(True))
    table = mined.join(bones, "bones", "left").where("verdict is not null or known").select("h", "template", "verdict", "nil", F.coalesce("known", F.lit(False)).alias("known"))
    found = skew_lookup(rows.select("doc_id", "h", "gap", "slots"), "h", table, counts=counts)
    kind = F.when(F.col("known") & (F.col("gap") | F.col("nil")), F.lit("slots")).when(F.col("verdict") == "nils", "slots").otherwise(F.col("verdict"))
    first = stored(found.select("doc_id", "h", "slots", "template", kind.alias("kind")), "messages")
    sure = F.coalesce(F.col("kind").isin(*_KINDS), F.lit(False))
    number = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    beside = [F.max(F.when(sure, F.col("template"))).alias("beside"), F.max(F.when(sure, F.col("kind"))).alias("theirs")]
    posts = stored(first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("messages"), *[number(k) for k in (*_KINDS, "slot")], F.count(F.when(F.col("slots") > 0, 1)).alias("with_slots"), F.sum("slots").alias("open_slots"), *beside), "posts")

    # how templates are used: posts of which all messages but one are residue
    bad = sum((F.col(k) for k in _KINDS), F.lit(0))
    near = posts.where((bad == F.col("messages") - 1) & ((bad > 0) | (F.col("slot") == 1))).select("doc_id", "beside", "theirs")
    lone = first.where(~sure).select("doc_id", "h", "kind").join(near, "doc_id")
    named = lone.join(mined.select("h", F.col("template").alias("t")), "h")
    used = named.groupBy("t").agg(F.count(F.lit(1)).alias("alone"), F.min("beside").alias("b0"), F.max("beside").alias("b1"), F.max("theirs").alias("theirs"), F.max("kind").alias("kind"))
    company = F.col("kind").isNull() & (F.col("alone") >= COMPANY_POSTS) & (F.col("b0") != F.col("b1"))
    some = used.where(company | ((F.col("kind") == "slot") & (F.col("alone") >= SLOT_POSTS)))
    members = cut(mined.select("h", F.col("template").alias("t")).join(some, "t").join(counts, "h"))
    enough = F.col("alone") >= F.col("total") * F.when(F.col("kind") == "slot", SLOT_SHARE).otherwise(COMPANY_SHARE)
    more = members.join(members.groupBy("t").agg(F.sum("n").alias("total")), "t").where(enough)
    more = cut(more.select("h", "n", F.when(F.col("kind") == "slot", "slots").otherwise(F.col("theirs")).alias("by_use")))
    late = skew_lookup(first.where(~sure).select("doc_id", "h", F.col("kind").alias("was")), "h", more.select("h", "by_use"), counts=more.select("h", "n"), how="inner")
    late = late.groupBy("doc_id").agg(*[F.count(F.when(F.col("by_use") == k, 1)).alias(f"more_{k}") for k in _KINDS], F.count("was").alias("less_slot"))
    none = lambda c: F.coalesce(c, F.lit(0))
    kinds = [(F.col(k) + none(f"more_{k}")).alias(k) for k in _KINDS]
    return posts.join(late, "doc_id", "left").select("doc_id", "messages", *kinds, (F.col("slot") - none("less_slot")).alias("slot"), "with_slots", "open_slots")


#: A single slot in one sentence may be talk about it; several such sentences, or one beside others of the kind, are not.
_WHOLE = "error + filler + script + slots + slot = messages and (slot < messages or messages > 1)"


def residue(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`doc_id`, `kind`, `messages`) of each post that is residue; `kind` is that of most of its messages (ties: the first in
    the alphabet). Null, empty and emptied posts are not. Repeated rows of one id count as one post; other columns are
    ignored."""
    whole = _posts(docs, key, text).where(_WHOLE).withColumn("slots", F.col("slots") + F.col("slot"))
    first = F.greatest(*_KINDS)
    name = F.when(F.col("error") == first, "error").when(F.col("filler") == first, "filler").when(F.col("script") == first, "script").otherwise("slots")
    return whole.select("doc_id", name.alias("kind"), "messages")


def open_slots(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`doc_id`, `messages`, `slots`) of each post that holds unresolved slots beside content of its own: how many of its messages
    have some, and how many these are. Posts that are residue as a whole are not listed; other columns are ignored."""
    return _posts(docs, key, text).where(f"open_slots > 0 and not ({_WHOLE})").select("doc_id", F.col("with_slots").alias("messages"), F.col("open_slots").alias("slots"))
