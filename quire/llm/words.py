"""Words of marked-up posts: tags and character references don't count, words are runs of letters and digits."""

from __future__ import annotations

import html
import re
import unicodedata

# Names of HTML elements and of BBCode tags, those within a line and those that end one.
HTML_INLINE = "a abbr acronym b bdi bdo big cite del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr"
HTML_BLOCK = "address article aside audio base basefont blink blockquote body br button canvas caption center code col dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe img input label legend li link main map marquee menu meta nav nobr noframes noscript object ol optgroup option p param picture pre script section select source style summary svg table tbody td template textarea tfoot th thead time title tr track ul video"
BBCODE_INLINE = "b i u s url size color font email sup sub anchor user"
BBCODE_BLOCK = "quote code img list center left right justify indent spoiler hide table tr td th li ul ol h1 h2 h3 h4 h5 h6 hr br youtube video media attach php html noparse align"

#: Stands between texts that are worked on together; never part of a match.
MARK = "\x00"


def _tag(names: str, end: str) -> str:
    return rf"</?(?:{'|'.join(names.split())})(?:[\s/][^<>{MARK}]*)?{end}"


def _bbcode(names: str) -> str:
    return rf"\[/?(?:{'|'.join(names.split())})(?:[=\s][^\[\]{MARK}]*)?\]"


_INLINE = re.compile(f"{_tag(HTML_INLINE, '>')}|{_bbcode(BBCODE_INLINE)}", re.I)
_BLOCK = re.compile(rf"<!--(?:(?!-->)[^{MARK}])*-->|{_tag(HTML_BLOCK, '>')}|{_bbcode(BBCODE_BLOCK)}|\[\*\]", re.I)
_HIDDEN = re.compile("[­​-‍⁠﻿]")
_WORD = re.compile(rf"[^\W_]+|{MARK}")


def plain(text: str) -> str:
    """`text` without tags and with character references resolved."""
    text = _BLOCK.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
        text = _BLOCK.sub(" ", _INLINE.sub("", text))
    return text


def words(text: str) -> list[str]:
    """Words in one spelling; MARK, if in the text, comes out as a word of its own."""
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFC", plain(text)).casefold()))
