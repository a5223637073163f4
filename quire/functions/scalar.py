"""Scalar functions: byte lengths, escapes, times, rounding and sizes for people."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def starts_with(c: Column, prefix: str) -> Column:
    return c.startswith(prefix)


def collation_key(c: Column, locale: str) -> Column:
    """The text with the order of a language, e.g. 'cs'."""
    return F.collate(c, locale)


def utf8(c: Column) -> Column:
    """Bytes of a text; U+0000 as two bytes, so that a zero byte can end it."""
    return F.to_binary(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "\\G((?:..)*?)00", "$1C080"), F.lit("hex"))


def from_utf8(c: Column) -> Column:
    return F.decode(F.to_binary(F.regexp_replace(F.hex(c), "\\G((?:..)*?)C080", "$100"), F.lit("hex")), "UTF-8")


def to_ticks(c: Column) -> Column:
    """Microseconds since 1970 of a time."""
    return F.unix_micros(c.cast("timestamp"))


def from_ticks(c: Column) -> Column:
    return F.timestamp_micros(c)


def significant(c: Column, digits: int = 2) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c / scale) * scale)


def humanize(n: float) -> str:
    """1234 -> 1.2k; also M and G."""
    for unit, size in (("G", 1e9), ("M", 1e6), ("k", 1e3)):
        if abs(n) >= size:
            return f"{n / size:.1f}{unit}"
    return str(int(n)) if float(n).is_integer() else f"{n:.1f}"


def humanized(c: Column) -> Column:
    """`humanize` of a column."""
    step = lambda size, unit: F.concat(F.format_string("%.1f", c / F.lit(size)), F.lit(unit))
    small = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.format_string("%.1f", c.cast("double")))
    return F.when(F.abs(c) >= 1e9, step(1e9, "G")).when(F.abs(c) >= 1e6, step(1e6, "M")).when(F.abs(c) >= 1e3, step(1e3, "k")).otherwise(small)


def round_significant(x: float, digits: int = 2) -> float:
    return 0.0 if not x else round(x, digits - 1 - math.floor(math.log10(abs(x))))


_ESCAPES = {"\n": "\\n", "\r": "\\r", "\\": "\\\\", '"': '\\"', "\0": "\\0"}


def escape(raw: bytes) -> str:
    """Printable form of bytes."""
    return "".join(_ESCAPES.get(chr(b)) or (chr(b) if 32 <= b < 127 else f"\\x{b:02X}") for b in raw)


def unescape(text: str) -> bytes:
    back = {v[1]: k for k, v in _ESCAPES.items()}
    return re.sub(r"\\(x([0-9A-Fa-f]{2})|.)", lambda m: chr(int(m[2], 16)) if m[2] else back.get(m[1], m[1]), text).encode("latin-1")


def tokens(line: str) -> list[str]:
    """Words of a command line; quoted ones may hold blanks and escapes."""
    return [unescape(m[1]).decode("latin-1") if m[1] is not None else m[2] for m in re.finditer(r'"((?:[^"\\]|\\.)*)"|(\S+)', line)]
