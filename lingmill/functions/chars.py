"""Character classes and case mapping shared by the tokenizers (code units of the basic multilingual plane)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, as regular-expression class bodies that Java and RE2 read alike.
WHITE = "\\t-\\r \\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: Symbols that separate words besides punctuation.
SEPARATING_SYMBOLS = "¥©¤¦§®¶€™<>"
#: Punctuation that may stand inside a word.
IN_WORD = "&'-._\u00ad\u055a\u055b\u055d\u2012\u2013\u2014\u2015\u2018\u2019\u201b"
#: Dots, path separators, degree signs.
DOTS = ".\uffff"
SLASHES = "/\\"
DEGREES = "°º"

#: Letters whose full upper-case form is longer or of another letter; they stay as they are.
KEPT = "ßŉǰΐΰևẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆıſ"
_HOLD = "".join(chr(0xE100 + i) for i in range(len(KEPT)))

SPLIT_MARK = "\ue001"


def upper(text: Column) -> Column:
    """Upper case letter by letter (never longer than before), with Ё as Е."""
    held = F.translate(F.upper(F.translate(text, KEPT, _HOLD)), _HOLD, KEPT)
    return F.replace(F.when(text.rlike(f"[{KEPT}]"), held).otherwise(F.upper(text)), F.lit("Ё"), F.lit("Е"))


def upper_py(text: str) -> str:
    """`upper` for single strings."""
    return "".join(c if c in KEPT or len(u := c.upper()) != 1 else u for c in text).replace("Ё", "Е")


def lower(text: Column) -> Column:
    return F.lower(text)


def is_blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return text.isNull() | (F.regexp_replace(text, f"[{WHITE}]+", "") == "")


def until_nul(text: Column) -> Column:
    """A text ends at its first NUL."""
    return F.substring_index(text, "\u0000", 1)


def cut(text: Column, most: int) -> Column:
    """At most `most` characters, with `...` where something was cut off."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space as single spaces."""
    return F.regexp_replace(F.regexp_replace(text, f"[{WHITE}]", " "), " +", " ")


def display_size(n_bytes: Column) -> Column:
    """A size in the largest fitting unit, with two decimals."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return F.when(n_bytes >= gb, F.concat(F.format_number(n_bytes / gb, 2), F.lit(" GB"))).when(n_bytes >= mb, F.concat(F.format_number(n_bytes / mb, 2), F.lit(" MB"))).when(n_bytes >= kb, F.concat(F.format_number(n_bytes / kb, 2), F.lit(" KB"))).otherwise(F.concat(n_bytes.cast("string"), F.lit(" bytes")))


def equals_from(a: Column, start: int, b: Column) -> Column:
    """Whether `a` from character `start` (from 0) equals `b`."""
    return F.substring(a, start + 1, 2**31 - 1) == b


def word_form(base: Column, ending: Column) -> Column:
    return F.concat(base, F.coalesce(ending, F.lit("")))
