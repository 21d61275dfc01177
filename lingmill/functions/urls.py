"""URLs and e-mail addresses in text.

What is found, with dots and colons taken from left to right:

* `www.` and what follows it;
* a dot before a top-level domain (of several in a row the last one), with all that stands before it and, if a slash
  follows, all after it;
* a known scheme, its colon, and what follows.

White space, punctuation outside ASCII and the end of the text break a URL off; punctuation at its ends, up to a slash,
is no part of it. The character after a URL, after a dot without a domain and after the colon of an unknown scheme
starts no URL.
"""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from importlib import resources

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lingmill.functions.chars import DOTS, SPLIT_MARK, until_nul

# Top-level domains that are no country codes of ISO 3166, and country codes that are none of the domains.
OTHER_DOMAINS = "ac aero an asia biz cat com coop edu eu gov info int jobs mil mobi museum name nato net org pro su tel tp travel uk yu ру рф нет орг ком"
CODES_WITHOUT_DOMAIN = "ax bl bq cw me mf rs ss sx tl"
# URI schemes.
SCHEMES = (
    "javascript jdbc acap adiumxtra attachment bitcoin chrome chrome-extension com-eventbrite-attendee cvs dns ed2k facetime file finger fish gizmoproject "
    "gopher http https iax imap irc irc6 ircs jabber jar ldap mailto mms ms-help ms-settings-power ###########news snews nntp rtmp rtsp ftp sftp tftp skype snmp ssh telnet udp uuid urn ws wss xmpp magnet"
)


@dataclass(frozen=True)
class UrlRules:
    """Upper-cased top-level domains and schemes."""

    domains: frozenset[str] = field(default_factory=frozenset)
    schemes: frozenset[str] = field(default_factory=lambda: frozenset(SCHEMES.upper().split()))

    @cached_property
    def longest_scheme(self) -> int:
        return max(map(len, self.schemes), default=0)

    @classmethod
    def default(cls, spark: SparkSession | None = None) -> UrlRules:
        """The 272 domains: ISO's country codes, which the time zone data list, less those without a domain, and the
        others. No session is needed."""
        listed = (resources.files("tzdata") / "zoneinfo" / "iso3166.tab").read_text("utf-8").splitlines()
        codes = frozenset(line.split("\t")[0] for line in listed if line and not line.startswith("#"))
        return cls(codes - frozenset(CODES_WITHOUT_DOMAIN.upper().split()) | frozenset(OTHER_DOMAINS.upper().split()))

    @classmethod
    def from_xml(cls, path: str) -> UrlRules:
        """Rules from a resource file: the texts of the children of `first-level-domains` and `uri-schemes`."""
        root = ET.parse(path).getroot()
        words = {kind: frozenset((e.text or "").strip().upper() for e in (root.find(kind) if root.find(kind) is not None else [])) - {""} for kind in ("first-level-domains", "uri-schemes")}
        return cls(words["first-level-domains"], words["uri-schemes"])


def is_white(c: str) -> bool:
    return unicodedata.category(c) in ("Zs", "Zl", "Zp") or "\t" <= c <= "\r" or c == "\x85"


def is_punctuation(c: str) -> bool:
    """Of the basic multilingual plane, as all classes here are."""
    return c <= "￿" and unicodedata.category(c)[0] == "P"


def is_letter(c: str) -> bool:
    return c <= "￿" and unicodedata.category(c)[0] == "L"


_PLANE = [chr(c) for c in range(0x10000)]
_PUNCTUATION = frozenset(filter(is_punctuation, _PLANE))
_BREAKS = frozenset(c for c in _PLANE if is_white(c) or (c in _PUNCTUATION and c > "\x7f"))
_EDGES = frozenset(c for c in _PLANE if is_white(c)) | _PUNCTUATION
_UP_TO_BREAK = re.compile(f"[^{''.join(map(re.escape, sorted(_BREAKS)))}]*")
_LETTERS = re.compile(r"[^\W\d_]*")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-")
_SIGN = re.compile("[.:]")
#: Rows without one of these hold no URL.
GUARD = "\\.\\p{L}|[A-Za-z-]:|[wW]{3}\\."


def _letters(text: str, at: int) -> str:
    """The letters from a place on."""
    run = _LETTERS.match(text, at)[0]
    if not run.isascii():
        run = run[: next((k for k, c in enumerate(run) if not is_letter(c)), len(run))]
    return run


def _right(text: str, sign: int, at: int) -> int:
    """The end of a URL that goes on from `at`; it keeps at least the sign."""
    end = _UP_TO_BREAK.match(text, at).end()
    while end > sign + 1 and text[end - 1] in _PUNCTUATION and text[end - 1] != "/":
        end -= 1
    return end


class _Lefts:
    """Starts of URLs to the left of dots that come in order; each stretch between two dots is looked at once."""

    def __init__(self, text: str):
        self.text, self.start, self.dot = text, 0, 0

    def __call__(self, dot: int) -> int:
        text, at = self.text, dot
        while at > self.dot and text[at - 1] not in _BREAKS:
            at -= 1
        if at > self.dot or (at and text[at - 1] in _BREAKS):
            self.start = at
        self.dot = dot
        while self.start < dot and text[self.start] in _EDGES and text[self.start] != "/":
            self.start += 1
        return self.start


def find_urls(text: str, rules: UrlRules) -> list[tuple[int, int]]:
    """(start, end) of each URL, in the order found; they may overlap. A text ends at its first NUL."""
    if "\0" in text:
        text = text[: text.index("\0")]
    out, at, left = [], 0, _Lefts(text)
    n = len(text)
    while m := _SIGN.search(text, at):
        sign = at = m.start()
        after = sign + 1
        if text[sign] == "." and (after == n or not text[after].isalpha()) and text[sign - 1 : sign] not in ("w", "W"):
            at = sign + 2  # no domain can follow
            continue
        span, at = _at_sign(text, sign, rules, left)
        if span:
            out.append(span)
    return out


def _at_sign(text: str, sign: int, rules: UrlRules, left: _Lefts) -> tuple[tuple[int, int] | None, int]:
    """(the URL of a dot or colon, or None; where to go on)"""
    if text[sign] == ":":
        longest = rules.longest_scheme
        low = start = max(0, sign - longest - 2)
        for at in range(sign, low, -1):
            if text[at - 1] not in _SCHEME:
                start = at
                break
        word = text[start:sign]
        if not word or len(word) > longest + 1:
            return None, sign + 1
        if word.upper() not in rules.schemes:
            return None, sign + 2
        span = start, _right(text, sign, sign)
        return span, span[1] + 1
    if text[max(0, sign - 3) : sign].upper() == "WWW":
        span = sign - 3, _right(text, sign, sign)
        return span, span[1] + 1
    dot, end = None, sign
    while end < len(text) and text[end] in DOTS and (word := _letters(text, end + 1)) and word.upper() in rules.domains:
        dot, end = end, end + 1 + len(word)
    if dot is None:
        return None, sign + 2
    start = left(dot)
    if start >= dot:
        return None, sign + 1
    if text[end : end + 1] in ("/", "\\"):
        end = _right(text, dot, end)
    return (start, end), end + 1


def url_of(text: str, place: int, rules: UrlRules) -> tuple[int, int] | None:
    """The URL of the dot or colon at a place, or else the one that covers the place, if any."""
    if not 0 <= place < len(text):
        return None
    if text[place] in ".:" and (span := _at_sign(text.split("\0", 1)[0] if "\0" in text else text, place, rules, _Lefts(text))[0]):
        return span
    return next((s for s in find_urls(text, rules) if s[0] <= place < s[1]), None)


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` with each stretch covered by URLs replaced by a mark that is neither white space nor punctuation."""
    out, done = [], 0
    for a, b in sorted(spans):
        if a >= done:
            out += [text[done:a], SPLIT_MARK]
        done = max(done, b)
    return "".join([*out, text[done:]])


_SPANS = "array<struct<start:int,length:int,value:string>>"


def url_spans(text: Column, rules: UrlRules, with_value: bool = True) -> Column:
    """Array of (start, length, value) of the URLs in a text; `value` null without `with_value`. Null for a null text.
    Texts without a possible URL stay in the JVM."""

    @F.pandas_udf(_SPANS)
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else [(a, b - a, t[a:b] if with_value else None) for a, b in find_urls(t, rules)] for t in s], dtype=object)

    none = F.when(text.isNotNull(), F.from_json(F.lit("[]"), _SPANS))
    return F.coalesce(f(F.when(text.rlike(GUARD), text)), none)


def url_at(text: Column, position: Column, rules: UrlRules) -> Column:
    """(start, length, value) of the URL at a position (from 0), or null: that of the dot or colon there, or the one that
    covers the position."""

    @F.pandas_udf("struct<start:int,length:int,value:string>")
    def f(texts: pd.Series, positions: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p in zip(texts, positions, strict=True):
            hit = url_of(t, int(p), rules) if t is not None and p is not None and p == p else None
            rows.append((hit[0], hit[1] - hit[0], t[hit[0] : hit[1]]) if hit else (None, None, None))
        return pd.DataFrame(rows, columns=["start", "length", "value"]).astype({"start": "Int32", "length": "Int32"})

    got = f(text, position)
    return F.when(got["start"].isNotNull(), got)


def url_mask(text: Column, rules: UrlRules) -> Column:
    """A text up to its first NUL, its URLs replaced by marks. Texts without a possible URL stay in the JVM."""

    @F.arrow_udf("string")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if t is None else mask(t, find_urls(t, rules)) for t in a.to_pylist()], pa.string())

    t = until_nul(text)
    return F.coalesce(f(F.when(t.rlike(GUARD), t)), t)


def url_rules_table(spark: SparkSession, rules: UrlRules):
    """The rules as rows (kind, value)."""
    rows = [("tld", v) for v in sorted(rules.domains)] + [("scheme", v) for v in sorted(rules.schemes)]
    return spark.createDataFrame(rows, "kind string, value string")
