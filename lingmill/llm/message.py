"""The prose of a commit: message without hunks, header lines, trailers, lists and drawings; messages made by machines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingmill.llm.skeleton import prototypes, skeleton

_HEADER = re.compile(r"^(?:commit [0-9a-f]{7,40}\b|Author: |AuthorDate: |Commit: |CommitDate: |Date: |From: |From [0-9a-f]{7,40} |To: |Message-Id: |[0-9a-f]{7,40} .{1,80} \d{4}-\d\d-\d\d$)", re.I)
_SUBJECT = re.compile(r"^Subject: (?:\[PATCH[^\]]*\] ?)?", re.I)
_TRAILER = re.compile(r"^(?:[A-Z][A-Za-z]+(?:-[A-Za-z]+)*-by|Ref|Refs|Fixes|Closes|See-also|Change-Id|Bug|Issue|Cc): ", re.I)
_NO_PROSE = re.compile(r"^\s*(?:[-*+#>|=~`•├└│─]|\$ |\d+[.)] )")
_TAG = re.compile(r"^(?:(?:feat|fix|docs|chore|test|refactor|perf|build|ci|style)(?:\([^)]*\))?!?: |\[[^\]]*\] |#\d+ |[A-Za-z_0-9]{1,30}: )+")
#: Names of accounts that machines write under: marked `[bot]` or ending in `-bot`, and well-known services.
_BOT = re.compile(r"\[bot\]|\w-bot\b|\b(?:dependabot|renovate|github-actions)\b", re.I)
#: Titles, and beginnings of bodies, that tools write.
_MADE_TITLE = re.compile(
    r"(?:Merge (?:branch|tag|pull request|remote-tracking|commit|\S+ into )|Merged? in |Revert \"|Reapply \"|This reverts commit [0-9a-f]{7}|Bump \S+ from \S+ to |Bump version"
    r"|(?:Automatic|Automated) (?:update|merge|commit|build|release|deploy|deployment|sync|import|backup|format|formatting)\b|Auto-?merge|Auto-?generated|Apply formatter|(?:chore|build)\((?:release|deps)[^)]*\)"
    r"|Release v?\d|Update dependency |Updates? the requirements on )",
    re.I,
)
#: What a machine says of its message, anywhere in it.
_MADE = re.compile(r"\[(?:skip ci|ci skip|automated)\]|\b(?:made|created|generated|produced|opened|written) (?:automatically|by (?:a|an|the) (?:machine|bot|robot|script|tool))\b", re.I)
_URL = re.compile(r"\b[a-z]+://\S+|\bwww\.\S+|\S+@\S+\.\w+", re.I)
_END = re.compile(r"(?<=[.!?。])[\"”»’)]*\s+(?:[/—–|-]\s+)?|(?<=…)\s+|\n")
#: A whole sentence of a body ends as one; what trails off, and a line of capitals or of signs, is a fragment.
_WHOLE = re.compile(r"[.!?。][\"”»’)\]]*\s*$")
_TRAILS = re.compile(r"…[\"”»’)\]]*\s*$")
_TABLE = prototypes()


def message(text: Column) -> Column:
    """What stands before the first line that starts with `diff --git`."""
    return F.element_at(F.split(text, "(?m)^diff --git", 2), 1)


@dataclass
class Prose:
    """The sentences of a text in order, and which of them are whole; all others are fragments."""

    machine: bool
    sentences: list[str]
    whole: list[bool]


def _sentences(text: str) -> list[str]:
    if "://" in text or "@" in text or "www." in text:
        text = _URL.sub(" ", text)
    return [s for s in _END.split(text) if s and not s.isspace()]


def prose(text: str, commit: bool) -> Prose:
    """The sentences of a message (`commit`) or of any text. Wrapped lines are joined; in a commit, header lines,
    trailers, lists, headings and drawings are left out, and the title counts as a whole sentence. Marks of machines
    are looked for in the headers and in the whole message."""
    if not commit:
        joined = "\n".join(" ".join(b.split("\n")) for b in text.split("\n\n"))
        found = _sentences(joined)
        return Prose(False, found, [not _TRAILS.search(s) for s in found])
    bot, title, blocks, block, at_top = False, None, [], [], True
    for line in text.split("\n"):
        plain = line if line.isascii() else skeleton(line, _TABLE) if at_top else line
        if at_top:
            if not plain.strip():
                continue
            if _HEADER.match(plain):
                bot |= bool(_BOT.search(plain))
                continue
            at_top = False
            cut = _SUBJECT.match(plain)
            title = line[cut.end() :] if cut and line.isascii() else re.sub(r"^\W*Subject.*?\]\s*", "", line, flags=re.I) if cut else line
            told = _SUBJECT.sub("", plain)
            bot |= bool(_MADE_TITLE.match(told) or _MADE.search(told))
            continue
        if not line.strip() or _TRAILER.match(line) or _NO_PROSE.match(line):
            blocks.append(" ".join(block))
            block = []
        else:
            block.append(line.strip())
    blocks.append(" ".join(block))
    body = " ".join(b for b in blocks if b)
    if bot or _MADE_TITLE.match(body) or _MADE.search(body):
        return Prose(True, [], [])
    top = _sentences(_TAG.sub("", title)) if title else []
    rest = [s for b in blocks if b for s in _sentences(b)]
    return Prose(False, top + rest, [not _TRAILS.search(s) for s in top] + [bool(_WHOLE.search(s)) for s in rest])
