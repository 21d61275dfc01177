"""Model lines: headers, rejects with their reasons, loaded pairs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lingmill.sources.model_text import BAD_WEIGHT, BLANK, MISSING, NO_TEXT, NOT_FINITE, QUOTING, parse_batch, parse_lines

GOOD = {"A\t0.5": ("A", 0.5), "A B\t\t.5": ("A B", 0.5), '"A""B"\t1e-3': ('A"B', 0.001), '"A\tB"\t1': ("A\tB", 1.0), "A\t1.": ("A", 1.0), " A \t 0.5 ": ("A", 0.5), '5"\t1': ('5"', 1.0), "\tA\t1\t": ("A", 1.0), '  "A" \t 1': ("A", 1.0), "A\t3.4028235e38": ("A", 3.4028235e38), "A\t0\r": ("A", 0.0)}
BAD = {"": BLANK, "\t \t": BLANK, '"A" x\t1': QUOTING, '"A\t1': QUOTING, "A\t1e387": NOT_FINITE, "A\t3.5e38": NOT_FINITE, 'A\t"1"': BAD_WEIGHT, "A\t-1": BAD_WEIGHT, "A\t+1": BAD_WEIGHT, "A\t.": BAD_WEIGHT, "A\t1,5": BAD_WEIGHT, "A\t٣": BAD_WEIGHT, "A\tnan": BAD_WEIGHT, '""\t1': NO_TEXT, " \t1": "wrong|blank", None: MISSING}


@pytest.mark.parametrize("line", GOOD)
def test_good(line):
    (text,), (weight,), (reason,) = parse_batch([line])
    assert reason is None and text == GOOD[line][0] and weight == pytest.approx(GOOD[line][1])


@pytest.mark.parametrize("line", BAD)
def test_bad(line):
    text, weight, (reason,) = parse_batch([line])
    assert text == [None] and weight == [None] and re.match(BAD[line], reason)


def test_field_counts():
    assert [r for r in parse_batch(["A", "A\tB\t1", "A\t \t1"])[2]] == ["wrong number of fields: 1", "wrong number of fields: 3", "wrong number of fields: 3"]


RULE = re.compile(r'^(?: *"((?:[^"]|"")*)" *| *([^" \t][^\t]*))\t+ *([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *\Z')


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('ab"\t 01.eE-+,\n', max_size=12), max_size=12))
def test_any_lines(lines):
    texts, weights, reasons = parse_batch(lines)
    for line, text, weight, reason in zip(lines, texts, weights, reasons, strict=True):
        m = RULE.match(line.strip("\t"))
        own = m and (m[1].replace('""', '"') if m[1] is not None else m[2].rstrip(" "))
        ok = bool(m) and bool(own.strip()) and float(m[3] + (m[4] or "")) < 3.4028235677973366e38 and "\n" not in (m[3] + (m[4] or ""))
        assert (reason is None) == ok, line
        if ok:
            assert text == own


def test_headers(spark):
    rows = [(1, "f", 1, "﻿# head", "x"), (2, "f", 2, "# more", "x"), (3, "f", 3, "A\t1", "x"), (4, "f", 4, "# late\t2", "x"), (5, "f", 5, "# late", "x"), (6, "g", 1, "# only", "x"), (7, None, 1, "# null file", "x"), (8, "h", None, "# no number", "x"), (9, "h", 2, None, "x")]
    df = spark.createDataFrame(rows, "line_id long, file_name string, line_no long, line_text string, text string")
    got = {r["line_id"]: r for r in parse_lines(df).collect()}
    assert {i for i, r in got.items() if r["is_header"]} == {1, 2, 6, 7}
    assert got[4]["text"] == "# late" and got[5]["reason"] == "wrong number of fields: 1" and got[8]["reason"] and got[9]["reason"] == MISSING and len(got) == 9
    assert parse_lines(df.limit(0)).count() == 0
