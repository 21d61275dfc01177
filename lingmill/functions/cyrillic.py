"""Cyrillic gate of the Russian detector and the Cyrillic test of the trainer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter_counts(text: Column) -> tuple[Column, Column]:
    """(letters, letters from А to я)"""
    return F.length(F.regexp_replace(text, "[^\\p{L}]", "")), F.length(F.regexp_replace(text, "[^А-я]", ""))


def has_cyrillic_letters(text: Column, percent: int) -> Column:
    """Whether at least `percent` of a text's letters are Cyrillic, the threshold cut to a whole number of letters: with
    few letters it is 0 and every text passes."""
    if percent <= 0:
        return F.lit(True)
    letters, cyrillic = letter_counts(text)
    return F.floor(F.lit(percent) * letters / 100.0) <= cyrillic


def cyrillic_percent(text: Column) -> Column:
    """Cyrillic letters in percent of all letters, cut to a whole number; null without letters."""
    letters, cyrillic = letter_counts(text)
    return F.when(letters > 0, F.floor(cyrillic * 100.0 / letters).cast("int"))


def has_cyrillic_char(word: Column) -> Column:
    return word.rlike("[А-яЁё]")
