"""Problem 2: visually identical text with different characters.

Method: confusables skeleton. A text is decomposed (NFD), every character is replaced by its prototype from the
look-alike table, characters without an image are dropped, and the result is decomposed again. Texts with equal
skeletons look the same.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.session import cut_lineage

# Letters and signs that look like another one in common fonts, each line in the order of its prototypes.
CYRILLIC = "АВЕКМНОРСТХУҮІЈЅԌԚԜѴаеорсхуүіјѕԁԛԝһӀӏѵ"
CYRILLIC_PROTOTYPES = "ABEKMHOPCTXYYIJSGQWVaeopcxyyijsdqwhllv"
SCHWA_AND_OTHERS = "ӘәӨөѲѳӔӕӠӡ"
SCHWA_AND_OTHERS_PROTOTYPES = "ƏəƟɵƟɵÆæƷʒ"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺϜϒαινορυϲϳ"
GREEK_PROTOTYPES = "ABEZHIKMNOPTYXCMFYaivopucj"
ARMENIAN = "ՍՏԼՕօհոսցզյ"
ARMENIAN_PROTOTYPES = "USLOohnugqj"
CHEROKEE = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏎᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ"
CHEROKEE_PROTOTYPES = "DRTiYAJEWMHYGhZ4bRWSVSLCPKdGB"
COPTIC = "ⲀⲂⲤⲎⲒⲔⲘⲚⲞⲢⲦⲨⲬⲥⲟⲣ"
COPTIC_PROTOTYPES = "ABCHIKMNOPTYXcop"
LISU = "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_PROTOTYPES = "BPdDTGKJCZFMNLSRVHWXYAEIOU"
SYLLABICS = "ᑌᑭᒍᒪᕼᖴᗅᗪᗷᐯ"
SYLLABICS_PROTOTYPES = "UPJLHFADBV"
LATIN = "ɡɑıȷɩɪʋᴏᴄᴠᴡᴢꜱᴜſƖ"
LATIN_PROTOTYPES = "gaijiiuocvwzsufl"
SIGNS = "‐‑․꞉∶⁄∕ǃ"
SIGN_PROTOTYPES = "--.:://!"
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ﬅ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz"}
#: Format characters with an image (number and verse signs that enclose what follows).
VISIBLE_FORMATS = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
#: Characters without an image that are no format characters: fillers and the like.
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str | None]:
    """The look-alike table: listed letters and signs; full- and half-width forms, letters of mathematical fonts and Roman
    numerals by their compatibility mapping; every space as the space; characters without an image (format characters,
    variation selectors, fillers) as nothing. Digits above the line, quotes and dashes of other shape stay as they are:
    a reader sees the difference."""
    lists = ((CYRILLIC, CYRILLIC_PROTOTYPES), (SCHWA_AND_OTHERS, SCHWA_AND_OTHERS_PROTOTYPES), (GREEK, GREEK_PROTOTYPES), (ARMENIAN, ARMENIAN_PROTOTYPES), (CHEROKEE, CHEROKEE_PROTOTYPES))
    lists += ((COPTIC, COPTIC_PROTOTYPES), (LISU, LISU_PROTOTYPES), (SYLLABICS, SYLLABICS_PROTOTYPES), (LATIN, LATIN_PROTOTYPES), (SIGNS, SIGN_PROTOTYPES))
    table: dict[int, str | None] = {ord(x): y for a, b in lists for x, y in zip(a, b, strict=True)} | {ord(x): y for x, y in JOINED.items()}
    letters = dict(table)
    for c in range(sys.maxunicode + 1):
        char = chr(c)
        kind = unicodedata.category(char)
        if kind == "Zs":
            table[c] = " "
        elif (kind == "Cf" and char not in VISIBLE_FORMATS) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or char in FILLERS:
            table[c] = None
        elif unicodedata.decomposition(char).startswith(("<font>", "<wide>", "<narrow>")) or 0x2160 <= c <= 0x217F:
            # half-width marks and vowels stand for themselves, as their ordinary forms do
            table[c] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", char)).translate(letters)
    return table


def skeleton(text: str, table: dict[int, str | None]) -> str:
    out = unicodedata.normalize("NFD", text).translate(table)
    return unicodedata.normalize("NFD", out)


def _skeleton_udf():
    @F.pandas_udf("string")
    def f(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = prototypes()
        for s in texts:
            yield pd.Series([None if t is None else skeleton(t, table) for t in s], dtype=object)

    return f


def with_skeleton(df: DataFrame, text_col: str = "text", out_col: str = "skeleton") -> DataFrame:
    """`df` with one more column, the form under which texts that look the same are equal.

    Null stays null, the empty text is its own skeleton. ASCII-only texts are their own skeleton and stay in the JVM.
    """
    text = F.col(text_col)
    ascii_only = F.octet_length(text) == F.length(text)
    return df.withColumn(out_col, F.coalesce(_skeleton_udf()(F.when(~ascii_only, text)), text))


def lookalike_classes(df: DataFrame, id_col: str, text_col: str = "text", within: list[str] | None = None) -> DataFrame:
    """One row per row of `df` with a text: (id, class, form, *within).

    `class` is equal for texts that look the same (and agree in the columns `within`), `form` for texts with the same
    characters; both are 128-bit digests, so no text is shuffled. Null texts have no class; null `within` values count
    as equal. Repeated rows keep their own row. Other columns are ignored.
    """
    keys = within or []
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).filter(F.col("text").isNotNull())
    named = with_skeleton(base, "text", "skel")
    parts = [F.coalesce(F.to_json(F.struct(F.col(f"k{i}").alias("k"))), F.lit("{}")) for i in range(len(keys))]
    return named.select(
        F.col("id").alias(id_col),
        F.md5(F.concat_ws("\u0001", *parts, F.col("skel"))).alias("class"),
        F.md5(F.col("text")).alias("form"),
        *(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)),
    )


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str = "text", within: list[str] | None = None, rows_per_task: int = 20_000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts look the same although their characters differ.

    Classes with one form (exact copies only, however many) are dropped by a pre-aggregated min/max of the forms before
    any pairing, so a hot text never meets itself. Classes with several forms are joined form against form; one with more
    than `rows_per_task` rows is cut into as many parts as that takes, each of which meets the whole class in a task of
    its own. Where two forms are both frequent, so are their pairs: `lookalike_classes` says the same in one row per row.
    """
    rows = cut_lineage(lookalike_classes(df, id_col, text_col, within).select(F.col(id_col).alias("id"), F.unhex("class").alias("class"), F.unhex("form").alias("form")))
    mixed = rows.groupBy("class").agg(F.min("form").alias("lo"), F.max("form").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    kept = rows.join(mixed.select("class", F.ceil(F.col("n") / rows_per_task).cast("int").alias("parts")), "class")
    a = kept.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("a")
    b = kept.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    same = (F.col("a.class") == F.col("b.class")) & (F.col("a.part") == F.col("b.part"))
    return a.join(b, same & (F.col("a.form") != F.col("b.form")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
