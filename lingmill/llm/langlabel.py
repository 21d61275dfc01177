"""Problem 4: missing or wrong language labels, and texts in several languages.

Method: hyperdimensional profiles. Every letter has a random bipolar vector; an n-gram's vector is the product of its
letters' vectors, each permuted by its place; a word's vector is the bundle (sum) of its n-grams', a text's that of its
words'. A language's prototype bundles its samples. Texts are compared with the prototypes by cosine, both without what
all languages have in common.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingmill.llm.message import prose
from lingmill.llm.mojibake import CharModel, Repairer, Transformation
from lingmill.llm.skeleton import prototypes

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CODE_SIGN = re.compile(r"[\d_/\\<>{}=]|[a-z][A-Z]")
_GREEK_CYRILLIC = re.compile("[\u0370-\u04ff]")
_CAPITALS = re.compile("[\u0400-\u042f]")
_COMBINING = set(map(chr, range(0x300, 0x370)))
_CODE = re.compile(r"\S*[\d_/\\<>{}=]\S*|\b[a-z]+[A-Z]\w*")

# Notations of languages besides the code and the English name of the languages table (ISO 639 codes,
# native names).
NOTATIONS = {
    "RU": "ru rus russian русский", "EN": "en eng english", "NL": "nl nld dut dutch nederlands", "FI": "fi fin finnish suomi",
    "SW": "sw swe sv swedish svenska", "UK": "uk ukr ukrainian українська", "BG": "bg bul bulgarian", "BE": "be bel belarusian",
    "DE": "de deu ger german deutsch", "FR": "fr fra fre french français", "ES": "es spa spanish español", "KK": "kk kaz kazakh",
    "PL": "pl pol polish polski", "TT": "tt tat tatar", "IT": "it ita italian italiano", "PT": "pt por portuguese português",
    "DA": "da dan danish dansk", "CS": "cs ces cze czech čeština", "NO": "no nor nb nob nn norwegian norsk",
}


def label_code(label: Column, known: dict[str, str]) -> Column:
    """The language code a label stands for, null if it stands for none: code, three-letter code or name, in any case,
    with white space around it and a region or script after it (`en-XX`, `en_US`)."""
    pairs = {w: code for code, words in NOTATIONS.items() for w in words.split()} | {c.lower(): c for c in known} | {n.lower(): c for c, n in known.items()}
    table = F.create_map(*(F.lit(x) for kv in sorted(pairs.items()) for x in kv))
    plain = F.lower(F.trim(F.regexp_replace(label, "[\\s\\u00A0]+", " ")))
    return F.coalesce(F.element_at(table, plain), F.element_at(table, F.regexp_extract(plain, "^(\\p{L}{2,3})[-_].*$", 1)))


class Profiles:
    """Letter vectors, language prototypes, and the words' bundles.

    A text's vector is the sum of its words' bundles. Bundles of words, and their products with the prototypes, are
    remembered up to a bound (`memory` words of `dims` bytes); what is forgotten is made again."""

    def __init__(self, dims: int = 2048, n: int = 3, seed: int = 17, memory: int = 16_384):
        self.dims, self.n, self.seed, self.memory = dims, n, seed, memory
        self.letters: dict[str, list[np.ndarray]] = {}
        self.words: dict[str, int] = {}
        self.codes: list[str] = []

    def letter(self, c: str) -> list[np.ndarray]:
        """The letter's vector, permuted once for each place."""
        if c not in self.letters:
            if len(self.letters) >= self.memory:
                self.letters.clear()
            rng = np.random.default_rng([self.seed, zlib.crc32(c.encode("utf-8", "surrogatepass"))])
            v = rng.choice(np.array([-1, 1], dtype=np.int8), self.dims)
            self.letters[c] = [np.roll(v, self.n - 1 - k) for k in range(self.n)]
        return self.letters[c]

    def gram(self, g: str) -> np.ndarray:
        v = self.letter(g[0])[0]
        for k in range(1, self.n):
            v = v * self.letter(g[k])[k]
        return v

    def spell(self, w: str) -> list[str]:
        s = f"  {w} "
        return [s[i : i + self.n] for i in range(len(s) - self.n + 1)]

    def fit(self, samples: list[tuple[str, str]]) -> Profiles:
        """Prototypes of labelled texts (language, text), each language with equal mass."""
        self.codes = sorted({lang for lang, _ in samples})
        proto = np.zeros((len(self.codes), self.dims), dtype=np.float32)
        for i, c in enumerate(self.codes):
            for g, n in Counter(g for lang, t in samples if lang == c for w in _WORD.findall(t) for g in self.spell(w.lower())).items():
                proto[i] += n * self.gram(g).astype(np.float32)
        proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
        proto -= proto.mean(axis=0)
        self.proto = proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
        self.bundles, self.products = np.zeros((0, self.dims), dtype=np.int8), np.zeros((0, len(self.codes)), dtype=np.float64)
        return self

    def bundle(self, w: str) -> np.ndarray:
        """The sum of a word's n-gram vectors."""
        v = np.zeros(self.dims, dtype=np.int32)
        for g in self.spell(w):
            v += self.gram(g)
        return v

    def word(self, w: str) -> int | None:
        """The row of a word in `bundles` and `products`; None for one with more n-grams than 8 bits can count."""
        row = self.words.get(w)
        if row is None:
            if len(w) > 120:
                return None
            row = len(self.words)
            if row >= len(self.bundles):
                more = max(1024, row // 2)
                self.bundles = np.concatenate([self.bundles, np.zeros((more, self.dims), dtype=np.int8)])
                self.products = np.concatenate([self.products, np.zeros((more, len(self.codes)))])
            v = self.bundle(w)
            self.bundles[row], self.products[row] = v, self.proto @ v.astype(np.float32)
            self.words[w] = row
        return row

    def cosine(self, words: list[str]) -> np.ndarray:
        """Cosine of a text (a list of at least one word) with each prototype: its vector is bundled, and its own norm is
        taken."""
        if len(self.words) + min(len(words), self.memory // 2) > self.memory:
            self.words.clear()
        if len(words) <= self.memory // 2 and sum(map(len, words)) + len(words) < 32_000:
            # as many n-grams as 16 bits can count
            known = self.words
            rows = [known[w] if w in known else self.word(w) for w in words]
            if None not in rows:
                f = np.add.reduce(self.bundles.take(rows, axis=0), axis=0, dtype=np.int16).astype(np.float32)
                return (self.products.take(rows, axis=0).sum(axis=0) / max(1e-9, float(f @ f) ** 0.5)).astype(np.float32)
        v, dots = np.zeros(self.dims, dtype=np.int64), np.zeros(len(self.codes))
        for at in range(0, len(words), self.memory // 2):
            part = words[at : at + self.memory // 2]
            if at and len(self.words) + len(part) > self.memory:
                self.words.clear()
            rows = [r for w in part if (r := self.word(w)) is not None]
            if rows:
                v += self.bundles[rows].sum(axis=0, dtype=np.int32)
                dots += self.products[rows].sum(axis=0)
            for w in part:
                if w not in self.words:
                    own = self.bundle(w)
                    v += own
                    dots += self.proto @ own.astype(np.float32)
        f = v.astype(np.float64)
        return (dots / max(1e-9, float(np.sqrt(f @ f)))).astype(np.float32)

    def cosines(self, texts: list[list[str]]) -> np.ndarray:
        """`cosine` of each text."""
        return np.stack([self.cosine(t) for t in texts]) if texts else np.zeros((0, len(self.codes)), dtype=np.float32)


def sentence_words(sentence: str, table: dict) -> list[str]:
    """Lower-case words of a sentence without code; look-alike letters are brought back to the script of their word."""
    if _CODE_SIGN.search(sentence):
        sentence = _CODE.sub(" ", sentence)
    words = _WORD.findall(sentence.lower())
    if _GREEK_CYRILLIC.search(sentence):
        for i, w in enumerate(words):
            # a word with letters of two scripts is a Latin word with look-alikes, or the other way round
            if not w.isascii() and any(c.isascii() for c in w) and _GREEK_CYRILLIC.search(w):
                low = w.translate(table)
                words[i] = w.translate(_BACK) if _GREEK_CYRILLIC.search(low) else low
    return words


# Latin letters standing in Cyrillic words.
_BACK = str.maketrans("ABEKMHOPCTXYaeopcxyi", "АВЕКМНОРСТХУаеорсхуі")


class Identifier:
    """Languages of the sentences of a text."""

    def __init__(self, samples: list[tuple[str, str]], learned: list[Transformation] | None = None, min_words: int = 4, margin: float = 0.05, floor: float = 0.1, least: float = 0.75, sharpness: float = 20.0, memory: int = 50_000):
        self.profiles = Profiles().fit(samples)
        self.repairer = Repairer(learned, CharModel.fit([t for _, t in samples])) if learned is not None else None
        self.min_words, self.margin, self.floor, self.least, self.sharpness, self.memory = min_words, margin, floor, least, sharpness, memory
        self.table = prototypes()
        # one form for full-width letters, ligatures, spaces and characters without an image; letters keep their script
        self.forms = {k: v for k, v in self.table.items() if v is None or v == " " or 0xFF01 <= k <= 0xFF5E or 0xFB00 <= k <= 0xFB06}
        self.others = {chr(k) for k in self.forms if k != 32}
        known = {c for _, t in samples for c in t}
        self.usual = known | {c.upper() for c in known} | set(map(chr, range(128))) | self.others | _COMBINING | set("–—‘’“”„…€")
        #: None: too few words; otherwise its language, None if it isn't clear, and the confidence
        self.seen: dict[str, tuple[str | None, float] | None] = {}

    def clean(self, text: str) -> str:
        """Without garbling where it can be undone, in one form. What the characters of a text rule out is not tried:
        text in the samples' own characters, without many capitals of another script, is not garbled so that its
        language changes."""
        if text.isascii():
            return text
        chars = set(text)
        if self.repairer and (chars - self.usual or len(_CAPITALS.findall(text)) * 4 > len(_GREEK_CYRILLIC.findall(text)) > 0):
            text = self.repairer.text(text)[0]
            chars = set(text)
        if not self.others.isdisjoint(chars):
            text = text.translate(self.forms)
        return text if _COMBINING.isdisjoint(chars) else unicodedata.normalize("NFC", text)

    def sentences(self, sentences: set[str]) -> None:
        """Looks at sentences not seen yet."""
        fresh = [s for s in sentences if s not in self.seen]
        if len(self.seen) + len(fresh) > self.memory:
            self.seen.clear()
            fresh = list(sentences)
        words = [sentence_words(s, self.table) for s in fresh]
        ok = [i for i, w in enumerate(words) if len(w) >= self.min_words and sum(len(x) > 1 for x in w) >= 3]
        self.seen.update(dict.fromkeys(fresh))
        cos = self.profiles.cosines([words[i] for i in ok])
        if not len(cos):
            return
        first, sure, clear = self.judge(cos)
        for i, f, p, yes in zip(ok, first, sure, clear, strict=True):
            self.seen[fresh[i]] = (self.profiles.codes[f] if yes else None, float(p))

    def judge(self, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each row of cosines, its confidence, and whether it is clear: near enough to its prototype
        (a language without one comes near none), and leaving the next one behind."""
        first = cos.argmax(axis=1)
        top = cos[np.arange(len(cos)), first]
        sure = 1 / np.exp((cos - top[:, None]) * self.sharpness).sum(axis=1)
        rest = cos.copy()
        rest[np.arange(len(cos)), first] = -np.inf
        return first, sure, (top - rest.max(axis=1) >= self.margin) & (top >= self.floor)

    def pooled(self, sentences: list[str]) -> tuple[str, float, bool]:
        """(language, confidence, clear) of the sum of several sentences' bundles."""
        first, sure, clear = self.judge(self.profiles.cosines([[w for s in sentences for w in sentence_words(s, self.table)]]))
        return self.profiles.codes[first[0]], float(sure[0]), bool(clear[0])

    def stretches(self, texts: list[str], commits: list[bool]) -> list[list[tuple[str, float, int, int, bool]]]:
        """[(language, confidence, sentences, fragments, clear)] of each text's stretches, in order; empty for texts made
        by machines.

        Whole sentences with a clear language make the stretches. Others, and fragments, belong to the stretch around them
        (counted where their own language is clear and the same), and so does a stretch whose language no sentence of the
        text shows with the confidence `least`, unless the text has no other. Where no whole sentence is clear, the bundles
        of the whole sentences, or else of the fragments, are summed, and the text is one stretch in the best language."""
        proses = [prose(self.clean(t), c) for t, c in zip(texts, commits, strict=True)]
        self.sentences({s for p in proses for s in p.sentences})
        out = []
        for p in proses:
            known = [(s, w) for s, w in zip(p.sentences, p.whole, strict=True) if self.seen[s]]
            whole = [s for s, w in known if w]
            if not any(self.seen[s][0] for s in whole):
                if parts := whole or [s for s, _ in known]:
                    lang, conf, clear = self.pooled(parts)
                    out.append([(lang, conf, len(whole), len(known) - len(whole), clear)])
                else:
                    out.append([])
                continue
            best: dict[str, float] = {}
            for s in whole:
                lang, conf = self.seen[s]
                if lang:
                    best[lang] = max(conf, best.get(lang, 0))
            main = max(best, key=best.__getitem__)
            runs: list[list] = []
            for s, is_whole in known:
                lang, conf = self.seen[s]
                if not lang or (lang != main and best.get(lang, 0) < self.least):
                    continue
                if runs and runs[-1][0] == lang:
                    runs[-1][1] += conf
                    runs[-1][2 if is_whole else 3] += 1
                elif is_whole:
                    runs.append([lang, conf, 1, 0])
            out.append([(lang, conf / (n + m), n, m, True) for lang, conf, n, m in runs])
        return out


def identify(df: DataFrame, samples: list[tuple[str, str]], learned: list[Transformation] | None = None, text_col: str = "text", commit_col: str = "commit", out_col: str = "langs") -> DataFrame:
    """`df` with an array column of stretches (language, confidence, sentences, fragments, clear), in the order of the
    text; `sentences` counts whole ones.

    `commit_col` (boolean) says which texts are commit messages. Null, blank and wordless texts, texts without a sentence
    or fragment of four words and messages made by machines give an empty array. Repeated rows get the same answer each.
    """

    @F.pandas_udf("array<struct<language:string,confidence:double,sentences:int,fragments:int,clear:boolean>>")
    def f(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ident = Identifier(samples, learned)
        for texts, commits in batches:
            yield pd.Series(ident.stretches([t or "" for t in texts], [bool(c) for c in commits]), dtype=object)

    # not to be evaluated once more where a filter on the result is pushed down
    return df.withColumn(out_col, f.asNondeterministic()(F.col(text_col), F.col(commit_col)))


def label_cases(df: DataFrame, label_col: str, known: dict[str, str], langs_col: str = "langs") -> DataFrame:
    """`df` with `code` (what the label says, null if unusable), `languages` (those of whole sentences, in the order of the
    text) and `case`: `missing`, `wrong`, `mixed`, or null, also where no language has a whole sentence. A language that
    isn't clear gives a text without a label its language, but calls no label wrong."""
    used = F.array_distinct(F.expr(f"transform(filter({langs_col}, x -> x.sentences > 0), x -> x.language)"))
    out = df.withColumn("code", label_code(F.col(label_col), known)).withColumn("languages", used)
    case = F.when(F.size("languages") == 0, F.lit(None)).when(F.size("languages") > 1, "mixed").when(F.col("code").isNull(), "missing").when((F.col("code") != F.element_at("languages", 1)) & F.exists(langs_col, lambda x: x["clear"]), "wrong")
    return out.withColumn("case", case)
