"""Problem 5: garbled text from wrong character encoding.

Method: garbled records are joined with clean near-twins on the text stripped of non-ASCII characters; the runs of
non-ASCII characters between the same ASCII characters are aligned, and each aligned pair is explained by a
transformation (decoded with w what was encoded with r, once or twice). The transformations that twins confirm are the
learned mappings; they are applied to all remaining records.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The encodings among which twins decide.
ENCODINGS = ["cp1252", "cp1250", "cp1251", "koi8-u", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac-roman", "mac-cyrillic", "iso8859-1", "iso8859-2", "iso8859-5", "cp1253", "cp1254", "cp1257"]

LOST = "�"
_HIGH = re.compile(r"[^\x00-\x7f]+")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_NOT_ALNUM = bytes(c for c in range(128) if not chr(c).isalnum())
_RUNS = re.compile(r"[\x00-\x7f]+")
_SEGMENT = re.compile(r"(?<=[.!?])[ \t]+")
_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_EDGE = re.compile(r"^[^\w\x80-\U0010ffff]+|[^\w\x80-\U0010ffff]+$")
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_LATIN = re.compile("[A-Za-z]")
_FOREIGN = re.compile("[\u0370-\u052f]")
#: Drawn frames and trees: no letters stand between their lines.
_FRAME = re.compile("^[─-╿\\s]+$")
#: What gets lost on the way: soft hyphens and C1 controls.
_FADED = re.compile("[\u0080-\u009f­]")


def encode(text: str, encoding: str) -> bytes | None:
    """`text` in a single-byte encoding; bytes without a character there stand as C1 controls. None if impossible."""
    out, at = b"", 0
    while True:
        try:
            return out + text[at:].encode(encoding)
        except UnicodeEncodeError as e:
            stop = at + e.start
            if not 0x80 <= ord(text[stop]) < 0xA0:
                return None
            out += text[at:stop].encode(encoding) + bytes([ord(text[stop])])
            at = stop + 1


@dataclass(frozen=True)
class Transformation:
    """Text in `right` was decoded with `wrong`, `times` times."""

    wrong: str
    right: str
    times: int = 1

    def undo(self, text: str) -> str | None:
        for _ in range(self.times):
            raw = encode(text, self.wrong)
            if raw is None:
                return None
            try:
                text = raw.decode(self.right)
            except UnicodeDecodeError:
                return None
        return text

    def apply(self, text: str) -> str | None:
        """What became of `text`; None if it can't be encoded. Each character's fate depends on it alone."""
        table = _TABLES.setdefault(self, _Garbled(self))
        try:
            return text.translate(table) if text.isascii() else "".join(table[ord(c)] for c in text)
        except KeyError:
            return None

    @property
    def multibyte(self) -> bool:
        return self.right == "utf-8"


class _Garbled(dict):
    """The garbled form of each character, filled as characters turn up."""

    def __init__(self, t: Transformation):
        self.t = t

    def __missing__(self, code: int) -> str:
        text = chr(code)
        for _ in range(self.t.times):
            raw = text.encode() if self.t.multibyte else encode(text, self.t.right)
            if raw is None:
                raise KeyError(code)
            text = "".join(chr(b) if (d := bytes([b]).decode(self.t.wrong, "replace")) == LOST and 0x80 <= b < 0xA0 else d for b in raw)
        self[code] = text
        return text


_TABLES: dict[Transformation, _Garbled] = {}


def candidates() -> list[Transformation]:
    """Every transformation that twins can confirm, the likelier first."""
    multi = [Transformation(w, "utf-8", n) for n in (1, 2) for w in ENCODINGS]
    return multi + [Transformation(w, r) for w in ENCODINGS for r in ENCODINGS if w != r]


@dataclass
class CharModel:
    """Interpolated character trigrams of clean text, without regard to case, with a toll on broken case."""

    tri: Counter = field(default_factory=Counter)
    bi: Counter = field(default_factory=Counter)
    uni: Counter = field(default_factory=Counter)
    total: int = 0

    @classmethod
    def fit(cls, texts: list[str]) -> CharModel:
        m = cls()
        m.add(texts)
        return m

    @classmethod
    def fit_column(cls, df: DataFrame, text_col: str = "text") -> CharModel:
        """The same of all texts of a column, which are counted where they lie; only one row per distinct n-gram of
        characters reaches the driver."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = cls()
            for batch in batches:
                m.add(batch.column(0).to_pylist())
            grams = [("".join(g), n) for c in (m.uni, m.bi, m.tri) for g, n in c.items()]
            yield pa.RecordBatch.from_pydict({"gram": pa.array([g for g, _ in grams], pa.string()), "n": pa.array([n for _, n in grams], pa.int64())})

        text = F.col(text_col)
        m = cls()
        for gram, n in df.select(text.alias("text")).filter("text is not null").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            if len(gram) == 1:
                m.uni[gram] = n
            else:
                (m.bi if len(gram) == 2 else m.tri)[tuple(gram)] = n
        m.total = sum(m.uni.values())
        return m

    def add(self, texts: list[str]) -> None:
        for word, n in Counter(w for t in texts for w in _WORD.findall(t.lower())).items():
            s = f"^{word}$"
            for counts, grams in ((self.uni, s), (self.bi, zip(s, s[1:], strict=False)), (self.tri, zip(s, s[1:], s[2:], strict=False))):
                for g in grams:
                    counts[g] += n
        self.total = sum(self.uni.values())

    def commonness(self, chars: str) -> float:
        """Mean log frequency of the characters."""
        return sum(math.log((self.uni[c] + 0.1) / (self.total + 1)) for c in chars.lower()) / max(1, len(chars))

    def score(self, word: str) -> float:
        """Log probability of a token, its outer punctuation aside; higher is cleaner."""
        s = f"^{word.lower()}$"
        out = 0.0
        for i in range(1, len(s)):
            c = s[i]
            p = 1e-7 + 0.05 * self.uni[c] / max(1, self.total)
            if n := self.uni[s[i - 1]]:
                p += 0.25 * self.bi[s[i - 1], c] / n
            if i > 1 and (n := self.bi[s[i - 2], s[i - 1]]):
                p += 0.7 * self.tri[s[i - 2], s[i - 1], c] / n
            out += math.log(p)
        if not (word.islower() or word.isupper() or word[1:].islower()):
            out -= 4.0
        return out


_CANDIDATES = candidates()
_MULTI = [t for t in _CANDIDATES if t.multibyte]


class _Origins(dict):
    """For a clean character, the candidates by the first character of its garbled form, filled as characters turn up."""

    def __missing__(self, clean: str) -> dict[str, list[Transformation]]:
        out: dict[str, list[Transformation]] = {}
        for t in _CANDIDATES:
            if (made := t.apply(clean)) and made != clean:
                out.setdefault(made[0], []).append(t)
        self[clean] = out
        return out


_ORIGINS = _Origins()


def explain(garbled: str, clean: str, model: CharModel, surely: bool) -> Transformation | None:
    """The transformation that made `garbled` of `clean`, both runs of non-ASCII characters, if there is one.

    Between two single-byte encodings either side may have come from the other; unless `surely` (the clean one is the
    more frequent), the characters of the clean one must be much commoner."""
    if LOST in garbled or LOST in clean:
        return None
    i = next((k for k, (x, y) in enumerate(zip(garbled, clean, strict=False)) if x != y), None)
    if i is None:
        return None
    faded, found = None, None
    for t in _ORIGINS[clean[i]].get(garbled[i], ()):
        if t.multibyte and i:  # it leaves no character as it is
            continue
        made = t.apply(clean)
        if made is None:
            continue
        if made != garbled:
            faded = _FADED.sub("", garbled) if faded is None else faded
            if not t.multibyte or _FADED.sub("", made) != faded:
                continue
        if t.multibyte or surely or model.commonness(clean) > model.commonness(garbled) + 1.5:
            found = t
            break
    # what some encoding makes readable was garbled itself
    if found and any((d := t.undo(clean)) and d != clean and len(d) < len(clean) and model.commonness(d) > model.commonness(clean) for t in _MULTI):
        return None
    return found


def high_segments(text: str) -> Iterator[str]:
    """The sentences (cut at sentence ends and line ends) with non-ASCII characters."""
    for line in text.split("\n"):
        if not line.isascii():
            for seg in _SEGMENT.split(line):
                if not seg.isascii():
                    yield seg


def twin_keys(text: str) -> Iterator[tuple[bytes, str]]:
    """(key, runs of non-ASCII characters) of a text's sentences.

    Near-twins share the key: the ASCII characters, if there are 8 letters or digits among them and they are no smaller
    part of the sentence than the rest (a few words or a header say nothing of a sentence in another script), and, for
    sentences of other scripts, the ASCII characters with the places of all others, which single-byte encodings keep.
    """
    for seg in high_segments(text):
        low = seg.encode("ascii", "ignore")
        plain, high = len(low.translate(None, _NOT_ALNUM)), len(seg) - len(low)
        words, script = plain >= 8 and 4 * plain >= high, high >= 20
        if words or script:
            runs = _RUNS.sub("\x01", seg)
            if words:
                yield b"s" + low, runs
            if script:
                yield b"p" + seg.encode("ascii", "replace"), runs


_KEYED = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("runs", T.StringType(), False), T.StructField("n", T.LongType(), False)])


def twin_pairs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(runs, modal, surely): aligned runs of non-ASCII characters of a sentence and of the commonest sentence with the
    same key. Equal sentences are counted before they are shuffled, so hot texts collapse; a class of near-twins meets
    only its commonest member, never itself, and is aggregated and joined, so none is held in memory."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for key, runs in twin_keys(text):
                    seen[blake2b(key, digest_size=16).digest(), runs] += 1
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in seen], pa.binary()), "runs": pa.array([r for _, r in seen], pa.string()), "n": pa.array(seen.values(), pa.int64())})

    text = F.col(text_col)
    parts = df.select(text.alias("text")).filter(F.octet_length("text") > F.length("text")).mapInArrow(keyed, _KEYED)
    # one shuffle, by key; counting, the commonest form and the join keep its partitioning (no column being null, both
    # sides of the join read the same exchange)
    counted = parts.repartition("key").groupBy("key", "runs").agg(F.sum("n").alias("n"))
    modal = counted.groupBy("key").agg(F.count("*").alias("forms"), F.max(F.struct("n", "runs")).alias("m")).filter("forms > 1")
    met = counted.join(modal.select("key", F.col("m.runs").alias("modal"), F.col("m.n").alias("modal_n")), "key").filter("runs <> modal")
    return met.select("runs", "modal", (F.col("modal_n") > F.col("n")).alias("surely"))


def learn(df: DataFrame, clean: list[str] | CharModel, text_col: str = "text", min_support: int = 2, min_share: float = 0.0005, enough: int = 30) -> list[Transformation]:
    """The transformations that at least `min_support` near-twins in `df`, and a share `min_share` of the explained ones
    (against explanations by chance) or `enough` of them, confirm, the best confirmed first.

    Only one count per candidate reaches the driver (a few hundred at most, whatever the size of `df`)."""
    model = clean if isinstance(clean, CharModel) else CharModel.fit(clean)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        support: Counter = Counter()
        for batch in batches:
            for runs, modal, surely in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = ([r for r in s.split("\x01") if r] for s in (runs, modal))
                if len(x) != len(y):
                    continue
                x, y = zip(*[(p, q) for p, q in zip(x, y, strict=True) if p != q], strict=True) if x != y else ((), ())
                if not x:
                    continue
                for g, c, sure in (("".join(x), "".join(y), surely), ("".join(y), "".join(x), False)):
                    if t := explain(g, c, model, sure):
                        support[t.wrong, t.right, t.times] += 1
                        break
        k = list(support)
        yield pa.RecordBatch.from_pydict({"wrong": pa.array([w for w, _, _ in k], pa.string()), "right": pa.array([r for _, r, _ in k], pa.string()), "times": pa.array([n for _, _, n in k], pa.int32()), "support": pa.array([support[x] for x in k], pa.int64())})

    found = twin_pairs(df, text_col).mapInArrow(infer, "wrong string, right string, times int, support long").groupBy("wrong", "right", "times").agg(F.sum("support").alias("support")).collect()
    kept = sorted((r for r in found if r["support"] >= max(min_support, min(enough, min_share * sum(x["support"] for x in found)))), key=lambda r: (-r["support"], r["wrong"], r["right"], r["times"]))
    return [Transformation(r["wrong"], r["right"], r["times"]) for r in kept]


class Repairer:
    """Applies learned transformations to texts; decisions on tokens are remembered up to a bound."""

    def __init__(self, learned: list[Transformation], model: CharModel, memory: int = 100_000):
        self.multi = [t for t in learned if t.multibyte]
        self.single = [t for t in learned if not t.multibyte]
        self.model, self.memory = model, memory
        self.seen: dict[str, tuple | None] = {}
        self.losses: dict[str, tuple[float, ...]] = {}
        letters = sorted(c for c in model.uni if ord(c) > 127)
        letters += [c.upper() for c in letters if len(c.upper()) == 1 and c.upper() != c] + list("’‘“”„–—…€£§©°±µ×")
        #: learned mappings of single characters whose garbled form lost a byte on the way
        self.faded: dict[str, str] = {}
        for t in self.multi:
            for c in letters:
                g = t.apply(c)
                if g and (f := _FADED.sub("", g)) != g and f and not f.isascii():
                    best = self.faded.get(f)
                    if best is None or model.uni[c] > model.uni[best]:
                        self.faded[f] = c

    def _likely(self, c: str) -> bool:
        """Whether restored text may hold a character: letters of the samples or of the Latin, Greek and Cyrillic blocks,
        marks and symbols; no control, private or unassigned character, and no letter of a script the samples lack."""
        code = ord(c)
        if code < 0x80 or 0xA0 <= code < 0x530 or c.lower() in self.model.uni:
            return True
        return unicodedata.category(c)[0] in "PSMNZ"

    def _score(self, token: str) -> float:
        """By words: white space of any kind separates them, and what has no image counts for nothing."""
        return sum(self.model.score(_EDGE.sub("", w)) for w in _INVISIBLE.sub("", token).split())

    def _gain(self, token: str, restored: str, own: float) -> float:
        """How much cleaner a token gets by a single-byte transformation, as evidence: 0 if what comes out isn't a word of
        3 letters or more that clean text could hold."""
        gain = self._score(restored) - own
        if gain <= 0:
            return gain
        letters = sum(map(str.isalpha, restored))
        if sum(map(str.isalpha, "".join(_HIGH.findall(restored)))) == 0 or _FOREIGN.search(token) and _LATIN.search(token):
            return 0.0  # a look-alike letter in a word of another script
        return gain if letters >= 3 and not _FRAME.search(token) and own + gain > -6.5 * (len(restored) + 1) else 0.0

    def token(self, token: str) -> tuple[str | None, tuple[float, ...], tuple[str | None, ...], str | None] | None:
        """(text by a multi-byte transformation or None, gain by each single-byte one, its text, text by a faded form);
        None if nothing speaks for a garbled token."""
        if token in self.seen:
            return self.seen[token]
        own = best = self._score(token)
        multi = None
        if _HIGH_RUN.search(token):
            for t in self.multi:
                changed = False

                def fix(m: re.Match, t: Transformation = t) -> str:
                    nonlocal changed
                    d = t.undo(m[0])
                    if d is None or d == m[0] or (t.times > 1 and d.isascii()):
                        return m[0]
                    changed = True
                    return d

                d = _HIGH_RUN.sub(fix, token)
                if changed and all(self._likely(c) for c in d):
                    s = self._score(d)
                    if s > max(best, own + 1.0):
                        multi, best = d, s
        gains, texts, faded = [], [], None
        if multi is None:
            for t in self.single:
                d = _HIGH.sub(lambda m, t=t: t.undo(m[0]) or m[0], token)
                gains.append(0.0 if d == token else self._gain(token, d, own))
                texts.append(d)
            low = token
            for f, c in self.faded.items():
                if f in low:
                    low = low.replace(f, c)
            if low != token and self._score(low) > own + 6.0:
                faded = low
        if len(self.seen) >= self.memory:
            self.seen.clear()
            self.losses.clear()
        self.seen[token] = out = (multi, tuple(gains), tuple(texts), faded) if multi or faded or max(gains, default=0.0) > 0.0 else None
        if out is None:
            self.losses[token] = tuple(gains)
        return out

    def _pick(self, looked: dict[str, tuple | None]) -> int | None:
        """The single-byte transformation for which the distinct tokens together speak, if there is one."""
        gains = [g for t, x in looked.items() if (g := x[1] if x else self.losses.get(t, ()))]
        if not gains:
            return None
        total = [sum(g[i] for g in gains) for i in range(len(self.single))]
        i = max(range(len(total)), key=total.__getitem__)
        return i if total[i] >= 12.0 and (total[i] >= 25.0 or sum(g[i] > 3.0 for g in gains) >= 2) else None

    def segment(self, seg: str, looked: dict[str, tuple | None], history: int | None) -> tuple[str, bool]:
        """`history`: the transformation that speaks from the whole text; it holds for a sentence that doesn't reach the
        threshold alone but gets cleaner by it."""
        if not any(looked.values()):
            return seg, False
        pick = self._pick(looked)
        if pick is None and history is not None and sum(g[history] for t, x in looked.items() if (g := x[1] if x else self.losses.get(t, ()))) > 0:
            pick = history
        fixed = {t: x[0] or (x[2][pick] if pick is not None and x[1] and x[2][pick] != t and x[1][pick] >= 0 else None) or x[3] for t, x in looked.items() if x}
        if not any(fixed.values()):
            return seg, False
        return _TOKEN.sub(lambda m: fixed.get(m[0]) or m[0], seg), True

    def text(self, text: str) -> tuple[str, bool, bool]:
        """(restored text, whether some of it was garbled, whether some of it is lost)

        A text has one history, so evidence for a single-byte transformation is also summed over all its sentences."""
        lost, any_fixed = LOST in text, False
        lines = text.split("\n")
        looked = {seg: {t: self.token(t) for t in _TOKEN.findall(seg)} for seg in high_segments(text)}
        history = self._pick({t: x for tokens in looked.values() for t, x in tokens.items()}) if len(looked) > 1 and any(x for tokens in looked.values() for x in tokens.values()) else None
        # letters of two scripts in a word: garbled, but by an encoding that no twin taught
        crossed = history is not None and any(x and x[1] and x[1][history] > 0 and _FOREIGN.search(x[2][history]) and _LATIN.search(x[2][history]) for tokens in looked.values() for x in tokens.values())
        for i, line in enumerate(lines):
            if line.isascii():
                continue
            out, at = [], 0
            for m in [*_SEGMENT.finditer(line), None]:
                end = m.start() if m else len(line)
                part = line[at:end]
                seg, fixed = self.segment(part, looked[part], None if crossed else history) if part in looked else (part, False)
                any_fixed |= fixed
                out.append(seg)
                if m:
                    out.append(m[0])
                    at = m.end()
            lines[i] = "".join(out)
        return ("\n".join(lines) if any_fixed else text), any_fixed or lost or crossed, lost


def with_repair(df: DataFrame, learned: list[Transformation], clean: list[str] | CharModel, text_col: str = "text", out_col: str = "repair") -> DataFrame:
    """`df` with a struct column (restored, garbled, lost).

    Null gives null; a text without garbled parts is restored to itself. Parts whose characters were replaced by
    U+FFFD are garbled and lost; the rest of such a text is restored all the same. ASCII-only texts stay in the JVM.
    """
    model = clean if isinstance(clean, CharModel) else CharModel.fit(clean)

    @F.pandas_udf("struct<restored:string,garbled:boolean,lost:boolean>")
    def repair(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = Repairer(learned, model)
        for s in texts:
            rows = [(None, None, None) if t is None else r.text(t) for t in s]
            yield pd.DataFrame(rows, columns=["restored", "garbled", "lost"], dtype=object)

    text = F.col(text_col)
    high = F.octet_length(text) > F.length(text)
    got = repair(F.when(high, text))
    plain = F.struct(text.alias("restored"), F.lit(False).alias("garbled"), F.lit(False).alias("lost"))
    return df.withColumn("_r", got).withColumn(out_col, F.when(text.isNull(), F.lit(None)).when(F.col("_r.garbled").isNull(), plain).otherwise(F.col("_r"))).drop("_r")
