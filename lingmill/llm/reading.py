"""Problem 10: reading level of each document.

Method: smoothed unigram language models per grade level. All texts, seeded with a level by a readability formula with
fixed bands, train one model per level and language group; a document gets the level under which its words are most
likely, given how common the levels are in its group.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingmill.llm.message import message, prose
from lingmill.session import cut_lineage

#: The usual bands of the readability index LIX: very easy, easy, medium, difficult, very difficult.
BANDS = (30, 40, 50, 60)
LEVELS = len(BANDS) + 1
_LONG = 6
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def measures(sentences: list[str]) -> tuple[int, int, int]:
    """(sentences, words, words of more than six letters) of prose; sentences without a word don't count."""
    words = [w for w in (_WORD.findall(s) for s in sentences) if w]
    return len(words), sum(map(len, words)), sum(len(w) > _LONG for ws in words for w in ws)


def formula(sentences: list[str]) -> float | None:
    """The readability index LIX, words a sentence + percent of long words, which is used alike for many European
    languages; None without words."""
    n, words, long = measures(sentences)
    return words / n + 100 * long / words if words else None


def level_of(value: float) -> int:
    """The level, 1 the easiest, of a formula value."""
    return 1 + sum(value >= b for b in BANDS)


def _words(sentences: list[str]) -> list[str]:
    return [w.lower() for s in sentences for w in _WORD.findall(s)]


_NONE: Counter = Counter()


@dataclass
class LevelModel:
    """Unigram counts and numbers of texts by language group and level; a text's commonest short words decide its group.
    Levels are absolute: they are the formula's bands, the same for all groups."""

    groups: dict[str, str] = field(default_factory=dict)
    texts: dict[tuple[str, int], int] = field(default_factory=dict)
    words: dict[tuple[str, int], Counter] = field(default_factory=dict)
    totals: dict[tuple[str, int], int] = field(default_factory=dict)
    vocabulary: dict[str, Counter] = field(default_factory=dict)
    alpha: float = 200.0

    def group(self, words: list[str]) -> str:
        """The group that most of a text's words vote for; a text without a known word belongs to `other`."""
        votes = Counter(g for w in words if (g := self.groups.get(w)))
        return max(votes, key=lambda g: (votes[g], g)) if votes else "other"

    @classmethod
    def of_samples(cls, samples: list[tuple[str, str]]) -> LevelModel:
        """A model that only knows the groups' words, from (language, text)."""
        m = cls()
        by_word: dict[str, Counter] = defaultdict(Counter)
        for lang, t in samples:
            for w in _WORD.findall(t.lower()):
                by_word[w][lang] += 1
        m.groups = {w: c.most_common(1)[0][0] for w, c in by_word.items() if c.most_common(1)[0][1] >= 0.8 * sum(c.values())}
        return m

    @classmethod
    def fit(cls, texts: list[list[str]], samples: list[tuple[str, str]], vocabulary: int = 20_000) -> LevelModel:
        """`texts`: sentences of the seeded training texts; `samples`: (language, text) for the groups' words."""
        m = cls.of_samples(samples)
        counts: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0] * LEVELS)
        for sentences in texts:
            if words := _words(sentences):
                g, level = m.group(words), level_of(formula(sentences))
                m.texts[g, level] = m.texts.get((g, level), 0) + 1
                for w in words:
                    counts[g, w][level - 1] += 1
        rank: Counter = Counter()
        for (g, w), n in sorted(counts.items(), key=lambda x: (-sum(x[1]), x[0])):
            rank[g] += 1
            if rank[g] <= vocabulary:
                m.learn(g, w, n)
        return m

    def learn(self, group: str, word: str, counts: list[int]) -> None:
        """Takes a word's counts by level."""
        self.vocabulary.setdefault(group, Counter())[word] = sum(counts)
        for level, n in enumerate(counts, 1):
            if n:
                self.words.setdefault((group, level), Counter())[word] = n
                self.totals[group, level] = self.totals.get((group, level), 0) + n

    def posterior(self, words: list[str]) -> tuple[str, list[float]] | None:
        """(group, probability of each level) of a text's words; None without words. A level no text of the group has is
        not possible.

        Words are independent draws in the model but not in texts, so evidence is taken per word times its square root."""
        if not words:
            return None
        g = self.group(words)
        if g not in self.vocabulary:
            g = max(self.vocabulary, key=lambda x: sum(self.vocabulary[x].values()), default="")
            if not g:
                return None
        whole, mass = self.vocabulary[g], sum(self.totals.get((g, level), 0) for level in range(1, LEVELS + 1))
        n_texts = sum(self.texts.get((g, level), 0) for level in range(1, LEVELS + 1))
        known = [(w, n) for w, n in Counter(words).items() if w in whole]
        temper = 1 / math.sqrt(max(1, sum(n for _, n in known)))
        scores = []
        for level in range(1, LEVELS + 1):
            if not (n := self.texts.get((g, level), 0)):
                scores.append(-math.inf)
                continue
            c, total = self.words.get((g, level), _NONE), self.totals.get((g, level), 0)
            likely = sum(n * math.log((c[w] + self.alpha * whole[w] / mass) / (total + self.alpha)) for w, n in known)
            scores.append(likely * temper + math.log(n / n_texts))
        e = [math.exp(s - max(scores)) for s in scores]
        return g, [x / sum(e) for x in e]


def measured(df: DataFrame, samples: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", commit: bool = True) -> DataFrame:
    """(id, words, language_group, seed, formula, n_sentences, n_words): one row per row of `df`, `words` those of its
    prose in lower case with a space between, null where there is none; `seed` is the formula's level. Texts are taken
    apart here and nowhere else."""
    model = LevelModel.of_samples(samples)

    @F.pandas_udf("struct<words:string,language_group:string,seed:int,formula:double,n_sentences:int,n_words:int>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                p = prose(t, commit) if t else None
                words = _words(p.sentences) if p and not p.machine else []
                if words:
                    value, (n, count, _) = formula(p.sentences), measures(p.sentences)
                    rows.append((" ".join(words), model.group(words), level_of(value), value, n, count))
                else:
                    rows.append((None, None, None, None, 0, 0))
            yield pd.DataFrame(rows, columns=["words", "language_group", "seed", "formula", "n_sentences", "n_words"]).astype({"seed": "Int32"})

    text = message(F.col(text_col)) if commit else F.col(text_col)
    # not to be evaluated once for each of its fields
    return df.select(F.col(id_col), f.asNondeterministic()(text).alias("r")).select(id_col, "r.*")


def train_measured(rows: DataFrame, samples: list[tuple[str, str]], vocabulary: int = 20_000) -> LevelModel:
    """A model from all rows of `measured`. The driver gets one count per group and level and each group's `vocabulary`
    commonest words with their counts by level; groups are the samples' languages, so both are bounded."""
    model, texts = LevelModel.of_samples(samples), rows.filter("words is not null")
    model.texts = {(r["language_group"], r["seed"]): r["n"] for r in texts.groupBy("language_group", "seed").agg(F.count("*").alias("n")).collect()}
    words = texts.select("language_group", "seed", F.explode(F.split("words", " ")).alias("word"))
    counts = words.groupBy("language_group", "word").agg(*(F.count(F.when(F.col("seed") == k, 1)).alias(f"n{k}") for k in range(1, LEVELS + 1)))
    counts = counts.withColumn("n", sum((F.col(f"n{k}") for k in range(1, LEVELS + 1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("language_group").orderBy(F.desc("n"), "word"))
    for r in counts.withColumn("rank", rank).filter(F.col("rank") <= vocabulary).collect():
        model.learn(r["language_group"], r["word"], [r[f"n{k}"] for k in range(1, LEVELS + 1)])
    return model


def train(df: DataFrame, samples: list[tuple[str, str]], text_col: str = "text", commit: bool = True) -> LevelModel:
    """A model from all texts."""
    return train_measured(cut_lineage(measured(df, samples, text_col, text_col, commit).drop(text_col)), samples)


def levels_measured(rows: DataFrame, model: LevelModel, id_col: str = "doc_id") -> DataFrame:
    """`reading_levels` of rows of `measured`."""

    @F.pandas_udf("struct<language_group:string,level:int,confidence:double>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for t in s:
                got = model.posterior(t.split(" ")) if t else None
                best = max(range(LEVELS), key=got[1].__getitem__) if got else None
                out.append((got[0], best + 1, got[1][best]) if got else (None, None, None))
            yield pd.DataFrame(out, columns=["language_group", "level", "confidence"]).astype({"level": "Int32"})

    known = F.col("r.level").isNotNull()
    got = rows.select(id_col, f.asNondeterministic()("words").alias("r"), "formula", "n_sentences", "n_words")
    return got.select(id_col, "r.*", F.when(known, F.col("formula")).alias("formula"), *(F.when(known, F.col(c)).otherwise(0).alias(c) for c in ("n_sentences", "n_words")))


def reading_levels(df: DataFrame, model: LevelModel, id_col: str = "doc_id", text_col: str = "text", commit: bool = True) -> DataFrame:
    """(id, language_group, level, confidence, formula, n_sentences, n_words): one row per row of `df`.

    Level 1 is the easiest of 5. Null, blank and wordless texts and messages made by machines have a null level and no
    prose. With `commit`, only the message's prose counts: no header lines, trailers, lists or hunks. Repeated rows get
    the same answer; other columns are ignored.
    """
    return levels_measured(measured(df, [], id_col, text_col, commit), model, id_col)
