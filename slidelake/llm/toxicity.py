"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.shared import stored

# Letters of other scripts that look like Latin ones, and digits read as letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
HIDDEN = "­​‌‍⁠﻿"
SIGN = re.compile(r"(?<=\w)[@$](?=\w)")

#: Lengths of the word beginnings that may be lexicon entries.
STEMS = (4, 5, 6, 7, 8)


class _Folding(dict):
    """Maps a code point to a lower-case base letter, a letter that a digit stands for, or a space.

    l and i are one letter here, as 1 may stand for either.
    """

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKD", chr(code).lower())[:1]
        c = HOMOGLYPHS.get(c, DIGITS.get(c, c))
        self[code] = "" if chr(code) in HIDDEN else "i" if c == "l" else c if c.isalnum() else " "
        return self[code]


_folding = _Folding()


def folded(text: str | None) -> str:
    """The words of a text after folding, each with a space before and after."""
    text = text or ""
    if "@" in text or "$" in text:
        text = SIGN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return f" {' '.join(text.translate(_folding).split())} "


@dataclass
class Lexicon:
    """Entries with weights; exception phrases; and how the score follows from the hits.

    An entry is ' word ' for a whole word, or ' beginning' for all words that begin so, in
    folded form. An exception is a phrase ' some words ' in which no entry counts.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 8.0
    bias: float = -4.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        """The Aho-Corasick automaton of entries and exceptions, built once a process."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def feature(self, words: str) -> tuple[float, int]:
        """Weight of the hits against the text's length, 0 to 1, and the number of hits."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if len(self.automaton()):
            for end, (size, weight) in self.automaton().iter(words):
                start = end + 1 - size
                if weight is None:
                    spared.append((start, end))
                else:
                    found[start] = max(weight, found.get(start, 0.0))
        for a, b in spared:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        raw = sum(found.values())
        return raw / (raw + 0.2 * math.log2(16 + words.count(" "))), len(found)

    def score(self, feature: float) -> float:
        """Between 0 and 1; higher: more likely toxic."""
        return 1 / (1 + math.exp(-self.slope * feature - self.bias))


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic regression with a slight ridge, by Newton's method."""
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        w -= np.linalg.solve(hessian, a.T @ (p - y) + 0.1 * w)
    return float(w[0]), float(w[1])


def _pruned(weights: dict[str, float], apart: float = 0.7) -> dict[str, float]:
    """Of a beginning and the longer entries that begin so, either it or they: they if one weighs clearly more."""
    beginning = lambda x: [x[: k + 1] for k in STEMS if k + 1 < len(x.rstrip()) + (x[-1] == " ")]
    above: dict[str, float] = {}
    for x, w in weights.items():
        for b in beginning(x):
            above[b] = max(w, above.get(b, 0.0))
    kept = {x: w for x, w in weights.items() if above.get(x, 0.0) <= w + apart}
    return {x: w for x, w in kept.items() if not any(b in kept for b in beginning(x))}


def learn(docs: DataFrame, labels: DataFrame, sample: int = 10_000, entries: int = 2_000, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled documents (doc_id, toxic 0/1).

    Fits on a bounded sample: of each class the `sample` labels that come first by hash of the
    id, so at most 2 * sample documents. Equal texts count once. Words and word beginnings
    are weighted by the lower end of a one-sided 95 % interval for the log odds of the documents
    they are in; the `entries` strongest are kept, down to 2 or half the strongest.
    A phrase of two words with an entry becomes an exception when it occurs in clean documents
    mostly. Without labels of both classes the lexicon is empty.
    """
    chosen = None
    for toxic in (0, 1):
        part = labels.where(F.col("toxic") == toxic).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * sample rows of 12 bytes
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    n = dict(texts.groupBy("toxic").count().collect())
    if not (n.get(0) and n.get(1)):
        return Lexicon({}, tuple(f" {folded(x).strip()} " for x in exceptions))

    def features(words: list[str]) -> set[str]:
        return {f" {w} " for w in set(words)} | {f" {w[:k]}" for w in set(words) for k in STEMS if len(w) > k}

    def phrases(words: list[str]) -> set[str]:
        return {f" {a} {b} " for a, b in zip(words, words[1:]) if f" {a} " in found or f" {b} " in found}

    def counted(of) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: tuple[Counter, Counter] = (Counter(), Counter())
            for batch in batches:
                for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                    sums[toxic].update(of(folded(text).split()))
                if len(sums[0]) + len(sums[1]) > 500_000:
                    yield told(sums)
                    sums = (Counter(), Counter())
            yield told(sums)

        def told(sums: tuple[Counter, Counter]) -> pa.RecordBatch:
            names = list(sums[0].keys() | sums[1].keys())
            return pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string())} | {c: pa.array([sums[i][x] for x in names], pa.int64()) for i, c in enumerate(("clean", "toxic"))})

        return texts.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    least = max(4, n[1] // 200)
    strong = counted(features).where(F.col("toxic") >= least).withColumn("weight", sure).where("weight >= 1").orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "feature").limit(entries).collect()
    weights = {x.feature: float(x.weight) for x in strong}
    least_weight = min(2.0, 0.5 * max(weights.values(), default=0.0))
    found = _pruned({x: w for x, w in weights.items() if w >= least_weight})
    in_clean = counted(phrases).where((F.col("clean") >= least) & (odds < 0)).select("feature").orderBy(F.desc("clean"), "feature").limit(entries)
    spared = tuple(x.feature for x in in_clean.collect()) + tuple(f" {folded(x).strip()} " for x in exceptions)
    lexicon = Lexicon(found, spared)
    points = np.array(texts.select("toxic", _features(F.col("text"), lexicon).alias("f")).select("toxic", "f.feature").collect(), dtype=float)
    lexicon.slope, lexicon.bias = _fitted(points[:, 1], points[:, 0])
    return lexicon


def _features(text: F.Column, lexicon: Lexicon) -> F.Column:
    @F.pandas_udf("feature double, hits long, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(*(f := lexicon.feature(folded(t))), lexicon.score(f[0])) for t in texts]
        return pd.DataFrame(rows, columns=["feature", "hits", "score"])

    return run(text)


def scored(docs: DataFrame, lexicon: Lexicon, text_column: str = "text", into: str = "toxicity") -> DataFrame:
    """The rows with struct column `into`: feature, hits, score; whole texts are read.

    A column of that name is replaced, all others are kept as they are. Null and empty texts
    have no hits and get the score of a text without hits, as no rows give no rows. Rows that
    repeat and null ids are scored each. Where entries begin at one place the heaviest counts.
    A text is one row of a batch, however long.
    """
    return docs.withColumn(into, _features(F.col(text_column), lexicon))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from; the rest are held out."""
    return labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("toxic").isNotNull())
