"""Language identification by unigram models of word pieces, summed over all segmentations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.llm.shared import own, stored

#: Letters of a word at most; longer runs count as several words.
WORD = 256
#: Words a Python worker keeps scores of; distinct words scored or fitted at a time; cells of a lattice.
KEPT, CHUNK, CELLS = 400_000, 20_000, 2_000_000
#: Languages up to which a worker keeps as many; beyond, fewer.
FEW = 16
#: Expected counts are summed as whole multiples of 1 / UNIT, so that their order doesn't matter.
UNIT = 1 << 20
#: Shares of the piece probabilities that come from all languages together and from all pieces alike.
SHARED, ALIKE = 0.04, 0.01


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _letters():
    import regex

    return regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{WORD - 1}}}")


def words(text: str | None) -> list[str]:
    """The runs of letters (and marks after them) of a whole text, in lower case, cut after WORD code points."""
    return _letters().findall((text or "").lower())


class Pieces:
    """The pieces of letters of a fixed vocabulary, numbered; 0 is any character that is no piece.

    A word is spelled with the vocabulary's mark of a word's beginning before it. All its
    segmentations into pieces form a lattice, in which an edge is a piece that ends at a place.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.mark = "▁"
        self.number = {p: i for i, p in enumerate(sorted({self.mark, *names}), 1)}
        self.size, self.longest = len(self.number) + 1, max(map(len, self.number))
        # a trie of the pieces: node and character to node, as one sorted number each
        nodes, steps = {"": 0}, []
        for piece in self.number:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    steps.append((nodes[piece[: k - 1]] << 21 | ord(piece[k - 1]), nodes[piece[:k]]))
        self.steps, self.to = np.array(sorted(steps), np.int64).T.copy()
        self.of_node = np.array([self.number.get(p, -1) for p in nodes], np.int32)

    def lattice(self, some: list[str]) -> np.ndarray:
        """Piece numbers (word, end, length - 1) of words of one length; -1 where there is no piece."""
        n = len(some[0]) + 1
        most = min(self.longest, n)
        codes = np.frombuffer("".join([self.mark + w for w in some]).encode("utf-32-le"), np.uint32).astype(np.int64)
        ids = np.full((len(some), n, most), -1, np.int32)
        begin, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k in range(most):  # from all beginnings at once, one character further
            inside = begin % n + k < n
            begin = begin[inside]
            key = node[inside] << 21 | codes[begin + k]
            at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            there = self.steps[at] == key
            begin, node = begin[there], self.to[at[there]]
            piece = self.of_node[node]
            ids.reshape(-1)[(begin + k) * most + k] = piece
        single = ids[:, :, 0]
        single[single < 0] = 0
        return ids


@cache
def pieces(path: str) -> Pieces:
    """The Python worker's pieces of a vocabulary file."""
    return Pieces(path)


def _forward(chance: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all ways to each place; chance: (..., end, length - 1) of the edges, 0 for none.

    The places behind are kept relative to the last one, so no number becomes too small.
    """
    *head, n, most = chance.shape
    logs, behind = np.zeros((*head, n + 1)), np.zeros((*head, most))
    behind[..., 0] = 1.0
    for end in range(n):
        here = np.einsum("...k,...k->...", chance[..., end, :], behind)
        logs[..., end + 1] = logs[..., end] + np.log(here)
        behind[..., 1:] = behind[..., :-1] / here[..., None]
        behind[..., 0] = 1.0
    return logs


def _chances(log_p: np.ndarray) -> np.ndarray:
    """Probabilities by piece number, with 0 for number -1."""
    return np.concatenate([np.exp(log_p), np.zeros((len(log_p), 1))], axis=1)


def by_length(some: list[str], cells: int) -> Iterator[list[int]]:
    """Places of words of one length each, few enough to hold `cells` numbers for each edge."""
    order = sorted(range(len(some)), key=lambda i: len(some[i]))
    at = 0
    while at < len(order):
        n = len(some[order[at]])
        most = max(1, cells // ((n + 1) * min(16, n + 1)))
        end = at
        while end < len(order) and end - at < most and len(some[order[end]]) == n:
            end += 1
        yield order[at:end]
        at = end


@dataclass
class Model:
    """Languages, the logs of their shares of the documents, and of each piece's probability (language, piece)."""

    languages: list[str]
    log_share: np.ndarray
    log_p: np.ndarray

    @cached_property
    def chances(self) -> np.ndarray:
        return _chances(self.log_p)

    def scores(self, some: list[str], of: Pieces) -> np.ndarray:
        """(word, language): log probability of each word, all its segmentations summed."""
        out, chances = np.empty((len(some), len(self.languages))), self.chances
        for at in by_length(some, CELLS // max(1, len(self.languages))):
            out[at] = _forward(chances[:, of.lattice([some[i] for i in at])])[..., -1].T
        return out


def expected(some: list[str], counts: np.ndarray, languages: np.ndarray, log_p: np.ndarray, of: Pieces) -> np.ndarray:
    """(language, piece): how often the pieces are expected in the words' segmentations, in UNITs."""
    total, chances = np.zeros(log_p.shape, np.int64), _chances(log_p)
    for at in by_length(some, CELLS):
        ids, lang = of.lattice([some[i] for i in at]), languages[at]
        n, most = ids.shape[1:]
        chance = chances[lang[:, None, None], ids]
        back = np.zeros_like(chance)  # the lattice from its end
        for k in range(most):
            back[:, k:, k] = chance[:, k:, k][:, ::-1]
        alpha, beta = _forward(chance), _forward(back)[:, ::-1]
        begins = np.arange(1, n + 1)[:, None] - np.arange(1, most + 1)
        share = chance * np.exp(np.where(begins >= 0, alpha[:, np.maximum(begins, 0)], 0.0) + beta[:, 1:, None] - alpha[:, -1][:, None, None])
        whole = np.rint(share * counts[at][:, None, None] * UNIT).astype(np.int64)
        there = np.nonzero(whole)
        np.add.at(total, (lang[there[0]], ids[there]), whole[there])
    return total


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Log probabilities from expected counts; a piece a language lacks has the same floor in all languages."""
    plain = counts / np.maximum(counts.sum(1, keepdims=True), 1e-300)
    alike = 1.0 / counts.shape[1]
    return np.log((1 - SHARED - ALIKE) * plain + SHARED * plain.mean(0) + ALIKE * alike)


def training_words(docs: DataFrame, sample: int = 2_000, most: int = 500, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> tuple[DataFrame, dict[str, int]]:
    """(lang, word, n) of a bounded sample of the documents that name a language, and the documents of each language.

    Of each language all documents whose hash of id and text is below `sample` / its number of
    documents are taken, about `sample` of them at any size. Counted before the shuffle.
    """
    named = docs.select(F.col(id_column).cast("string").alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")).where("lang is not null")
    sizes = {r.lang: r["count"] for r in named.groupBy("lang").count().limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages; every task would hold a model of each")
    if not sizes:
        return named.select("lang", F.col("text").alias("word"), F.lit(0).cast("long").alias("n")).where("false"), sizes
    share = F.element_at(F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, sample / n)))]), F.col("lang"))
    uniform = F.xxhash64("id", "text").cast("double") / float(1 << 64) + 0.5
    chosen = named.where(uniform < share) if max(sizes.values()) > sample else named

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                sums.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, sums.values())) > 500_000:
                yield told(sums)
                sums = {}
        yield told(sums)

    def told(sums: dict[str, Counter]) -> pd.DataFrame:
        return pd.DataFrame([(lang, w, n) for lang, c in sums.items() for w, n in c.items()], columns=["lang", "word", "n"])

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), sizes


def learn(docs: DataFrame, sample: int = 2_000, rounds: int = 3, path: str | None = None, most: int = 500, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """A model of each language that docs name, by expectation maximisation over the pieces of a fixed vocabulary.

    Fits on about `sample` documents per language (see training_words); the languages' shares
    come from all documents. Starts from equal probabilities; each round sums over all
    segmentations of every distinct word how often each piece is expected, in tasks, and sends
    at most one number per language and piece to the driver. More than `most` languages raise
    ValueError, for every task holds a model of languages x pieces. Null and empty texts teach
    nothing; no documents give a model without languages.
    """
    path = path or vocabulary()
    counted, sizes = training_words(docs, sample, most, id_column, text_column, lang_column)
    languages, of = sorted(sizes), pieces(path)
    place = {lang: i for i, lang in enumerate(languages)}
    log_p = np.full((len(languages), of.size), -np.log(of.size))
    if languages:
        counted = stored(counted, "language-words")
        for _ in range(rounds):
            log_p = _smoothed(_expected_counts(counted, place, log_p, path))
    total = max(1, sum(sizes.values()))
    return Model(languages, np.log(np.array([sizes[x] / total for x in languages])), log_p)


def _expected_counts(counted: DataFrame, place: dict[str, int], log_p: np.ndarray, path: str) -> np.ndarray:
    """One expectation step over the table of words."""
    spark = counted.sparkSession
    sent = spark.sparkContext.broadcast(log_p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(sent.value.shape, np.int64)
        for b in batches:
            for at in range(0, len(b), CHUNK):
                some = b.iloc[at : at + CHUNK]
                total += expected(some["word"].tolist(), some["n"].to_numpy(), some["lang"].map(place).to_numpy(), sent.value, pieces(path))
        lang, piece = np.nonzero(total)
        yield pd.DataFrame({"lang": lang.astype(np.int32), "piece": piece.astype(np.int32), "n": total[lang, piece]})

    found = counted.mapInPandas(run, "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n")).toArrow()
    sent.unpersist()
    counts = np.zeros(log_p.shape)
    counts[found["lang"].to_numpy(), found["piece"].to_numpy()] = found["n"].to_numpy() / UNIT
    return counts


class Scorer:
    """Scores whole texts by a model; keeps the scores of words it has seen."""

    def __init__(self, model: Model, of: Pieces):
        self.model, self.of = model, of
        self.place: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), CHUNK):
            some = new[at : at + CHUNK]
            base = len(self.place)
            self.place.update(zip(some, range(base, base + len(some))))
            if len(self.table) < len(self.place):
                self.table = np.concatenate([self.table[:base], np.empty((max(len(some), base), self.table.shape[1]))])
            self.table[base : base + len(some)] = self.model.scores(some, self.of)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability among the languages) of each text; ('und', 0.0) without letters."""
        listed = [words(t) for t in texts]
        if len(self.place) > KEPT * FEW // max(FEW, len(self.model.languages)):
            self.place, self.table = {}, self.table[:0]
        if new := set().union(*listed).difference(self.place):
            self._learn(list(new))
        out = []
        for some in listed:
            if not some or not self.model.languages:
                out.append(("und", 0.0))
                continue
            # added in one order, whatever the order in which words were learned
            total = self.table[np.fromiter(map(self.place.__getitem__, some), np.int64, len(some))].sum(0) + self.model.log_share
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


_scorers: dict[int, Scorer] = {}


def _scorer(sent: Broadcast, path: str) -> Scorer:
    """The Python worker's scorer of a broadcast model."""
    if sent.value is not getattr(_scorers.get(0), "model", None):
        _scorers[0] = Scorer(sent.value, pieces(path))
    return _scorers[0]


def identified(docs: DataFrame, model: Model, path: str | None = None, text_column: str = "text", into: str = "language") -> DataFrame:
    """The rows with struct column `into`: lang_pred and score, from the whole text alone.

    The score is the probability of the language among the model's. Null texts and texts
    without a letter, and all texts where nothing was learned, are 'und' with score 0; equal
    scores go to the language that comes first. A column of that name is replaced, all others
    are kept as they are, whatever their names. Rows that repeat are scored each; a text is one
    row of a batch, however long.
    """
    path = path or vocabulary()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(sent, path)
        for texts in batches:
            rows = [x for at in range(0, len(texts), 200) for x in scorer.predict(texts.iloc[at : at + 200].tolist())]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return docs.withColumn(into, run(F.col(text_column)))


def held_out(id_column: str = "doc_id") -> Column:
    """The documents that nothing is learned from: CRC-32 of the id mod 4 is 2. A null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 4 == 2


def language_of(docs: DataFrame, sample: int = 2_000, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those that aren't held out."""
    model = learn(docs.where(~held_out()), sample, rounds)
    into = own("language", docs)
    found = identified(docs.select("doc_id", "text"), model, into=into)
    return found.select("doc_id", held_out().alias("held_out"), F.col(into)["lang_pred"].alias("lang_pred"), F.col(into)["score"].alias("score"))
