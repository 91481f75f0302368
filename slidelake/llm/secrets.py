"""Secret scans: candidates in whole texts, and a random forest that removes false positives."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.shared import stored

#: A run of these is a candidate if it has a digit, or is this long without one.
RUN, LONG = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}"), 24
FINDING = "doc_id long, path string, start long, candidate string, left string, right string"
FEATURES = ["length", "digits", "switches", "transitions", "coverage", "path_odds", "left_odds", "right_odds"]
# Formats of keys that issuers publish; names that secrets are assigned to.
ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abps]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "credential")
#: What stands before an assigned value: a whole word, and no more than blanks, a quote and : or =. Nothing is tried twice.
HEAD = re.compile(r"(?<!\w)(\w++)['\"]?+[ \t]*+[:=][ \t]*+['\"]?+")
VALUE = re.compile(r"[^\s'\"]{6,}")


def _assigned(text: str) -> list[tuple[int, int]]:
    """Spans of the values that are assigned to a word with one of NAMES in it."""
    found, end = [], 0
    if "=" in text or ":" in text:
        for m in HEAD.finditer(text):
            if m.start() < end:
                continue
            word = m[1].lower()
            if any(n in word for n in NAMES) and (v := VALUE.match(text, m.end())):
                found.append(v.span())
                end = v.end()
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of a text that may be secrets, in order.

    Values of 6 characters or more, of any kind, that are assigned to one of NAMES; keys of an
    issued format anywhere, also within a longer run; and other runs of 12 or more letters,
    digits and + / _ -, if they have a digit or 24 characters.
    """
    assigned = _assigned(text)
    found, i = set(assigned), 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while i < len(assigned) and assigned[i][1] <= a:
            i += 1
        if i < len(assigned) and assigned[i][0] <= a and b <= assigned[i][1]:
            continue
        if b - a >= LONG or any(c.isdigit() for c in m[0]):
            found.add((a, b))
    found.update(m.span() for m in ISSUED.finditer(text))
    return sorted(found)


def findings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source", around: int = 60) -> DataFrame:
    """A row per candidate of every whole text: where it is, itself, and `around` characters on both sides.

    Null and empty texts and empty tables have none; rows that repeat are scanned each; a
    candidate of any length is one row; other columns are ignored, whatever their names.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, path in zip(batch["doc_id"], batch["text"], batch["path"]):
                for a, b in candidates(text or ""):
                    rows.append((None if pd.isna(doc_id) else int(doc_id), path, a, text[a:b], text[max(0, a - around) : a], text[b : b + around]))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "start", "candidate", "left", "right"]).astype({"doc_id": "Int64"})

    return docs.selectExpr(f"cast({id_column} as long) doc_id", f"{text_column} text", f"cast({path_column} as string) path").mapInPandas(scan, FINDING)


def _value(kind: str, rng: random.Random, word: Callable[[], str]) -> str:
    """A made-up value; the kinds of SECRET and of OTHER share alphabets and lengths."""
    some = lambda chars, least, most: "".join(rng.choice(chars) for _ in range(rng.randint(least, most)))
    hexa, digits, alnum = "0123456789abcdef", string.digits, string.ascii_letters + string.digits
    upper = string.ascii_uppercase + "234567"
    made = {
        "hex": lambda: some(hexa, n := rng.choice([16, 20, 24, 32, 40, 48, 64]), n),
        "HEX": lambda: some(hexa.upper(), n := rng.choice([16, 32, 40]), n),
        "alnum": lambda: some(alnum, 14, 64),
        "base64": lambda: some(alnum + "+/", 20, 88) + rng.choice(["", "=", "=="]),
        "symbols": lambda: some(alnum + "!@#%^&*.", 8, 24),
        "passphrase": lambda: word() + some(digits, 1, 4) + rng.choice("!#_.") + some(alnum, 2, 6),
        "akia": lambda: f"AKIA{some(upper, 16, 16)}",
        "ghp": lambda: f"gh{rng.choice('pousr')}_{some(alnum, 36, 36)}",
        "xox": lambda: f"xox{rng.choice('abps')}-{some(digits, 10, 12)}-{some(alnum, 24, 24)}",
        "aiza": lambda: f"AIza{some(alnum + '-_', 35, 35)}",
        "uuid": lambda: "-".join(some(hexa, n, n) for n in (8, 4, 4, 4, 12)),
        "number": lambda: some(digits, 12, 20),
        "date": lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}-{rng.randint(0, 59):02d}-{word()}",
        "path": lambda: "/" + "/".join(word() for _ in range(rng.randint(2, 5))) + f"/{word()}{rng.randint(1, 99)}",
        "words": lambda: rng.choice("-_").join(word() for _ in range(rng.randint(3, 6))),
        "joined": lambda: "".join(word() for _ in range(rng.randint(4, 7))) + some(digits, 0, 2),
        "version": lambda: f"{word()}-{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}-{word()}{rng.randint(1, 9)}",
        "blob": lambda: some(alnum + "+/", 60, 200),
        "placeholder": lambda: rng.choice([f"your_{word()}_here", f"<{word()}-{word()}>", f"${{{word().upper()}_{word().upper()}}}", f"os.environ[{word().upper()}]", f"get_{word()}_{word()}()", "x" * rng.randint(6, 20), "*" * rng.randint(6, 12)]),
        "plain": lambda: (word() + word())[: rng.randint(6, 14)].ljust(6, "e"),
    }
    return made[kind]()


#: Kinds of values: secrets that need a name to be known by, issued ones, what is no secret under any
#: word, and what is none although a secret's name stands before it.
NAMED, KNOWN = ("hex", "HEX", "alnum", "base64", "symbols", "passphrase"), ("akia", "ghp", "xox", "aiza")
OTHER, EMPTY = ("hex", "HEX", "alnum", "base64", "uuid", "number", "date", "path", "words", "joined", "version", "blob"), ("placeholder", "plain")
#: Words that identifiers and checksums follow.
USUAL = ("commit", "sha", "md5", "checksum", "etag", "id", "uuid", "ref", "version", "order", "page", "image", "isbn", "build", "digest", "key", "hash", "file", "see", "number")


def planted(rng: random.Random, words: list[str], label: int) -> tuple[str, str, str]:
    """A made-up snippet, the value in it, and its template: head word and kind of value.

    words are those of a real text; names and values are put together from them.
    """
    word = lambda: rng.choice(words).lower() if words else some_word(rng)
    name, quote, sign = rng.choice(NAMES), rng.choice(['"', "'", "", ""]), rng.choice([" = ", "=", ": ", ":", " := "])
    named = rng.choice([name, f"{word()}_{name}", f"{name}_{word()}", f"my_{name}", name.upper(), f"{word().upper()}_{name.upper()}", f"{word()}{name.title()}"])
    if label:
        kind, head = (rng.choice(NAMED), name) if rng.random() < 0.75 else (rng.choice(KNOWN), rng.choice([name, "", *USUAL]))
        before = "" if not head else named + sign if head == name else f"{head}{rng.choice([' ', ': ', '='])}"
    elif rng.random() < 0.3:
        kind, head = rng.choice(EMPTY), name
        before = named + sign
    else:
        kind, head = rng.choice(OTHER), rng.choice([*USUAL, *USUAL, "", "", "(word)"])
        before = "" if not head else f"{word() if head == '(word)' else rng.choice([head, head.title(), f'{word()}_{head}'])}{rng.choice([' ', ': ', '=', ' = '])}"
    value = _value(kind, rng, word)
    return f"{before}{quote}{value}{quote}", value, f"{head.lower()}|{kind}"


def some_word(rng: random.Random) -> str:
    """A pronounceable word, where a text has none."""
    return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))


def planted_findings(docs: DataFrame, sample: int = 10_000, seed: int = 7, bare: int = 500, around: int = 60, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source", rows: int | None = None) -> DataFrame:
    """Labelled findings (FINDING, template and label 0/1): made-up secrets and look-alikes, put into real texts.

    In about 2 * `sample` documents, chosen by a hash that is compared with a share of all
    rows, as many whatever their number (`rows`, by default counted), one of each label is put
    where the text has a candidate of its own, or else at a blank; so neighbours, path and the
    words that names are made of are the corpus's. `bare` more of each have no text around
    them, so both labels are there for any table. Labels are known by construction and not read
    off the features.
    """
    rows = docs.count() if rows is None else rows
    share = min(1.0, 2 * sample / max(1, rows))
    real = docs.selectExpr(f"cast({id_column} as long) doc_id", f"{text_column} text", f"cast({path_column} as string) path", f"xxhash64({id_column}, {text_column}, {seed}) h")
    chosen = real.where(F.col("h").cast("double") / float(1 << 64) + 0.5 < share)
    made = docs.sparkSession.range(bare).selectExpr("cast(null as long) doc_id", "'' text", "cast(null as string) path", f"xxhash64(id, {seed}) h")

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, path, h in zip(batch["doc_id"], batch["text"], batch["path"], batch["h"]):
                rng, text = random.Random(int(h)), text or ""
                own = candidates(text)
                for label in (0, 1):
                    if own and rng.random() < 0.5:
                        at, after = rng.choice(own)
                    else:
                        at = after = max(0, text.find(" ", rng.randrange(len(text) + 1))) if text else 0
                    left, right = text[max(0, at - around) : at], text[after : after + around]
                    words = [w for w in _words(text[max(0, at - 2000) : at + 2000]) if 2 < len(w) < 15]
                    snippet, value, template = planted(rng, words, label)
                    whole = f"{left} {snippet} {right}"
                    start = whole.index(value, len(left))
                    for a, b in candidates(whole):
                        if a < start + len(value) and b > start:
                            out.append((None if pd.isna(doc_id) else int(doc_id), path, a, whole[a:b], whole[max(0, a - around) : a], whole[b : b + around], template, label))
            yield pd.DataFrame(out, columns=["doc_id", "path", "start", "candidate", "left", "right", "template", "label"]).astype({"doc_id": "Int64"})

    return chosen.union(made).mapInPandas(plant, f"{FINDING}, template string, label int")


def held_out_template() -> F.Column:
    """Templates that a measurement keeps out of the training."""
    return F.crc32("template") % 4 == 0


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^\W\d_]+", (text or "").lower())


@dataclass
class Context:
    """What the features know from labelled findings: words, letter pairs, and odds by neighbour and path."""

    dictionary: frozenset[str]
    pairs: dict[str, float]
    odds: dict[tuple[str, str], float]

    @classmethod
    def of(cls, rows: list) -> Context:
        words = Counter(w for r in rows for w in _words(r.left) + _words(r.right))
        pairs = Counter(p for w, n in words.items() for p in zip(f" {w}", w) for _ in range(min(n, 5)))
        total = sum(pairs.values()) + 1
        seen: dict[tuple[str, str], list[int]] = {}
        for r in rows:
            for key in cls._keys(r.path, r.left, r.right):
                seen.setdefault(key, [0, 0])[r.label] += 1
        odds = {k: math.log((b + 1) / (a + 1)) for k, (a, b) in seen.items() if a + b > 2}
        return cls(frozenset(w for w, n in words.items() if n > 1 and len(w) > 2), {"".join(p): math.log(n / total) for p, n in pairs.items()}, odds)

    @staticmethod
    def _keys(path: str | None, left: str | None, right: str | None) -> list[tuple[str, str]]:
        before, after = _words(left)[-1:], _words(right)[:1]
        return [("path", path or ""), *[("left", w) for w in before], *[("right", w) for w in after]]

    def features(self, candidate: str, path: str | None, left: str | None, right: str | None) -> list[float]:
        """The values of FEATURES for a candidate."""
        n, low = len(candidate), candidate.lower()
        kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in candidate]
        covered, i = 0, 0
        while i < n:
            size = next((k for k in range(min(12, n - i), 2, -1) if low[i : i + k] in self.dictionary), 0)
            covered, i = covered + size, i + (size or 1)
        rare = -14.0
        steps = [self.pairs.get(p, rare) for p in map("".join, zip(low, low[1:]))]
        found = {k: self.odds.get((k, w), 0.0) for k, w in self._keys(path, left, right)}
        return [n, kind.count("d") / n, sum(a != b for a, b in zip(kind, kind[1:])) / n, float(np.mean(steps)) if steps else rare, covered / n, found.get("path", 0.0), found.get("left", 0.0), found.get("right", 0.0)]


def with_features(found: DataFrame, context: Context) -> DataFrame:
    """The findings with the columns of FEATURES and the candidate's length in place of its surroundings."""
    names = [f for f in found.schema.names if f not in ("left", "right")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [context.features(*x) for x in zip(batch["candidate"], batch["path"], batch["left"], batch["right"])]
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(rows, columns=FEATURES, dtype=float)], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in names] + [f"{f} double" for f in FEATURES])
    return found.mapInPandas(run, schema)


def secrets(found: DataFrame, labelled: DataFrame, sample: int = 10_000, trees: int = 30, depth: int = 8, seed: int = 7, longest: int = 10_000) -> DataFrame:
    """The findings with score (0 to 1) and is_secret, by a forest trained on labelled findings.

    labelled has the columns of findings() and label 0/1. Trains on a bounded sample: of each
    label the `sample` rows that come first by hash, of candidates of at most `longest`
    characters. ValueError if one label is missing, for then there is nothing to learn. Longer
    candidates are judged as all others are.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    labelled = labelled.where(F.length("candidate") <= longest)
    parts = [labelled.where(F.col("label") == x).orderBy(F.xxhash64("doc_id", "start", "candidate")).limit(sample) for x in (0, 1)]
    rows = parts[0].union(parts[1]).collect()  # at most 2 * sample short rows
    if {r.label for r in rows} != {0, 1}:
        raise ValueError("labelled findings of both labels are needed")
    context = Context.of(rows)
    spark = found.sparkSession
    frame = pd.DataFrame([[*context.features(r.candidate, r.path, r.left, r.right), float(r.label)] for r in rows], columns=[*FEATURES, "label"])
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(gather.transform(spark.createDataFrame(frame)))
    judged = model.transform(gather.transform(with_features(found, context)))
    score = vector_to_array("probability")[1]
    return judged.withColumn("score", score).withColumn("is_secret", score >= 0.5).drop("features", "rawPrediction", "probability", "prediction")


def held_out(id_column: str = "doc_id") -> F.Column:
    """The documents that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5 == 0


def secret_scan(docs: DataFrame, sample: int = 10_000) -> DataFrame:
    """One row per candidate: doc_id, start, length, candidate_sha256, held_out, score, is_secret.

    The forest is trained on planted findings in documents that aren't held out (crc32 of the id
    mod 5 is not 0). The candidates themselves are not returned. No documents give no rows.
    """
    found = stored(findings(docs), "findings")
    labelled = stored(planted_findings(docs.where(~held_out()), sample), "labelled")
    judged = secrets(found, labelled, sample)
    digest = F.sha2("candidate", 256)
    return judged.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), digest.alias("candidate_sha256"), held_out().alias("held_out"), "score", "is_secret")
