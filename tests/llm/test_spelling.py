"""Spelling variants: the sorted-list scan and the whole operator against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from slidelake.llm import spelling

DOCS = "doc_id long, text string, word string, n long, run string"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs: list, least: int = 3) -> set:
    counts = Counter()
    for doc_id, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("seed", range(60))
def test_scan_equals_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(spelling, "QUERIES", rng.choice([2, 7, 1000]))
    m, rows = rng.randint(1, 3), []
    for g in range(rng.randint(1, 5)):
        start = "".join(rng.choice("abé") for _ in range(m))
        words = {start + "".join(rng.choice("abcé") for _ in range(rng.randint(1, m + 3))) for _ in range(rng.randint(1, 40))}
        rows += [(g, m, w) for w in sorted(words)]
    groups, prefix, words = (list(x) for x in zip(*rows))
    q, t = spelling.one_edit_pairs(np.array(groups), np.array(prefix), words)
    found = list(zip(q.tolist(), t.tolist()))
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i in range(len(rows)) for j in range(len(rows)) if groups[i] == groups[j] and one_edit(words[i], words[j])}


def texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdefghéü") for _ in range(rng.randint(4, 14))) for _ in range(40)]

    def changed(w):
        i, kind = rng.randrange(len(w)), rng.random()
        return w if kind < 0.5 else w[:i] + rng.choice("abxyé") + w[i + (kind < 0.8) :] if kind < 0.9 else w[:i] + w[i + 1 :]

    return [(i, " ".join(changed(rng.choice(stems[: 1 + rng.randrange(40)])).title() for _ in range(rng.randint(0, 300)))) for i in range(n)]


@pytest.mark.parametrize("cut", [50_000, 20, 2])
def test_operator_equals_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(spelling, "LIST", cut)
    odd = [(None, "Alpha alpha, ALPHA alphas alphas alphas ÉlanÉlan"), (7, None), (8, ""), (9, "x" * 5_000), (9, "x" * 5_000), (9, "x" * 5_001), (10, "中文 \U0001f600 a1b2")]
    docs = texts(1, 60) + odd * 2
    found = spelling.spelling_variants(spark.createDataFrame([(*d, "w", 1, "r") for d in docs], DOCS).repartition(5))
    rows = [tuple(r) for r in found.collect()]
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs)
    assert any(r[1] is not None and r[1] != r[2] for r in rows)  # a way of two forms or more


def test_long_words_of_one_letter_are_near(spark):
    words = [(f"{'a' * 3000}{x}", n) for x, n in (("", 9), ("b", 4), ("bc", 2))]
    rows = {(len(r.word), r.n_near, len(r.root)) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert rows == {(3000, 1, 3000), (3001, 2, 3000), (3002, 1, 3000)}


@pytest.mark.parametrize("cut", [1000, 5])
def test_lists_that_share_much_are_cut(spark, monkeypatch, cut):
    monkeypatch.setattr(spelling, "LIST", cut)
    rng = random.Random(6)
    words = {"aaaa" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(400)} | {"a" * i for i in range(4, 16)} | {"".join(rng.choice("ab:") for _ in range(6)) for _ in range(300)}
    words = {w: rng.randint(1, 99) for w in words if len(w) > 3}
    found = {r.word: (r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    for w, n in words.items():
        near = [words[x] for x in words if one_edit(w, x)]
        assert found[w] == (len(near), max(near) if near and max(near) >= 2 * n else None), w


def test_no_words_give_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([("a", 5), ("b", 9)], "word string, n long")).where("n_near > 0 or form is not null").count() == 0
