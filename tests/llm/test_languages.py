"""Language models: forward sums against all segmentations, held-out accuracy, odd rows."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from slidelake.llm import languages as lg

SCHEMA = "doc_id long, text string, lang string, language string, score double"


@pytest.fixture(scope="module")
def of():
    return lg.pieces(lg.vocabulary())


def segmentations(word: str, of: lg.Pieces):
    """Every way to cut the marked word into pieces, as piece numbers."""
    whole = of.mark + word
    for k in range(len(whole)):
        for cuts in combinations(range(1, len(whole)), k):
            parts = [whole[a:b] for a, b in zip((0, *cuts), (*cuts, len(whole)))]
            ids = [of.number.get(p, 0 if len(p) == 1 else None) for p in parts]
            if None not in ids:
                yield ids


@pytest.mark.parametrize("word", ["a", "the", "straße", "ünïque", "w中x", "ностью", "q\U00010400t"])
def test_forward_sums_all_segmentations(of, word):
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.full(of.size, 0.1), 2) + 1e-9)
    model = lg.Model(["x", "y"], np.zeros(2), log_p)
    for i in range(2):
        total = math.fsum(math.exp(sum(log_p[i, p] for p in ids)) for ids in segmentations(word, of))
        assert math.isclose(model.scores([word], of)[0, i], math.log(total), rel_tol=1e-9)


def test_expected_counts_are_those_of_all_segmentations(of):
    some, counts, lang = ["the", "thé", "cat", "in"], np.array([3, 1, 2, 5]), np.array([0, 1, 0, 1])
    log_p = np.log(np.random.default_rng(2).dirichlet(np.full(of.size, 0.1), 2) + 1e-9)
    want = np.zeros(log_p.shape)
    for word, n, i in zip(some, counts, lang):
        ways = [(ids, math.exp(sum(log_p[i, p] for p in ids))) for ids in segmentations(word, of)]
        for ids, p in ways:
            for x in ids:
                want[i, x] += n * p / sum(w for _, w in ways)
    assert np.allclose(lg.expected(some, counts, lang, log_p, of) / lg.UNIT, want, atol=1e-4)


def test_rounds_raise_the_likelihood(of):
    rng = random.Random(3)
    some = sorted({"".join(rng.choice(["ing", "the", "er", "an", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(80)})
    counts, lang = np.full(len(some), 10), np.zeros(len(some), int)
    log_p, found = np.full((1, of.size), -np.log(of.size)), []
    for _ in range(4):
        found.append(float(lg.Model(["x"], np.zeros(1), log_p).scores(some, of).sum()))
        log_p = lg._smoothed(lg.expected(some, counts, lang, log_p, of) / lg.UNIT)
    assert found == sorted(found) and found[1] > found[0]


def test_words():
    assert lg.words("Straße, ÉTÉ 12x_y! naïve") == ["straße", "été", "x", "y", "naïve"]
    assert lg.words("नमस्ते ½ ²") == ["नमस्ते"]
    assert lg.words(None) == lg.words("12 !?") == []
    assert [len(w) for w in lg.words("a" * 600)] == [256, 256, 88]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lg.language_of(docs, sample=100).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.98


def test_score_and_language_equal_a_plain_version(spark, of):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 4)]
    frame = spark.createDataFrame([(*d, "x", 0.5) for d in docs], SCHEMA)
    model = lg.learn(frame, rounds=2)
    assert model.languages == ["de", "en", "fr"] and np.allclose(np.exp(model.log_share), 1 / 3)
    rows = lg.identified(frame, model, into="language").collect()
    for r, (_, text, lang) in zip(sorted(rows), docs):
        assert r.language.lang_pred == lang
        logs = [model.log_share[i] + sum(math.log(math.fsum(math.exp(sum(model.log_p[i, p] for p in ids)) for ids in segmentations(w, of))) for w in text.split()) for i in range(3)]
        assert math.isclose(r.language.score, 1 / sum(math.exp(x - max(logs)) for x in logs), rel_tol=1e-6)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (None, "le chat et le chien", "fr"), (2, None, "fr"), (3, "", None), (4, "123 %", "en"), (5, "chien chat " * 40_000, None), (6, "x" * 30_000, "en")]
    frame = spark.createDataFrame([(*r, "y", 0.1) for r in rows], SCHEMA)
    found = [tuple(r) for r in lg.language_of(frame).collect()]
    assert len(found) == len(rows) and {r[0] for r in found if r[2] == "und"} == {2, 3, 4}
    assert all(r[1] is not None and 0 <= r[3] <= 1 for r in found)
    assert next(r[2] for r in found if r[0] == 5) == "fr"
    assert lg.language_of(frame.where("false")).collect() == []
    nothing = lg.language_of(frame.withColumn("lang", lg.F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_too_many_languages(spark):
    with pytest.raises(ValueError, match="languages"):
        lg.learn(spark.range(30).selectExpr("id doc_id", "'a' text", "cast(id as string) lang"), most=20)


def test_sample_is_bounded_and_by_language(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('word ', id) text", "if(id < 40, 'rare', 'often') lang")
    counted, sizes = lg.training_words(docs, sample=200)
    n = {r.lang: r.n for r in counted.where("word = 'word'").collect()}
    assert sizes == {"rare": 40, "often": 3960} and n["rare"] == 40 and 120 < n["often"] < 280
