"""Exact dedup, n-gram join, components: against brute force on small fixtures."""

import random

import pytest

from slidelake.llm import components, exact_dedup, ngram_join

DOCS = "doc_id long, text string, lang string, n long, tokens string, component long"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 7, "x", 0) for i, t in rows], DOCS)


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    found = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))) for i in range(60)]
    found += [(100 + i, f"{passage} {' '.join(rng.choice(words) for _ in range(rng.randint(0, 9)))}") for i in range(30)]
    base = " ".join(rng.choice(words) for _ in range(200)).split()
    for i in range(40):  # near copies, at distances around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(200)] = rng.choice(words)
        found.append((200 + i, " ".join(copy)))
    found += [(300 + i, found[3][1]) for i in range(5)] + [(310, found[3][1].upper()), (311, found[3][1].replace(" ", " \t\n"))]
    found += [(400, None), (401, ""), (402, "  \n"), (403, "one two"), (404, "ONE  two"), (405, "one"), (406, "z " * 5000), (406, "z " * 5001), (None, "lost words here"), (7, "again seven")]
    return found


def brute(rows, k, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    name = list(range(len(sets)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                name[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, len(s), least.get(root(a))) for a, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("k", "percent", "hot"), [(3, 90, 20_000), (5, 80, 0), (1, 50, 20_000), (2, 100, 3)])
def test_join_equals_brute_force(spark, k, percent, hot):
    found = ngram_join.near_components(table(spark, texts()).repartition(7), k, percent, hot=hot)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(texts(), k, percent)


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_sets_that_can_be_similar_meet_in_a_band(spark, percent):
    rng = random.Random(percent)
    sets = [(b"t", i, n := rng.randint(1, 60), rng.randint(0, n // 4), i, i % 7 == 0) for i in range(300)]
    # a passage that stands behind many shingles of their own
    behind = [(b"u", 1000 + i, 1000 + i % 9, 150, i, False) for i in range(500)]
    near = spark.createDataFrame(sets + behind, "token binary, cls long, n long, at int, component long, main boolean")
    others, placed = ngram_join._ends(near, percent)
    met = placed.join(others, ["token", "band"]).where("main or n < p_n or n = p_n and cls < p_cls").select("cls", "p_cls")
    found = [tuple(sorted(r)) for r in met.collect()]
    expected = set()
    for _, a, n, at, _, main in sets:
        for _, b, m, m_at, _, also in sets:
            need = -(-percent * (n + m) // (100 + percent))
            if a < b and not (main and also) and n - at >= need and m - m_at >= need and 100 * min(n, m) >= percent * max(n, m):
                expected.add((a, b))
    assert expected <= set(found) and len(found) == len(set(found))
    assert max((b for _, b in found), default=0) < 1000


def test_join_of_nothing(spark):
    assert ngram_join.near_components(table(spark, []), 3, 90).collect() == []
    assert [tuple(r) for r in ngram_join.near_components(table(spark, [(1, None), (2, "a b c d")]), 3, 90).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 2, 2)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (9000, 1)]
    name = {}
    for a, b in pairs * 300:
        m = min(a, b, name.get(a, a), name.get(b, b))
        name[a], name[b] = m, m
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    found = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert found == {n: name[n] for n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def normal(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_equal_brute_force(spark):
    import hashlib

    rows = [r for r in texts() if r[0] is not None]
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    expected = sorted((i, min(g := groups[normal(t)]), len(g), i == min(g), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
    assert sorted(tuple(r) for r in exact_dedup.exact_groups(table(spark, rows).repartition(5)).collect()) == expected
    assert exact_dedup.exact_groups(table(spark, [])).collect() == []


def test_null_ids(spark):
    found = exact_dedup.exact_groups(table(spark, [(None, "a"), (3, "a"), (None, "b"), (None, "b")])).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found], key=repr) == sorted([(None, 3, 2, False), (3, 3, 2, True), (None, None, 2, True), (None, None, 2, True)], key=repr)


def test_deduplicated_keeps_whole_rows(spark):
    docs = table(spark, [(2, "a  b"), (1, "a b"), (3, "c"), (4, None), (5, "")])
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs).collect()) == [1, 3, 4]
    assert exact_dedup.deduplicated(docs).columns == docs.columns


def test_table_compares_contents():
    found = exact_dedup.Table(10_000)
    for i, content in enumerate([b"a", b"b", b"a", b"c"]):
        assert found.add(bytes(32), content, 10 - i, 1)  # the same digest for all
    assert [(c, f, n) for _, c, f, n in found.records] == [(b"a", 8, 2), (b"b", 9, 1), (b"c", 7, 1)]


def test_grace_spills_and_recurs(tmp_path):
    import hashlib

    rng = random.Random(2)
    contents = [f"{i % 300} {'x' * rng.randint(0, 50)}".encode() for i in range(3000)] + [b"hot"] * 1000
    records = [(hashlib.sha256(c).digest(), c, i, 1) for i, c in enumerate(contents)]
    expected = {}
    for _, c, i, n in records:
        f, k = expected.get(c, (i, 0))
        expected[c] = (min(f, i), k + n)
    found = list(exact_dedup.grace(iter(records), str(tmp_path), budget=3000, fan_out=3))
    assert {c: (f, n) for _, c, f, n in found} == expected and len(found) == len(expected)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_rows_that_repeat_an_id_are_judged_each(spark):
    schema = "doc_id long, text string, row_key string, turn int, _dropped int, key int, stays boolean"
    rows = [(1, "a b c"), (2, "a b c"), (2, "only here"), (2, "only here"), (None, "a b c"), (None, "lost"), (None, "lost"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "r", 1, 2, 3, True) for i, t in rows], schema)
    once = exact_dedup.deduplicated(docs)
    assert once.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=repr) == sorted([(1, "a b c"), (2, "only here"), (None, "lost"), (4, None)], key=repr)
    near = ngram_join.without_near_copies(docs, 2, 80)
    assert near.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted([(1, "a b c"), (2, "only here"), (None, "lost"), (4, None), (5, "")], key=repr)


def test_filter_of_texts(spark):
    assert [ngram_join._filter_bits(n) for n in (0, 1 << 16, (1 << 16) - 1, 10**12)] == [20, 21, 20, ngram_join.MOST_BITS]
    bits = [0, 5, 4095, 4096, (1 << 20) - 1]
    found = ngram_join._bits(spark.createDataFrame([(b,) for b in bits], "bit long"), 20)
    assert [i for i in range(1 << 20) if found[i >> 3] >> (i & 7) & 1] == bits
