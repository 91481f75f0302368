"""Token records, packing, archives, shards: exact round trips and laws."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.llm import packing, records, sharding, warc
from slidelake.llm.tokens import Encoder, vocabulary

TEXTS = [None, "", " ", "Hello  world", "a\n b \n\n c", "naïve 漢字 <|endoftext|>", "x" * 50_000, "the quick brown fox " * 3000, "Same", "Same", "trailing ", " leading", "tab\t here", "it's 3.14, isn't it?!"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def documents(spark):
    rows = [(20 - i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "a repeated id", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, offset string, length long")


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(1)
    parts = [" ", "\n", "a", "B", "'s", "1", "é", "\t", "\xa0", "!", "<|endoftext|>", "漢", "  ", "\r\n", ".", ",", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + TEXTS
    for text, ids in zip(texts, Encoder(vocabulary()).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_keeps_bounded_bytes_and_stays_right(tokenizer, monkeypatch):
    monkeypatch.setattr("slidelake.llm.tokens.KEPT", 400_000, raising=False)
    monkeypatch.setattr("slidelake.llm.tokens.CHUNK", 20_000)
    texts = [f"the {i} {chr(97 + i % 26) * 900} {i % 7}\t x {i}\xe9 {i:0500d}" for i in range(600)]
    coder = Encoder(vocabulary())
    for text, ids in zip(texts * 2, coder.encode(texts * 2), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    kept = {id(d): d for d in (coder.known, getattr(coder, "older", {}))}.values()
    assert sum(len(w) + len(ids) for d in kept for w, ids in d.items()) < 400_000 and coder.spaced <= set().union(*kept)


def test_records_round_trip(spark, tokenizer):
    found = [tuple(r) for r in records.token_records(documents(spark), 2).collect()]
    expected, start = [], 0
    for r in sorted(documents(spark).collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(found) == sorted(expected)
    assert records.token_records(documents(spark).limit(0)).collect() == []


def test_records_in_any_order_and_damage(spark, tmp_path, tokenizer):
    from pyarrow import fs

    manifest = records.write_records(documents(spark), str(tmp_path), 2).collect()
    system = fs.LocalFileSystem()
    for m in manifest:
        for i in reversed(range(m.n_records)):
            doc_id, ids = records.read_at(system, m.data, m.offsets, i)
            assert ids[-1] == 2 and doc_id in {r.doc_id for r in documents(spark).collect()}
    data = bytearray(open(manifest[0].data, "rb").read())
    data[20] ^= 1
    open(manifest[0].data, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        records.read_at(system, manifest[0].data, manifest[0].offsets, 0)


def test_null_id_comes_first(spark):
    docs = spark.createDataFrame([(5, "b"), (None, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in records.token_records(docs).orderBy("start").collect()] == [(None, 0), (5, 2)]


def test_very_many_equal_ids_are_cut_into_ranges(spark, tmp_path, tokenizer):
    rows = [(None, f"text {i}") for i in range(300)] + [(i, "a") for i in range(3)] + [(1, f"again {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    manifest = records.write_records(docs, str(tmp_path), 2).cache()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and manifest.agg({"n_records": "max"}).first()[0] < 300
    found = records.read_records(manifest, str(tmp_path)).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(ids) == len(rows)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    expected = [zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows]
    assert sorted(r.ids_crc32 for r in found) == sorted(expected)


def test_files_roll_at_a_size(spark, tmp_path, tokenizer):
    docs = spark.createDataFrame([(i, "some words of a text " * (i % 7)) for i in range(200)], "doc_id long, text string")
    manifest = records.write_records(docs, str(tmp_path), 2, roll=1000)
    files = manifest.collect()
    assert max(f.turn for f in files) > 5 and len({f.data for f in files}) == len(files) and all(f.n_records > 0 for f in files)
    found = records.read_records(manifest, str(tmp_path)).orderBy("start").collect()
    assert [r.doc_id for r in found] == list(range(200)) and [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]


def test_partitions_follow_the_size(spark, tmp_path):
    from slidelake.llm.shared import partitions

    spark.range(1000).selectExpr("id", "repeat(cast(id as string), 50) text").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert partitions(docs) is None and partitions(docs, 1000) > 4
    assert partitions(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) is None  # no estimate


def plain_differencing(weights: list[int], k: int) -> list[int]:
    """The sums of the rule on small inputs: partial partitions as sorted lists, the two of largest spread combined."""
    parts = [[w] + [0] * (k - 1) for w in weights]
    while len(parts) > 1:
        a = parts.pop(max(range(len(parts)), key=lambda i: parts[i][0] - parts[i][-1]))
        b = parts.pop(max(range(len(parts)), key=lambda i: parts[i][0] - parts[i][-1]))
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0]


@pytest.mark.parametrize("seed", range(20))
def test_differencing_equals_the_plain_rule(seed):
    rng, k = random.Random(seed), random.Random(seed).randint(2, 6)
    weights = rng.sample(range(1, 10_000), rng.randint(1, 40))  # without ties, which may go either way
    if seed == 0:
        weights = [1_000_000, *weights]
    parts = np.zeros((len(weights), k), np.int64)
    parts[:, 0] = weights
    where = sharding.difference(parts)[:, 0]
    sums = sorted((sum(w for w, s in zip(weights, where) if s == j) for j in range(k)), reverse=True)
    assert sums == plain_differencing(weights, k)


def test_shards_of_odd_documents(spark):
    tied = [(i, f"{i % 9:03d}", 1) for i in range(300)]  # groups of equal weight
    odd = [(None, None, 1), (None, "", 1), (1000, None, 1), (1001, "", 1), (1002, "y" * 400_000, 1), (1002, "y" * 400_000, 1)]
    docs = spark.createDataFrame([(*r, "s") for r in tied + odd], "doc_id long, text string, size int, shard string")
    found = sharding.shard(docs, shards=5).collect()
    assert len(found) == 306 and {r.law for r in found} == {"bytes"} and all(r.grown_shard is None for r in found)
    text = {r[0]: r[1] or "" for r in tied + odd if r[0] is not None}
    of: dict[str, set] = {}
    for r in found:
        of.setdefault(text.get(r.doc_id, ""), set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())  # groups are whole
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    weights: dict[str, int] = {}
    for r in found:
        weights[text.get(r.doc_id, "")] = weights.get(text.get(r.doc_id, ""), 0) + r.size
    sums = sorted((sum(r.size for r in found if r.shard == j) for j in range(5)), reverse=True)
    assert sums[0] - sums[1] == plain_differencing(list(weights.values()), 5)[0] - plain_differencing(list(weights.values()), 5)[1]
    assert sharding.shard(docs.where("false"), shards=5).collect() == []


@pytest.mark.parametrize(("capacity", "open_bins"), [(2048, 4096), (16, 2)])
def test_packing_laws(spark, tokenizer, capacity, open_bins):
    found = packing.pack(documents(spark), capacity, 0, open_bins).toPandas()
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in documents(spark).collect()}
    lengths = sorted((i, len(x)) for i, x in ids.items())
    assert sorted(found[found.piece == 0].doc_id) == [i for i, _ in lengths]
    assert sorted(found.groupby("doc_id").length.sum()) == sorted({i: sum(n for j, n in lengths if j == i) for i, _ in lengths}.values())
    assert (found[found.piece > 0].length == capacity).all()
    for doc_id, pieces in found.sort_values("piece").groupby("doc_id"):
        assert pieces.piece.tolist() == list(range(len(pieces))) and pieces.start.tolist() == [0, *pieces.length.cumsum()[:-1]]
        assert pieces.ids_crc32.tolist() == [zlib.crc32(ids[doc_id][a : a + n].tobytes()) for a, n in zip(pieces.start, pieces.length)]
    for _, pieces in found.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() <= capacity
    assert packing.pack(documents(spark).limit(0)).collect() == []


def test_packing_hardly_depends_on_the_partitions(spark):
    docs = spark.createDataFrame([(i, "one two " * (i * 37 % 400)) for i in range(400)], "doc_id long, text string").cache()
    n = [packing.pack(docs.repartition(parts)).agg(F.countDistinct("sequence_id"), F.sum("length")).first() for parts in (1, 16)]
    least = -(-n[0][1] // 2048)
    assert least <= n[0][0] <= least + 1 and least <= n[1][0] <= 1.03 * least + 1


def test_bins_take_the_best_fit_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 5, 3, 4)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    # bins 0 and 1 have one free; a third one closes the fullest
    assert bins.place(8) == (2, 0) and bins.n_open == 2
    assert bins.place(1) in [(0, 9), (1, 9)]


def test_pieces():
    assert packing.pieces_of(5, 4) == [(0, 1), (1, 4)] and packing.pieces_of(8, 4) == [(0, 4), (4, 4)] and packing.pieces_of(3, 4) == [(0, 3)]


def pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 7}.example/{i % 5}", rng.choice(["<p>a</p>", "<p>ü</p>\r\n\r\n", "", None, f"page {i}"]), "x") for i in range(200)]
    rows += [(10**12, "http://late.example/", "far", "x"), (-7, "http://early.example/", "far", "x"), (-(2**62), "http://early.example/", None, "x")]
    return [*rows, (500, None, "WARC/1.1\r\n\r\n", "x"), (501, "http://x/\nInjected: 1", "y" * 100_000, "x")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    schema = "page_id long, url string, html string, archive string"
    found = {r.page_id: r for r in warc.capture_histories(spark.createDataFrame(pages(spark), schema).repartition(3), least).collect()}
    first = {}
    for i, _, html, _ in sorted(pages(spark)):
        data = (html or "").encode()
        origin = first.setdefault(data, i) if len(data) >= least else i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        r = found[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), digest, "response" if origin == i else "revisit", None if origin == i else origin)
    order = sorted((warc.url_key(u), warc.captured(i), i) for i, u, _, _ in pages(spark))
    assert [found[i].index_place for _, _, i in order] == list(range(len(order)))
    assert warc.capture_histories(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(20))) for i in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_differencing_is_tight():
    rng = np.random.default_rng(4)
    parts = np.zeros((3000, 8), np.int64)
    parts[:, 0] = rng.integers(1, 10_000, 3000)
    where = sharding.difference(parts)
    sums = np.bincount(where.ravel(), weights=parts.ravel(), minlength=8)
    assert sums.sum() == parts.sum() and sums.max() - sums.min() < 100
    assert (np.sort(where, axis=1) == np.arange(8)).all()


@pytest.mark.parametrize("block", [16_384, 20])
def test_shards(spark, block, monkeypatch):
    default = sharding.assign_groups
    monkeypatch.setattr(sharding, "assign_groups", lambda groups, shards: default(groups, shards, block, fan_in=3))
    rng = random.Random(6)
    rows = [(i, "é" * rng.randrange(200) + str(i % 150), 0) for i in range(600)] + [(700, None, 1), (701, "", 1), (702, "", 1), (702, "", 1)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 7).toPandas()
    text = dict((i, t or "") for i, t, _ in rows)
    assert len(found) == len(rows) and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    assert (found["size"] == [len(text[i].encode()) + 16 for i in found.doc_id]).all()
    assert (found.text_crc32 == [zlib.crc32(text[i].encode()) for i in found.doc_id]).all()
    assert found.assign(t=found.doc_id.map(text)).groupby("t").shard.nunique().max() == 1
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in found.groupby("shard"))
    sums = found.groupby("shard")["size"].sum()
    # blocks of 20 groups can't even out finer than part of a group
    assert len(sums) == 7 and sums.max() - sums.min() <= (40 if block > 20 else found["size"].max() / 2)
