"""Jaccard self-join of documents on word shingles, with prefix filters of several global orders.

Each document is the set of its distinct shingles. Two sets can only be similar enough if, in
any one order of all shingles, their first few shingles (the prefix) have one in common. The
first order gives the candidates; prefixes in further orders must have a shingle in common
too, or the pair is dropped before its texts are sent anywhere.

In every order, shingles of which a sketch over all documents has seen many come last, so that
passages which many documents share are rarely in a prefix, and a near copy's own shingles come
before those of its group: where the first shingle that two copies share stands says how many
they can't share. The sketch has a fixed size and only decides the order; the result doesn't
depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake.llm.components import components, contracted, least_neighbour
from slidelake.llm.shared import Work, kept_rows, stored
from slidelake.llm.shingles import mixed, token_sets

#: The sketch: 2**CELL_BITS counters, in SLICES parts.
CELL_BITS, SLICES = 21, 256
#: Bits of the filter for texts that candidates need: FILTER_SHARE for each, between 2**LEAST_BITS and 2**MOST_BITS.
FILTER_SHARE, LEAST_BITS, MOST_BITS = 16, 20, 30
#: Orders besides the first.
FURTHER = 2
#: A shingle that more documents than this may have is brought together by joins that Spark can split.
HOT = 20_000
#: Classes whose prefixes a task remembers to have sent already.
REMEMBERED = 500_000


def prefix(tokens: np.ndarray, percent: int, ranks: np.ndarray, order: int) -> np.ndarray:
    """The first shingles of a set in one of the orders, as many as the threshold asks for."""
    n = len(tokens) + 1 - -(-percent * len(tokens) // 100) if len(tokens) else 0
    key = (ranks[tokens >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(56)) | (mixed(tokens, order) >> np.uint64(8))
    first = np.argpartition(key, n - 1)[:n] if n else np.zeros(0, int)
    return tokens[first[np.argsort(key[first])]]


def _level(count: np.ndarray | int) -> np.ndarray:
    return np.floor(4 * np.log2(1 + np.asarray(count)))


def seen(docs: DataFrame, k: int) -> np.ndarray:
    """For each cell of the sketch 4 log2 of the documents that were seen in it, one at least, rounded down."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None
        for batch in batches:
            cells = np.zeros(1 << CELL_BITS, np.uint32) if cells is None else cells
            for tokens in token_sets(batch.column(0), k):
                np.add.at(cells, tokens >> np.uint64(64 - CELL_BITS), 1)
        if cells is not None:
            small = np.minimum(cells, 65535).astype(np.uint16).reshape(SLICES, -1)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "cells": [x.tobytes() for x in small]})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cells in zip(*(c.to_pylist() for c in batch.columns)):
                sums[i] = sums.get(i, 0) + np.frombuffer(cells, np.uint16).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "cells": [_level(x).astype(np.uint8).tobytes() for x in sums.values()]})

    schema = "slice int, cells binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(total, schema).collect()  # 2**CELL_BITS bytes
    levels = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), np.uint8)
    for i, cells in rows:
        levels[i] = np.frombuffer(cells, np.uint8)
    return levels.ravel()


def _name(tokens: np.ndarray) -> bytes:
    """The name of a set, in 128 bits."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _text_hash(text: str) -> Column:
    """The name of a text, in 128 bits."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _lists(arrays: list, of: np.dtype) -> pa.Array:
    return pa.array([None if x is None else x.view(of) for x in arrays], pa.list_(pa.from_numpy_dtype(of)))


def described(docs: DataFrame, k: int, percent: int, most: int = HOT) -> DataFrame:
    """Per (doc_id, text) row: doc_id, the set's size n and name cls, the text's hash, and prefixes.

    first is the prefix in the first order, of which the first n_cold shingles are in `most`
    documents at most; order1, order2, ... are those in further orders, as 32-bit hashes. A
    task gives a set's prefixes once only; they are null in its further rows and those
    without a word.
    """
    levels = docs.sparkSession.sparkContext.broadcast(seen(docs, k))  # 2**CELL_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = np.partition(levels.value, 9 * len(levels.value) // 10)[9 * len(levels.value) // 10]
        ranks, hot = np.maximum(levels.value, usual) - usual, _level(most)
        known: set[bytes] = set()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            doc_id, text_hash, n, cls, n_cold, first, *further = zip(*rows)
            columns = {"doc_id": pa.array(doc_id, pa.int64()), "text_hash": pa.array(text_hash, pa.binary()), "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()), "n_cold": pa.array(n_cold, pa.int32()), "first": _lists(first, np.int64)}
            return pa.RecordBatch.from_pydict(columns | {f"order{i}": _lists(x, np.int32) for i, x in enumerate(further, 1)})

        rows, size = [], 0
        for b in batches:
            for doc_id, text_hash, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), token_sets(b.column(2), k)):
                cls = _name(tokens)
                if len(tokens) and cls not in known:
                    known.add(cls)
                    first = prefix(tokens, percent, ranks, 0)
                    n_cold = int((levels.value[first >> np.uint64(64 - CELL_BITS)] < hot).sum()) if usual < hot else 0
                    further = [(mixed(prefix(tokens, percent, ranks, i)) >> np.uint64(32)).astype(np.uint32) for i in range(1, FURTHER + 1)]
                    rows.append((doc_id, text_hash, len(tokens), cls, n_cold, first, *further))
                    size += len(first)
                else:
                    rows.append((doc_id, text_hash, len(tokens), cls, None, None, *[None] * FURTHER))
                if len(rows) == 2_000 or size > 200_000:
                    yield batch(rows)
                    rows, size = [], 0
                if len(known) > REMEMBERED:
                    known.clear()
        if rows:
            yield batch(rows)

    schema = "doc_id long, text_hash binary, n long, cls binary, n_cold int, first array<long>" + "".join(f", order{i} array<int>" for i in range(1, FURTHER + 1))
    return docs.select("doc_id", _text_hash("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _per_token(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """Adds aggregates over the rows of each token.

    A window gives those of tokens that HOT documents have at most; those of others are
    aggregated in part before the shuffle and joined to the rows, which Spark can split.
    """
    cold, hot = rows.where("not hot"), rows.where("hot")
    for name, value in aggregates.items():
        cold = cold.withColumn(name, value.over(Window.partitionBy("token")))
    found = hot.groupBy("token").agg(*[value.alias(name) for name, value in aggregates.items()])
    return cold.unionByName(hot.join(found, "token").select(cold.columns))


def _need(n: str, m: str, percent: int) -> str:
    """SQL for the least intersection of sets of n and m shingles that are similar enough."""
    return f"(({percent}L * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _fits(n: str, at: str, m: str, m_at: str, percent: int) -> Column:
    """Whether sets of n and m shingles, the first common one of which stands at these places, can be similar enough."""
    need = _need(n, m, percent)
    return F.expr(f"{n} - {at} >= {need} and {m} - {m_at} >= {need} and 100L * least({n}, {m}) >= {percent}L * greatest({n}, {m})")


def _ends(near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """A token's rows as the two sides of pairs, to be joined by token and band of size.

    The place of the first shingle that two sets share leaves both enough to share only if the
    other isn't too large. The first side, rows that aren't main, goes to the bands from the
    least size that is similar to its own up to the largest that its place allows. The second is
    in the band of its size: main rows all, others as the smaller set of a pair, so only those
    whose place still allows a partner of their own size. So sets that have a frequent passage
    behind many shingles of their own, and can't be similar, don't meet. The first side's
    columns are p_<name>.
    """
    width = math.log(100 / percent) + 1e-9 if percent < 100 else 1e-9
    band = lambda n: F.floor(F.log(n) / F.lit(width))
    most = f"least(100L * n div {percent}, {100 + percent}L * (n - at) div {percent} - n)"
    ranged = near.where("not main").withColumn("from", F.expr(f"({percent}L * n + 99) div 100")).withColumn("to", F.expr(most)).where("from <= to")
    others = ranged.select("token", F.explode(F.sequence(band("from"), band("to"))).alias("band"), *[F.col(c).alias(f"p_{c}") for c in ("cls", "n", "at", "component")])
    placed = near.where(f"main or n - at >= {_need('n', 'n', percent)}").withColumn("band", band("n"))
    return others, placed


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the components of the join's links.

    Two documents link if 100 * intersection >= percent * union of their sets. component_id is
    the smallest doc_id that links lead to. Documents without a word (also null) have no
    shingle and no link. Rows of the same set are one class, whose pairs are not formed; a
    link between different sets is only left out where links found before connect both sides
    already, so components are exact. A null id has a null component unless a link gives it
    one. Rows that repeat an id are kept, each with a component of its text; other columns are
    ignored, whatever their names; no rows give no rows. A text of any length is read whole and
    is one row of its own in a batch of hashing. Ties between places in an order or between
    leaders are broken by hashes, and don't change the result. Shingles that more than `hot`
    documents may have are brought together by joins that Spark can split, others by windows.

    Sets and texts are named by 128 bits of their hashes, shingles by 64.
    """
    return near_groups(docs, k, percent, id_column, text_column, hot).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """The rows that stay, whole: of each component of the join one, that with the smallest id.

    Rows that repeat an id are each judged by their own text. Rows without a word stay. A null id
    stays only where no row of the component has an id. Other columns are kept as they are,
    whatever their names; no rows give no rows.
    """
    found = near_groups(docs, k, percent, id_column, text_column, hot).where("n_shingles > 0")
    decided = stored(found.select("doc_id", F.col("text_hash").alias("key"), "stays"), "decided")
    return kept_rows(docs, decided, id_column, _text_hash(text_column))


def near_groups(docs: DataFrame, k: int, percent: int, id_column: str, text_column: str, hot: int) -> DataFrame:
    """What near_components gives, with text_hash and stays: whether this text is its component's first by id."""
    work = Work(docs.sparkSession, "join")
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = work.table(described(docs, k, percent, hot), "described")

    # A row per class and prefix shingle that another class has in its prefix too, with the
    # token's leader: of all classes the one in which it comes first, that is the least edited copy.
    entries = rows.where("first is not null").select("cls", F.col("n").cast("int").alias("n"), "n_cold", F.posexplode("first").alias("at", "token"))
    entries = entries.select("token", "cls", "n", "at", (F.col("at") >= F.col("n_cold")).alias("hot"))
    leader = F.min(F.struct("at", F.xxhash64("cls").alias("h"), "cls", "n"))
    shared = _per_token(entries, one=F.min("cls"), last=F.max("cls"), leader=leader).where("one <> last").drop("one", "last")
    shared = work.table(shared, "shared")

    # First each class meets one leader only, the one it shares the most places with.
    met = shared.where(_fits("n", "at", "leader.n", "leader.at", percent)).where("cls <> leader.cls").groupBy("cls", F.col("leader.cls").alias("to")).count()
    led = met.groupBy("cls").agg(F.max(F.struct("count", F.xxhash64("to").alias("h"), "to"))["to"].alias("to"))
    pairs = work.table(led.select(F.least("cls", "to").alias("a"), F.greatest("cls", "to").alias("b")).distinct(), "led")
    prefixes = rows.where("first is not null").groupBy("cls").agg(F.first("text_hash").alias("text_hash"), *[F.first(f"order{i}").alias(f"order{i}") for i in range(1, FURTHER + 1)])
    prefixes = work.table(prefixes, "prefixes")
    links = work.table(contracted(_similar(work, docs, pairs, prefixes, k, percent)), "links")

    # Then all pairs that are left: a class meets those of a token that seem to be in another
    # component, but of the component that its leader is in, only classes of others meet its classes.
    near = shared.drop("leader").join(least_neighbour(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    parts = {"one": F.min("component"), "last": F.max("component"), "main": F.min(F.struct("at", F.xxhash64("cls").alias("h"), "component"))}
    near = _per_token(near, **parts).where("one <> last").select("token", "cls", "n", "at", "component", (F.col("component") == F.col("main.component")).alias("main"))
    near = work.table(near, "near")
    others, placed = _ends(near, percent)
    met = placed.join(others, ["token", "band"]).where(_fits("n", "at", "p_n", "p_at", percent) & F.expr("component <> p_component and (main or n < p_n or n = p_n and cls < p_cls)"))
    rest = met.select(F.least("cls", "p_cls").alias("a"), F.greatest("cls", "p_cls").alias("b")).distinct()
    rest = work.table(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    work.drop("shared", "near", "led")
    more = _similar(work, docs, rest, prefixes, k, percent)
    named_by = work.table(components(links.union(more)), "components")
    work.drop("rest", "prefixes", "links")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = rows.where("n > 0").groupBy("cls").agg(first)
    named = classes.join(named_by.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))
    of_class = named.join(named.groupBy("component").agg(F.min("first").alias("least")), "component").select("cls", "least")
    found = rows.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(of_class, "cls", "left")
    stays = F.col("least").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash")))
    return found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"), stays.alias("stays"))


def _filter_bits(texts: int) -> int:
    """log2 of the filter's bits for so many texts."""
    return min(MOST_BITS, max(LEAST_BITS, (FILTER_SHARE * texts).bit_length()))


def _bits(rows: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2**bits bits with those set that the rows (column bit) name."""
    size = (1 << bits) // 8 // SLICES

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(size, np.uint8)
        at = pdf["bit"].to_numpy() % (8 * size)
        np.bitwise_or.at(part, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pd.DataFrame({"slice": [int(pdf["bit"].iloc[0]) // (8 * size)], "part": [part.tobytes()]})

    found = np.zeros((SLICES, size), np.uint8)
    for i, part in rows.groupBy(F.expr(f"bit div {8 * size}")).applyInPandas(fill, "slice int, part binary").collect():
        found[i] = np.frombuffer(part, np.uint8)
    return found.ravel()


def _similar(work: Work, docs: DataFrame, pairs: DataFrame, prefixes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): the pairs whose prefixes share a shingle in the further orders too, and whose sets are similar.

    Only the texts of pairs that pass the orders are sent, compressed; their sets are made
    again where both meet.
    """
    side = lambda c: prefixes.select(F.col("cls").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in prefixes.columns if x != "cls"])
    passed = pairs.join(side("a"), "a").join(side("b"), "b")
    for i in range(1, FURTHER + 1):
        passed = passed.where(F.arrays_overlap(f"a_order{i}", f"b_order{i}"))
    passed = work.table(passed.select("a", "b", "a_text_hash", "b_text_hash"), "passed")
    if passed.isEmpty():
        return passed.select("a", "b")
    needed = passed.select(F.explode(F.array("a_text_hash", "b_text_hash")).alias("text_hash")).distinct()
    bits = _filter_bits(needed.count())
    bit = F.pmod(F.xxhash64("text_hash"), F.lit(1 << bits)).alias("bit")
    wanted = docs.sparkSession.sparkContext.broadcast(_bits(needed.select(bit).distinct(), bits))  # 2**MOST_BITS / 8 bytes at most

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, known = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            at, chosen = batch.column(1).to_numpy(), []
            for i in np.flatnonzero(wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                name = batch.column(0)[i].as_py()
                if name not in known:
                    known.add(name)
                    chosen.append((name, i))
            for i in range(0, len(chosen), 500):
                some = chosen[i : i + 500]
                yield pa.RecordBatch.from_pydict({"text_hash": pa.array([name for name, _ in some], pa.binary()), "body": pa.array([press.compress((batch.column(2)[j].as_py() or "").encode()) for _, j in some], pa.binary())})
            if len(known) > REMEMBERED:
                known.clear()

    found = docs.select(_text_hash("text").alias("text_hash"), "text").select("text_hash", bit, "text").mapInArrow(choose, "text_hash binary, body binary")
    texts = work.table(found.groupBy("text_hash").agg(F.first("body").alias("body")), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, last = zstandard.ZstdDecompressor(), (b"", np.zeros(0, np.uint64))
        for batch in batches:
            kept = []
            for at in range(0, len(batch), 200):
                first, second = (batch.column(i).slice(at, 200).to_pylist() for i in (2, 3))
                sets = token_sets(pa.array([opened.decompress(x).decode() for x in first], pa.string()), k)
                for i, (x, body) in enumerate(zip(sets, second), at):
                    if body != last[0]:  # pairs of a leader follow one another
                        last = body, next(token_sets(pa.array([opened.decompress(body).decode()], pa.string()), k))
                    y = last[1]
                    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select(["a", "b"])

    body = lambda c: texts.select(F.col("text_hash").alias(f"{c}_text_hash"), F.col("body").alias(f"{c}_body"))
    both = passed.join(body("a"), "a_text_hash").join(body("b"), "b_text_hash").select("a", "b", "a_body", "b_body")
    return work.table(both.mapInArrow(verify, "a binary, b binary"), "similar")
