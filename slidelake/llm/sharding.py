"""Shards of equal bytes from indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidelake.llm.shared import stored


def difference(parts: np.ndarray) -> np.ndarray:
    """Combines partial partitions (one a row, k sums each) to one; gives where each sum goes.

    The two with the largest spread are combined again and again, the largest sum of one with
    the smallest of the other. Row i, column j of the result: the final shard of sum j of i.
    """
    n, k = parts.shape
    orders = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, orders, axis=1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        sums[a] = sums[b] = None
        sums.append(both[order])
        place = np.empty(k, dtype=np.int32)
        place[order] = np.arange(k)
        made.append((a, b, place))
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    where: list[np.ndarray | None] = [None] * (n + len(made))
    where[-1] = np.arange(k, dtype=np.int32)
    for i in range(len(made) - 1, -1, -1):
        a, b, place = made[i]
        final = where[n + i][place]
        where[a], where[b], where[n + i] = final, final[::-1], None
    out = np.empty((n, k), dtype=np.int32)
    np.put_along_axis(out, orders, np.array(where[:n]).reshape(n, k), axis=1)
    return out


def assign_groups(groups: DataFrame, shards: int, block: int = 16_384, fan_in: int = 1_024) -> DataFrame:
    """(digest, shard) of (digest, weight) rows.

    Blocks of about `block` groups, dealt by hash, are differenced in tasks of their own; their
    partial partitions then are combined by the same rule, `fan_in` at a time, level by level.
    No task holds more than a block, and the driver holds nothing.
    """
    n_blocks = max(1, -(-groups.count() // block))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = np.zeros((len(pdf), shards), dtype=np.int64)
        parts[:, 0] = pdf["weight"]
        return pdf.assign(part=difference(parts)[:, 0])

    dealt = groups.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(n_blocks)))
    assigned = stored(dealt.groupBy("block").applyInPandas(first, "digest binary, weight long, block long, part int"), "shards")

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf["block"].unique())
        parts = np.zeros((len(names), shards), dtype=np.int64)
        parts[np.searchsorted(names, pdf["block"]), pdf["part"]] = pdf["weight"]
        final = difference(parts)
        return pd.DataFrame({"block": np.repeat(names, shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(names)), "to_part": final.ravel()})

    while n_blocks > 1:
        sums = assigned.groupBy("block", "part").agg(F.sum("weight").alias("weight"))
        moves = sums.withColumn("above", F.expr(f"block div {fan_in}")).groupBy("above").applyInPandas(combine, "block long, part int, to_part int")
        moved = assigned.join(moves, ["block", "part"])
        assigned = stored(moved.selectExpr("digest", "weight", f"block div {fan_in} block", "to_part part"), "shards")
        n_blocks = -(-n_blocks // fan_in)
    return assigned.selectExpr("digest", "part shard")


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: the shards' sizes are as near equal as differencing gets them; rows of equal
    text are a group, which is never divided. A null text has no bytes and forms one group
    with empty texts. slot counts a shard's rows from 0 without gaps, in no promised order.
    Repeated rows are rows of their own; other columns are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "rows",
    )
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.count("*").alias("n")), "groups")
    placed = assign_groups(groups.select("digest", "weight"), shards)
    n_cells = max(1, rows.count() // (shards * 1_000))
    cells = stored(rows.join(placed, "digest").withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "digest"), F.lit(n_cells))), "cells")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "digest")
    return cells.withColumn("at", F.row_number().over(within) - 1).join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
