"""Centroid clustering in whole numbers, with dot products that are kept and only corrected."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.shared import Work

#: Whole components must be smaller than this in size, so that squared distances fit 64 bits.
LARGEST = 1 << 27


def whole_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 1024, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors of exactly `dims` components, none null or non-finite, as floor(scale * x)."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = embeddings.where((F.size(x) == dims) & finite)
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def starting_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids come first by SHA-256 of '<seed>:<id>'; of equal ids the least vector. Fewer if there are fewer."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.orderBy(place, "v").limit(k).collect()], np.int64)


def _assigned(rows: DataFrame, change: np.ndarray, norms: np.ndarray) -> DataFrame:
    """The vectors with dot products that follow the centroids' change, nearest cluster and distance.

    rows: vec_id, v, norm, dots. Only components that a centroid changed in are read; a centroid
    that stayed keeps its dot products as they are. Ties go to the smaller number.
    """
    k = len(change)
    moved = [(c, np.flatnonzero(change[c])) for c in range(k) if change[c].any()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v, dots = np.stack(b["v"].to_numpy()), np.stack(b["dots"].to_numpy()).astype(np.int64)
            for c, at in moved:
                dots[:, c] += v[:, at] @ change[c, at]
            squared = b["norm"].to_numpy()[:, None] - 2 * dots + norms
            cluster = squared.argmin(1)
            yield b.assign(dots=list(dots), cluster=cluster.astype(np.int32), distance=squared[np.arange(len(b)), cluster])

    schema = "vec_id long, v array<bigint>, norm long, dots array<bigint>, cluster int, distance long"
    return rows.select("vec_id", "v", "norm", "dots").mapInPandas(run, schema)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """A row per vector (vec_id, v): cluster, distance, cluster_inertia, inertia and centroid_sha256.

    The dot products of each vector with all centroids are a column of the stored table. A round
    corrects them by the components in which centroids moved, takes the nearest centroid, and
    sums every cluster's components, before the shuffle and in numbers wide enough for all rows;
    k rows of sums reach the driver. A non-empty cluster's centroid becomes the floor of its
    means, an empty one stays. When no centroid moves, the further rounds would change nothing
    and are left out. Each round's table replaces the one before.

    Rows that repeat count each, as do null ids; equal vectors share a cluster; with fewer than
    k vectors there are fewer centroids; none give no rows. A component of LARGEST or more
    raises ValueError, for distances would not fit their type.
    """
    spark = vectors.sparkSession
    work = Work(spark, "clusters")
    dims_sum = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    size = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    facts = vectors.agg(F.count("*").alias("n"), F.max(size).alias("largest"), F.max(F.size("v")).alias("dims")).first()
    if facts.n and facts.largest >= LARGEST:
        raise ValueError(f"a component is {facts.largest:.0f} in size; distances fit 64 bits below {LARGEST}")
    now = starting_centroids(vectors, k, seed)
    if not len(now):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).where("false")
    wide = "decimal(38,0)" if facts.n * facts.largest >= 1 << 62 else "long"
    zeros = F.array_repeat(F.lit(0).cast("long"), len(now))
    rows, change, written = vectors.select("vec_id", "v", dims_sum.alias("norm"), zeros.alias("dots")), now, ""
    for turn in range(rounds + 1):
        rows = work.table(_assigned(rows, change, (now * now).sum(1)), f"round{turn}")
        if written:
            work.drop(written)
        written = f"round{turn}"
        if turn == rounds:
            break
        sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i].cast(wide)) for i in range(facts.dims)]).alias("sums"))
        new = now.copy()
        for r in sums.collect():  # k rows
            new[r.cluster] = [int(x) // r.n for x in r.sums]
        change, now = new - now, new
        if not change.any():
            break
    inertia = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = {c: (inertia.get(c, 0), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(now.tolist())}
    look = lambda i, kind: F.element_at(F.array(*[F.lit(of[c][i]).cast(kind) for c in range(len(now))]), F.col("cluster") + 1)
    return rows.select("vec_id", "cluster", "distance", look(0, "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), look(1, "string").alias("centroid_sha256"))
