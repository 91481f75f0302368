"""The folder that the driver and all executors share, and files written to it by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidelake.sources.storage import removed, run_folder, shared_root

__all__ = ["Work", "kept_rows", "one_per_task", "open_folder", "own", "partitions", "removed", "run_folder", "shared_root", "small", "stored"]


#: Spark's setting that removes a query's shuffle files when the query has ended.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read again.

    Cuts the lineage, so that later reads neither recompute the rows nor depend on an executor;
    the shuffle files behind them are removed.
    """
    return _written(df, run_folder(df.sparkSession, name))


class Work:
    """The stored tables of one run of an operator, which are dropped once they are superseded."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, run_folder(spark, name)
        self.paths: dict[str, list[str]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, stored as `stored` does; several tables may have one name."""
        self.paths.setdefault(name, []).append(f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}")
        return _written(df, self.paths[name][-1])

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names."""
        for name in names:
            for path in self.paths.pop(name, []):
                removed(self.spark, path)


def partitions(df: DataFrame, size: int = 256 << 20) -> int | None:
    """Partitions of about `size` bytes by Spark's estimate of the rows, where they are more than a shuffle has; else none."""
    bytes_ = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-bytes_ // size) if bytes_ < 1 << 60 else 0  # beyond: not known
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def own(name: str, *taken: DataFrame) -> str:
    """A column name that none of the tables has."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


def kept_rows(docs: DataFrame, decided: DataFrame, id_column: str, key: Column) -> DataFrame:
    """The rows of docs that stay, whole and with their own columns.

    decided: a (doc_id, key, stays) row for each row of docs that has a group; rows without one
    stay. Rows are told apart by id and key together, so that rows that repeat an id fare each
    by its own key. Of rows that are equal in both and would stay, one stays.
    """
    spark = docs.sparkSession
    row_key, d_id, d_key = (own(name, docs) for name in ("row_key", "d_id", "d_key"))
    decided = decided.select(F.col("doc_id").alias(d_id), F.col("key").alias(d_key), "stays")
    same = (docs[id_column].cast("long").eqNullSafe(F.col(d_id))) & (F.col(row_key) == F.col(d_key))
    dropped = decided.where("not stays").select(d_id, d_key).distinct()
    rest = docs.withColumn(row_key, key).join(dropped, same, "left_anti")
    again = _written(decided.where("stays").groupBy(d_id, d_key).count().where("count > 1").drop("count"), run_folder(spark, "again"))
    if not again.isEmpty():
        turn = own("turn", docs)
        repeated = rest.join(again, same, "left_semi").withColumn(turn, F.row_number().over(Window.partitionBy(id_column, row_key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
        rest = rest.join(again, same, "left_anti").unionByName(repeated.where(F.col(turn) == 1).drop(turn))
    return rest.drop(row_key)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Marks a table for broadcast if it proves to have few rows; else Spark joins it as any other."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, which is made if needed. For use within tasks."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def one_per_task(df: DataFrame, rows: int) -> DataFrame:
    """Deals a short list of work items (files, runs) out, about one to a task."""
    return df.repartition(max(1, rows))
