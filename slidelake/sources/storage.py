"""Files of any file system by path or URI, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL = fs.LocalFileSystem()


@cache
def _system(start: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(f"{start}/")[0]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it of a path or URI; a system is connected to once per process."""
    if "://" not in path:
        return _LOCAL, path
    start = re.match(r"[^:]+://[^/]*", path)[0]
    name = path[len(start) :] if start.startswith(("file://", "hdfs://", "viewfs://")) else fs.FileSystem.from_uri(path)[1]
    return _system(start), name


def read(path: str) -> bytes:
    """A file's bytes; OSError (FileNotFoundError) if it can't be read."""
    system, name = opened(path)
    with system.open_input_stream(name) as f:
        return f.read()


def write(path: str, body: bytes) -> None:
    """Writes a file whole: under a name of its own first, so that a task that runs again does no harm."""
    system, name = opened(path)
    part = f"{name}.{uuid.uuid4().hex}"
    try:
        out = system.open_output_stream(part)
    except FileNotFoundError:  # only a folder's first file makes it
        system.create_dir(name.rpartition("/")[0], recursive=True)
        out = system.open_output_stream(part)
    with out as f:
        f.write(body)
    system.move(part, name)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="slidelake-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows, written to a folder as Parquet and read again, so that nothing behind them is computed twice."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def removed_each(folders: DataFrame, n: int) -> None:
    """Deletes n folders (column path) in all tasks, each by one of them, as tasks that delete in one folder wait for each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path in rows["path"]:
                system, name = opened(path)
                if system.get_file_info(name).type == fs.FileType.Directory:  # a task may run again
                    system.delete_dir(name)
            yield pd.DataFrame({"n": [len(rows)]})

    dealt(folders, most=pieces(folders.sparkSession, n, 8)).mapInPandas(run, "n long").agg(F.sum("n")).collect()


def tasks(spark: SparkSession) -> int:
    """As many as a shuffle has, and at least one for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pieces(spark: SparkSession, n: int, each: int) -> int:
    """Tasks for n short pieces of work, as a task that runs Python costs more than some of them: one for `each`, but two a core before any has several."""
    return max(1, -(-n // each), min(n, 2 * spark.sparkContext.defaultParallelism))


def dealt(rows: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Short rows that stand for more work than their own size says, dealt out to all tasks (or `most` of them), in turn."""
    n = max(least, tasks(rows.sparkSession))
    return rows.repartition(n if most is None else min(n, most))


def cut(rows: DataFrame, n: Column, per: Column | int) -> DataFrame:
    """Rows that stand for n pieces of work, cut to ranges of `per` at most: adds first and last."""
    step = F.lit(per).cast("long") if isinstance(per, int) else per.cast("long")
    ranges = rows.withColumn("n", n.cast("long")).withColumn("per", F.greatest(step, F.lit(1).cast("long"))).where("n > 0")
    ranges = ranges.withColumn("first", F.explode(F.expr("sequence(0L, (n - 1) div per)"))).withColumn("first", F.col("first") * F.col("per"))
    return ranges.withColumn("last", F.least(F.col("n"), F.col("first") + F.col("per")) - 1).drop("n", "per")
