"""Slide files: their inventory, and which reader a name calls for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.sources import storage

# Suffixes with a reader; suffixes of slide files, with the scanner's vendor.
READERS = (".czi", ".zarr")
VENDORS = {
    ".czi": "Zeiss",
    ".ome.tiff": "OME-TIFF",
    ".ome.tif": "OME-TIFF",
    ".tiff": "TIFF",
    ".tif": "TIFF",
    ".ndpi": "Hamamatsu",
    ".svs": "Leica / Aperio",
    ".qptiff": "Akoya / PerkinElmer",
}


def base_name(path: str = "path") -> F.Column:
    """The last part of a path."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def last_suffix(path: str = "path") -> F.Column:
    """From the last dot of the name, lower case; none for a leading or trailing dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)$", 1))


def suffix(path: str = "path") -> F.Column:
    """The longest suffix with a reader that the name ends with, else the last suffix."""
    known = F.filter(F.array(*[F.lit(s) for s in READERS]), lambda s: F.endswith(F.lower(base_name(path)), s))
    longest = F.array_max(F.transform(known, lambda s: F.struct(F.length(s), s.alias("s"))))["s"]
    return F.coalesce(longest, last_suffix(path))


def dispatch(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds suffix and error, which says that no reader exists for it."""
    known = ", ".join(sorted(READERS))
    error = F.when(~F.col("suffix").isin(*READERS), F.concat(F.lit("no reader for '"), "suffix", F.lit("': "), base_name(path), F.lit(f". Known formats: {known}")))
    return files.withColumn("suffix", suffix(path)).withColumn("error", error)


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds vendor (null: no slide file), probe ('czi' or 'tiff') and openable."""
    last = last_suffix(path)
    vendor = F.create_map(*[F.lit(x) for pair in VENDORS.items() for x in pair])
    return files.withColumn("vendor", F.try_element_at(vendor, last)).withColumn("probe", F.when(last == ".czi", "czi").otherwise("tiff")).withColumn("openable", suffix(path).isin(*READERS))


def slide_files(folders: DataFrame, n: int) -> DataFrame:
    """(path, length) of the slide files that n folders (column path) hold themselves, in no order; hidden and empty ones, too.

    The folders are paths or URIs that the executors can list, dealt out to all tasks. Content is never read.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for base in rows["path"]:
                system, name = storage.opened(base)
                found = [x for x in system.get_file_info(fs.FileSelector(name)) if x.is_file]
                for at in range(0, len(found), 5_000):
                    yield pd.DataFrame({"path": [f"{base.rstrip('/')}/{x.base_name}" for x in found[at : at + 5_000]], "length": [x.size for x in found[at : at + 5_000]]})

    files = storage.dealt(folders.select("path"), most=storage.pieces(folders.sparkSession, n, 16)).mapInPandas(entries, "path string, length long")
    return files.where(last_suffix().isin(*VENDORS))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's own slide files, in path order. They are stored before the sort, which would list the folder once more for each of its passes."""
    files = slide_files(spark.createDataFrame([(folder.rstrip("/") or "/",)], "path string"), 1)
    return storage.stored(files, storage.run_folder(spark, "inventory")).orderBy(F.split("path", "/"))
