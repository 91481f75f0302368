"""Questions of the slide list: filters, facets, labels, counts, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake.functions.contract import KEY, SLIDES

#: Columns that the list can be filtered by.
FACETS = ("species", "stain", "dose_mg_per_kg")
ANY = "All"
ORDER = ("species", "substance", "dose_mg_per_kg", "animal_id", "stain", "scene")


def slide_path() -> F.Column:
    """Where a slide is; an absolute file name stands for itself."""
    return F.when(F.startswith("file", F.lit("/")), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))


def in_directory(slides: DataFrame, directory: str | None) -> DataFrame:
    """The rows of one root, or all."""
    return slides if directory is None else slides.where(F.col("directory") == directory)


def facet_filter(chosen: dict[str, str]) -> F.Column:
    """The chosen facets as one condition; values are cast to their column's type."""
    for name in chosen:
        if name not in FACETS:
            raise ValueError(f"{name} is no facet; facets are {', '.join(FACETS)}")
    tests = [F.col(c) == F.lit(v).cast(SLIDES[c].dataType) for c, v in chosen.items() if v != ANY]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def row_label() -> F.Column:
    """One line per entry; slides of several scenes name theirs."""
    scene = F.when(F.col("n_scenes") > 1, F.concat(F.lit("  scene "), F.col("scene").cast("string"))).otherwise("")
    return F.format_string("%-6s %s %3d mg/kg  %-3s %s%s", "species", "substance", "dose_mg_per_kg", "animal_id", "stain", scene)


def browse(slides: DataFrame, directory: str | None = None, chosen: dict[str, str] | None = None, ordered: bool = True) -> DataFrame:
    """The filtered rows with n_scenes (counted after filtering), label and path, in list order."""
    shown = in_directory(slides, directory).where(facet_filter(chosen or {}))
    shown = shown.withColumn("n_scenes", F.count("*").over(Window.partitionBy("directory", "file")))
    shown = shown.orderBy(*ORDER, *KEY) if ordered else shown
    return shown.withColumn("label", row_label()).withColumn("path", slide_path())  # after the sort, which carries neither


def facets(slides: DataFrame, directory: str | None = None) -> DataFrame:
    """(facet, value, sort_key) of the distinct values within a root, from one scan.

    'All' comes first; dose sorts as a number.
    """
    pairs = F.expr("stack(3, 'species', species, cast(null as bigint), 'stain', stain, cast(null as bigint), 'dose_mg_per_kg', cast(dose_mg_per_kg as string), dose_mg_per_kg) as (facet, value, sort_key)")
    values = in_directory(slides, directory).select(pairs).distinct().withColumn("first", F.lit(1))
    every = slides.sparkSession.createDataFrame([(f, ANY, None, 0) for f in FACETS], "facet string, value string, sort_key bigint, first int")
    return every.union(values).orderBy("facet", "first", "sort_key", "value").drop("first")


def shown_of_total(slides: DataFrame, directory: str | None = None, chosen: dict[str, str] | None = None, each: Column | None = None) -> DataFrame:
    """One row: shown, total and status, in one pass over the root's rows; each: how many entries a row stands for."""
    if each is None:
        found = F.count_if(facet_filter(chosen or {})), F.count("*")
    else:
        found = (F.coalesce(F.sum(x), F.lit(0)) for x in (F.when(facet_filter(chosen or {}), each), each))
    counts = in_directory(slides, directory).agg(*[x.alias(name) for x, name in zip(found, ("shown", "total"))])
    status = F.when(F.col("shown") == F.col("total"), F.format_string("%d slides", "shown")).otherwise(F.format_string("%d of %d slides", "shown", "total"))
    return counts.withColumn("status", status)


def n_slides(exact: bool = False, approximate: bool = False) -> F.Column:
    """Number of slides: of distinct joined names, or exactly of pairs, or estimated."""
    if approximate:
        return F.approx_count_distinct(F.struct("directory", "file"))
    return F.count_distinct("directory", "file") if exact else F.count_distinct(F.concat("directory", "file"))


def summary(slides: DataFrame) -> DataFrame:
    """Slides and scenes by species, substance, dose and stain, in that order."""
    keys = ORDER[:3] + ("stain",)
    return slides.groupBy(*keys).agg(n_slides().alias("n"), F.count("*").alias("n_scenes")).orderBy(*keys)
