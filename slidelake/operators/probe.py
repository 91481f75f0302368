"""Reports on slide files from tables of their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.sources.formats import base_name, last_suffix

# Names of the axes; below also the layout of the lines and the notes.
AXES = {"X": "width", "Y": "height", "Z": "focal planes", "T": "timepoints", "C": "channels", "B": "blocks"}


def _fixed(number: F.Column, digits: int) -> F.Column:
    """A number with so many decimals, rounded as C and Python do: by its exact value, halves to the even digit.

    format_string rounds the shortest decimal form, halves up.
    """
    return F.call_function("format_number", number, F.lit("0." + "0" * digits if digits else "0"))


def axes(headers: DataFrame) -> DataFrame:
    """(path, code, name, extent, line): one row per axis of each bounding box."""
    names = F.create_map(*[F.lit(x) for pair in AXES.items() for x in pair])
    rows = headers.select("path", F.explode("bbox").alias("code", "range"))
    rows = rows.withColumn("name", F.coalesce(F.try_element_at(names, F.col("code")), F.lit("?"))).withColumn("extent", F.col("range.stop") - F.col("range.start"))
    place = F.format_string("    %s %-12s %7d px   from %d to %d", "code", "name", "extent", "range.start", "range.stop")
    plain = F.format_string("    %s %-12s %7d", "code", "name", "extent")
    return rows.withColumn("line", F.when(F.col("code").isin("X", "Y"), place).otherwise(plain)).drop("range")


def _union() -> list[F.Column]:
    """Width and height of a header's scenes together."""
    return [(F.col("bbox")[a]["stop"] - F.col("bbox")[a]["start"]).alias(name) for a, name in (("X", "union_w"), ("Y", "union_h"))]


def _sums(rects: DataFrame, *further: F.Column) -> DataFrame:
    """By file: n_scenes, scene_px and further aggregates."""
    return rects.groupBy("path").agg(F.count("*").alias("n_scenes"), F.sum(F.col("w") * F.col("h")).alias("scene_px"), *further)


def _sized(sums: DataFrame) -> DataFrame:
    """Adds the sizes that follow from scene_px, union_w and union_h."""
    found = sums.withColumn("union_px", F.col("union_w") * F.col("union_h"))
    empty = 100 * (1 - F.col("scene_px") / F.nullif("union_px", F.lit(0)))
    return found.withColumn("empty_percent", empty).withColumn("scene_gpx", F.col("scene_px") / 1e9).withColumn("union_gpx", F.col("union_px") / 1e9).withColumn("rgb_gb", F.col("scene_px") * 3 / 1e9)


def scene_rollup(rects: DataFrame, headers: DataFrame) -> DataFrame:
    """By file: n_scenes, scene and union pixels, % of the union that is empty, gigapixels, GB as RGB."""
    return _sized(_sums(rects).join(headers.select("path", *_union()), "path"))


def czi_report(files: DataFrame, headers: DataFrame, rects: DataFrame) -> DataFrame:
    """One row per .czi file of (path, length): path, sizes, notes, or why it failed; no file is lost.

    scene_lines has a line for each scene rectangle, in order of the scenes.
    """
    origin = lambda a: F.col("bbox")[a]["start"]
    types = F.array_join(F.transform(F.array_sort(F.map_entries("pixel_types")), lambda e: F.concat(e["key"].cast("string"), F.lit(": '"), e["value"], F.lit("'"))), ", ")
    line = F.format_string("    [%d] x=%d y=%d w=%d h=%d", "scene", "x", "y", "w", "h")
    listed = F.array_sort(F.collect_list(F.struct("scene", line.alias("line")))).alias("lines")  # a slide has few scenes
    # rectangles are grouped once and headers joined once: each sort of a join takes memory of its own in the task
    details = headers.select("path", F.lit(True).alias("there"), *_union(), "pixel_x_m", "pixel_y_m", F.concat(F.lit("{"), types, F.lit("}")).alias("types"), origin("X").alias("x0"), origin("Y").alias("y0"), F.col("error").alias("failure"))
    found = _sized(files.where(last_suffix() == ".czi").join(details, "path", "left").join(_sums(rects, listed), "path", "left"))
    found = found.withColumn("n_scenes", F.when(F.col("there"), F.col("n_scenes")))
    several, failed = F.col("n_scenes") > 1, F.coalesce("failure", F.when(F.col("n_scenes").isNull(), "RuntimeError: no header"))
    size = F.format_string("%-11s %d x %d px  (%s Gpx)", F.when(F.col("n_scenes") == 1, "size").otherwise("union size"), "union_w", "union_h", _fixed(F.col("union_gpx"), 2))
    pixel = F.when(F.col("pixel_x_m").isNull(), "not found in metadata, image has no physical scale").otherwise(F.format_string("%s um", _fixed(F.col("pixel_x_m") * 1e6, 4)))
    return found.select(
        "path",
        base_name().alias("name"),
        F.when(failed.isNull(), size).alias("size_line"),
        F.when(failed.isNull() & ((F.col("x0") < 0) | (F.col("y0") < 0)), F.format_string("(%d, %d)", "x0", "y0")).alias("origin"),
        F.when(failed.isNull(), F.col("types")).alias("pixel_type"),
        "n_scenes",
        F.when(failed.isNull(), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("scene_lines"),
        F.when(failed.isNull() & several, F.format_string("%s Gpx  (%s%% of the union is empty stage)", _fixed(F.col("scene_gpx"), 2), _fixed(F.col("empty_percent"), 0))).alias("scene_line"),
        F.format_string("%s MB", _fixed(F.col("length") / 1e6, 0)).alias("on_disk"),
        F.when(failed.isNull(), F.format_string("%s GB", _fixed(F.col("rgb_gb"), 1))).alias("in_memory"),
        F.when(failed.isNull(), pixel).alias("pixel_size"),
        F.when(failed.isNull(), F.when(F.col("pixel_x_m").isNotNull(), F.format_string("%s um", _fixed(F.col("pixel_x_m") * 1e6, 4)))).alias("pixel_x"),
        F.when(failed.isNull(), F.when(F.col("pixel_y_m").isNotNull(), F.format_string("%s um", _fixed(F.col("pixel_y_m") * 1e6, 4)))).alias("pixel_y"),
        F.when(failed.isNull() & several, "multi-scene file, readers assuming one scene will miss data").alias("note"),
        F.when(failed.isNotNull(), F.concat(F.lit("FAILED: "), failed)).alias("error"),
    )


def tiff_report(files: DataFrame, headers: DataFrame, series: DataFrame) -> DataFrame:
    """One row per other slide file: path, format, series, compression, tiling, notes, or why it failed."""
    counts = series.groupBy("path").agg(F.count("*").alias("n_series"), F.min_by("n_levels", "series").alias("first_levels"))
    found = files.where(last_suffix() != ".czi").join(headers, "path", "left").join(counts, "path", "left")
    failed = F.coalesce("error", F.when(F.col("n_series").isNull(), "ValueError: no header"))
    size = F.when(F.col("is_tiled"), F.format_string(" (%dx%d)", "tile_w", "tile_h")).otherwise("")
    notes = F.filter(
        F.array(F.when(~F.col("is_tiled"), "not tiled, reading a region costs whole image rows"), F.when(F.col("first_levels") == 1, "no pyramid, zoomed-out views must read full resolution")),
        lambda n: n.isNotNull(),
    )
    return found.select(
        "path",
        base_name().alias("name"),
        F.when(failed.isNull(), F.when(F.col("is_ome"), "OME-TIFF").otherwise("TIFF")).alias("format"),
        F.format_string("%s MB", _fixed(files["length"] / 1e6, 0)).alias("on_disk"),
        F.when(failed.isNull(), F.col("n_series")).alias("n_series"),
        F.when(failed.isNull(), F.col("compression")).alias("compression"),
        F.when(failed.isNull(), F.concat(F.initcap(F.col("is_tiled").cast("string")), size)).alias("tiled"),
        F.when(failed.isNull(), F.array_join(notes, "; ")).alias("notes"),
        F.when(failed.isNotNull(), F.concat(F.lit("FAILED: "), failed)).alias("error"),
    )


def series_lines(series: DataFrame) -> DataFrame:
    """(path, series, line): one row per image of a TIFF file."""
    shape = F.concat(F.lit("("), F.array_join(F.transform("shape", lambda n: n.cast("string")), ", "), F.when(F.size("shape") == 1, ",").otherwise(""), F.lit(")"))
    return series.select("path", "series", F.format_string("    [%d] %s %s axes=%s pyramid levels=%d", "series", shape, "dtype", "axes", "n_levels").alias("line"))
