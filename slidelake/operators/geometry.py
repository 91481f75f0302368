"""Scene geometry, pixel size, and the join of catalog rows with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidelake.sources.formats import base_name
from slidelake.sources.zarr import array_of, multiscales

# Names of a slide's own thumbnails, which aren't scenes.
THUMBNAILS = ("label image", "macro image")


def pixel_size(x: F.Column, y: F.Column, factor: float = 1.0) -> tuple[F.Column, F.Column]:
    """(pixel_size_um, anisotropic): the x size, and whether y differs by over 1e-6 of the larger."""
    other = F.coalesce(y, x)
    return x * F.lit(factor), F.abs(x - other) > 1e-6 * F.greatest(x, other)


def scene_geometry(rects: DataFrame, pixels: DataFrame) -> DataFrame:
    """Geometry from scene rectangles (path, scene, x, y, w, h) and pixel sizes in metres by path."""
    size, uneven = pixel_size(F.col("pixel_x_m"), F.col("pixel_y_m"), 1e6)
    n = F.count("*").over(Window.partitionBy("path"))
    found = rects.withColumn("n_scenes", n).join(pixels.select("path", "pixel_x_m", "pixel_y_m"), "path", "left")
    return found.select(
        "path", "scene", "n_scenes", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("w").alias("width"), F.col("h").alias("height"), size.alias("pixel_size_um"), F.coalesce(uneven, F.lit(False)).alias("anisotropic")
    )


def image_series(texts: DataFrame) -> DataFrame:
    """The series that are scenes: without thumbnails, scene being the place among the rest."""
    images = multiscales(texts).where(F.col("name").isNull() | ~F.col("name").isin(*THUMBNAILS))
    in_order = Window.partitionBy("store").orderBy("place")
    return images.withColumn("scene", F.row_number().over(in_order) - 1).withColumn("n_scenes", F.count("*").over(Window.partitionBy("store")))


def zarr_geometry(texts: DataFrame) -> DataFrame:
    """Geometry of stores from their metadata texts; origin 0, size by axis name."""
    scenes = image_series(texts).withColumn("array", array_of("datasets[0].path"))
    at = lambda what, axis: F.try_element_at(what, F.nullif(F.array_position("axes", axis), F.lit(0)).cast("int"))
    scale = F.col("datasets")[0]["coordinateTransformations"][0]["scale"]
    size, uneven = pixel_size(at(scale, "x"), at(scale, "y"))
    shape = F.col("array.shape")
    return scenes.select(
        F.col("store").alias("path"), "scene", "n_scenes", F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), at(shape, "x").alias("width"), at(shape, "y").alias("height"), size.alias("pixel_size_um"), F.coalesce(uneven, F.lit(False)).alias("anisotropic")
    )


def zarr_levels(texts: DataFrame) -> DataFrame:
    """(store, scene, series, level, dataset, axes, array): one row per stored level."""
    scenes = image_series(texts).select("store", "series", "scene", "axes", "arrays", F.posexplode("datasets").alias("level", "d")).withColumn("dataset", F.col("d.path"))
    return scenes.select("store", "series", "dataset", "scene", "axes", "level", array_of("dataset").alias("array"))


def open_slides(slides: DataFrame, geometry: DataFrame) -> DataFrame:
    """Each (path, scene) with its geometry, or an error that lists the scenes there are.

    Negative scenes are errors, too. Rows without any geometry for their path say so.
    """
    there = geometry.groupBy("path").agg(F.sort_array(F.collect_set("scene")).alias("scenes"))
    joined = slides.join(geometry, ["path", "scene"], "left").join(there, "path", "left")
    listed = F.concat(F.lit("["), F.array_join(F.transform("scenes", lambda s: s.cast("string")), ", "), F.lit("]"))
    missing = F.concat(base_name(), F.lit(" has no scene "), F.col("scene").cast("string"), F.lit(", only "), listed)
    error = F.when(F.col("scenes").isNull(), F.concat(F.lit("no geometry: "), base_name())).when(F.col("width").isNull(), missing)
    return joined.withColumn("error", error).drop("scenes")


def broken_references(slides: DataFrame, geometry: DataFrame) -> DataFrame:
    """The catalog rows whose scene has no geometry."""
    return slides.join(geometry.select("path", "scene"), ["path", "scene"], "left_anti")


def layer_name() -> F.Column:
    """The file's stem, with the scene if the file has several."""
    stem = F.regexp_replace(base_name(), r"(?<=.)\.[^.]+$", "")
    return F.concat(stem, F.when(F.col("n_scenes") > 1, F.concat(F.lit(" s"), F.col("scene").cast("string"))).otherwise(""))


def layer_status() -> F.Column:
    """The line shown after loading: name and size."""
    return F.concat(layer_name(), F.format_string("  %dx%d px", "width", "height"))
