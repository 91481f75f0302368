"""Zoom levels, tile grids and stage regions, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.operators.geometry import open_slides
from slidelake.sources import storage
from slidelake.sources.formats import dispatch

#: Edge of a tile in pixels of its level.
TILE = 2048


def n_levels(width: str = "width", height: str = "height", tile: int = TILE) -> F.Column:
    """Levels until the larger side, halved each time, fits one tile; in whole numbers."""
    return F.expr(f"size(filter(sequence(0, 40), i -> greatest({width}, {height}) > shiftleft(cast({tile} as bigint), i))) + 1")


def levels(geometry: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per level: ds = 2**level, and the level's size, rounded up."""
    rows = geometry.withColumn("level", F.explode(F.sequence(F.lit(0), n_levels(tile=tile) - 1)))
    rows = rows.withColumn("ds", F.expr("shiftleft(1L, level)"))
    return rows.withColumn("level_w", F.expr("(width + ds - 1) div ds")).withColumn("level_h", F.expr("(height + ds - 1) div ds"))


def tiles(level_rows: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per tile: place and size in its level; edge tiles are short.

    Scenes without area have no tiles. A row's tiles stay in its task; see even_tiles for slides
    of very different sizes.
    """
    rows = level_rows.where("level_w > 0 and level_h > 0").withColumn("y", F.explode(F.expr(f"sequence(0L, level_h - 1, {tile}L)")))
    cells = rows.withColumn("x", F.explode(F.expr(f"sequence(0L, level_w - 1, {tile}L)")))
    return cells.withColumn("th", F.expr(f"least({tile}L, level_h - y)")).withColumn("tw", F.expr(f"least({tile}L, level_w - x)"))


def even_tiles(geometry: DataFrame, tile: int = TILE, tasks: int | None = None, ranges: int = 8) -> DataFrame:
    """The rows of tiles(levels(geometry)), dealt out so that all tasks make about as many tiles.

    Tiles are numbered by slide, level, row and column. How many there are follows from the
    sizes, level by level, so the numbers are cut to ranges of equal length, about `ranges` for
    each task, and these are dealt out in turn; only then is a number turned into its level, y
    and x. Counts the tiles of all slides in one pass first.
    """
    tasks = tasks or storage.tasks(geometry.sparkSession)
    sized = geometry.where("width > 0 and height > 0").withColumn("levels", n_levels(tile=tile))
    across = lambda side, i: f"((({side} + shiftleft(1L, {i}) - 1) div shiftleft(1L, {i})) + {tile - 1}) div {tile}"
    # tiles up to the end of each level
    ends = f"""transform(sequence(0, levels - 1), i -> aggregate(sequence(0, i), 0L, (n, k) -> n + ({across('width', 'k')}) * ({across('height', 'k')})))"""
    sized = sized.withColumn("ends", F.expr(ends)).withColumn("n_tiles", F.element_at("ends", -1))
    total = sized.agg(F.coalesce(F.sum("n_tiles"), F.lit(0))).first()[0]
    parts = storage.cut(sized, F.col("n_tiles"), max(1, -(-total // (tasks * ranges)))).repartition(tasks)
    numbers = parts.withColumn("tile", F.explode(F.expr("sequence(first, last)"))).drop("first", "last")
    rows = numbers.withColumn("level", F.expr("size(filter(ends, e -> e <= tile))")).withColumn("ds", F.expr("shiftleft(1L, level)"))
    rows = rows.withColumn("level_w", F.expr("(width + ds - 1) div ds")).withColumn("level_h", F.expr("(height + ds - 1) div ds"))
    rows = rows.withColumn("place", F.expr("tile - if(level = 0, 0L, ends[level - 1])")).withColumn("columns", F.expr(f"(level_w + {tile - 1}) div {tile}"))
    rows = rows.withColumn("y", F.expr(f"(place div columns) * {tile}L")).withColumn("x", F.expr(f"(place % columns) * {tile}L"))
    rows = rows.withColumn("th", F.expr(f"least({tile}L, level_h - y)")).withColumn("tw", F.expr(f"least({tile}L, level_w - x)"))
    return rows.drop("levels", "ends", "n_tiles", "tile", "place", "columns")


def regions(tile_rows: DataFrame) -> DataFrame:
    """Adds each tile's region in stage coordinates, which ends where the scene does."""
    return (
        tile_rows.withColumn("roi_x", F.expr("x0 + x * ds"))
        .withColumn("roi_y", F.expr("y0 + y * ds"))
        .withColumn("roi_w", F.expr("least(tw * ds, width - x * ds)"))
        .withColumn("roi_h", F.expr("least(th * ds, height - y * ds)"))
    )


def open_pyramids(slides: DataFrame, geometry: DataFrame) -> DataFrame:
    """Each (path, scene) with reader, geometry and number of levels, or an error; no row is lost."""
    found = dispatch(open_slides(slides, geometry).withColumnRenamed("error", "scene_error"))
    error = F.coalesce("error", "scene_error", F.when((F.col("width") <= 0) | (F.col("height") <= 0), "scene has no area"))
    return found.withColumn("error", error).withColumn("n_levels", F.when(F.col("error").isNull(), n_levels())).drop("scene_error")
