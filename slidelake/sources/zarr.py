"""OME-Zarr stores: metadata texts and tiles, read by path or URI on the executors."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.sources import storage

#: The fields that are read of OME/.zattrs, <series>/.zattrs and <dataset>/.zarray.
OME = "struct<series: array<string>>"
SERIES = "struct<multiscales: array<struct<name: string, axes: array<struct<name: string>>, datasets: array<struct<path: string, coordinateTransformations: array<struct<scale: array<double>>>>>>>>"
ARRAY = "struct<shape: array<bigint>, chunks: array<bigint>, dtype: string, `order`: string, dimension_separator: string, fill_value: int, compressor: struct<id: string>>"
#: Rows of metadata texts; kind is ome, series or array.
TEXTS = "store string, series string, dataset string, kind string, text string"
TILES = "store string, series string, dataset string, level int, ty long, tx long, th long, tw long, channels long, px binary, error string"

#: Bytes of pixels that a task holds before it hands them on, that a dealt range of tiles has, and that a task reads.
HELD, RANGE, READ = 32 << 20, 64 << 20, 1 << 30


def _names(text: str | None, of: Callable[[object], object]) -> list[str]:
    """The strings that a JSON text lists; none if it isn't JSON or of another shape."""
    try:
        found = of(json.loads(text or ""))
    except (ValueError, LookupError, TypeError, AttributeError):
        return []
    return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []


def _texts(store: str) -> Iterator[tuple]:
    """The metadata files of one store as rows of TEXTS, each opened once."""

    def text(name: str) -> str | None:
        try:
            return storage.read(f"{store}/{name}").decode()
        except (OSError, UnicodeDecodeError):
            return None

    ome = text("OME/.zattrs")
    yield store, None, None, "ome", ome
    for series in _names(ome, lambda x: x["series"]):
        attributes = text(f"{series}/.zattrs")
        yield store, series, None, "series", attributes
        for dataset in _names(attributes, lambda x: [d.get("path") for d in x["multiscales"][0]["datasets"]]):
            yield store, series, dataset, "array", text(f"{series}/{dataset}/.zarray")


def metadata_texts(stores: DataFrame) -> DataFrame:
    """The metadata files of a table of stores (column store: path or URI), one row each.

    Their names begin with a dot, which Spark's own readers skip. A file that can't be read or
    isn't UTF-8 gives no row, so that what depends on it becomes an error row later.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for store in batch["store"] for row in _texts(store) if row[4] is not None]
            yield pd.DataFrame(rows, columns=["store", "series", "dataset", "kind", "text"])

    return storage.dealt(stores.select("store")).mapInPandas(read, TEXTS)


def multiscales(texts: DataFrame) -> DataFrame:
    """(store, series, place, name, axes, datasets, arrays) of every listed series, in the store's order.

    The texts of a store are brought together once, so each file behind them is read once;
    arrays holds the series' (dataset, text) of .zarray files.
    """
    part = lambda kind, *columns: F.collect_set(F.when(F.col("kind") == kind, F.struct(*columns))).alias(kind)
    whole = texts.groupBy("store").agg(F.max(F.when(F.col("kind") == "ome", F.col("text"))).alias("ome"), part("series", "series", "text"), part("array", "series", "dataset", "text"))
    listed = whole.withColumnRenamed("series", "all_series").select("store", "all_series", "array", F.posexplode(F.from_json("ome", OME)["series"]).alias("place", "series"))
    text = F.expr("try_element_at(filter(all_series, s -> s.series = series), 1).text")
    first = listed.withColumn("ms", F.from_json(text, SERIES)["multiscales"][0])
    own = F.expr("transform(filter(array, a -> a.series = series), a -> named_struct('dataset', a.dataset, 'text', a.text))")
    return first.select("store", "series", "place", F.col("ms.name").alias("name"), F.transform("ms.axes", lambda a: a["name"]).alias("axes"), F.col("ms.datasets").alias("datasets"), own.alias("arrays"))


def array_of(dataset: str) -> F.Column:
    """The metadata of one of a series' datasets, from its arrays."""
    return F.from_json(F.expr(f"try_element_at(filter(arrays, a -> a.dataset = {dataset}), 1).text"), ARRAY)


def decoded(data: bytes, compressor: str | None) -> bytes:
    """A chunk's bytes; raises ValueError for a codec that isn't installed."""
    if compressor is None:
        return data
    if compressor == "zlib":
        return zlib.decompress(data)
    if compressor == "gzip":
        return gzip.decompress(data)
    raise ValueError(f"unsupported codec: {compressor}")


def tile_plan(levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiles, broken): a row per tile with the paths of all its chunks, and an error row per level without sound metadata.

    levels: store, series, dataset, level, axes, array. A tile is a place of the chunk grid in y
    and x; its chunks are those of all channels, at index 0 of t and z. They follow from the
    metadata, so no pixel is moved to bring them together. The tiles are cut to ranges of about
    RANGE bytes of pixels and these are dealt out in turn, before they become single rows. The
    levels are stored first, so that the metadata behind them is read once.
    """
    levels = storage.stored(levels.select("store", "series", "dataset", "level", "axes", "array"), storage.run_folder(levels.sparkSession, "levels"))
    at = lambda what, name: F.try_element_at(F.col(what), F.nullif(F.array_position("axes", name), F.lit(0)).cast("int"))
    sizes = levels.withColumn("shape", F.col("array.shape")).withColumn("chunks", F.col("array.chunks"))
    sound = (F.size("axes") == F.size("shape")) & (F.size("axes") == F.size("chunks")) & F.forall("chunks", lambda n: n > 0) & F.forall("shape", lambda n: n >= 0) & F.array_contains("axes", "y") & F.array_contains("axes", "x")
    sizes = sizes.withColumn("sound", F.coalesce(sound, F.lit(False)))
    grid = sizes.where("sound")
    for name in ("y", "x", "c"):
        size, step = F.coalesce(at("shape", name), F.lit(1)), F.coalesce(at("chunks", name), F.lit(1))
        grid = grid.withColumn(f"size_{name}", size).withColumn(f"step_{name}", step).withColumn(f"n_{name}", F.ceil(size / step).cast("long"))
    grid = grid.where("n_c > 0").withColumn("bytes", F.expr("greatest(1L, step_y * step_x * size_c)"))
    grid = grid.select("store", "series", "dataset", "level", "axes", F.to_json("array").alias("array"), F.coalesce("array.dimension_separator", F.lit(".")).alias("separator"), *[f"{k}_{a}" for k in ("size", "step", "n") for a in "yxc"], "bytes")
    ranges = storage.cut(grid, F.col("n_y") * F.col("n_x"), F.expr(f"{RANGE} div bytes"))
    total = grid.agg(F.sum(F.expr("n_y * n_x * bytes").cast("double"))).first()[0] or 0
    cells = storage.dealt(ranges, int(total // READ)).withColumn("cell", F.explode(F.expr("sequence(first, last)")))
    cells = cells.withColumn("i_y", F.expr("cell div n_x")).withColumn("i_x", F.expr("cell % n_x"))
    key = "array_join(transform(axes, a -> CASE a WHEN 'y' THEN cast(i_y AS string) WHEN 'x' THEN cast(i_x AS string) WHEN 'c' THEN cast(c AS string) ELSE '0' END), separator)"
    paths = F.expr(f"transform(sequence(0L, n_c - 1), c -> concat_ws('/', store, series, dataset, {key}))")
    tiles = cells.select(
        "store", "series", "dataset", "level", F.expr("i_y * step_y").alias("ty"), F.expr("i_x * step_x").alias("tx"), F.expr("least(step_y, size_y - i_y * step_y)").alias("th"), F.expr("least(step_x, size_x - i_x * step_x)").alias("tw"),
        F.col("size_c").alias("channels"), "axes", "array", paths.alias("paths"),
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("ty", "tx", "th", "tw", "channels")]
    broken = sizes.where("not sound").select("store", "series", "dataset", "level", *zero, F.lit(None).cast("binary").alias("px"), F.lit("ValueError: no array metadata, or of another shape than its axes").alias("error"))
    return tiles, broken


def tiles(levels: DataFrame) -> DataFrame:
    """The tiles of stored levels as (h, w, c) bytes, cropped to the array; all channels, however they are chunked.

    One task reads a tile's chunks, each once, and stacks them. An absent chunk is the fill
    value. Only uint8 arrays in C order; others, unknown codecs and chunks of a wrong length
    make the tile an error row without pixels.
    """
    names = [c.split()[0] for c in TILES.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for r in batch.itertuples():
                px, error = read_tile(list(r.paths), list(r.axes), r.array, int(r.th), int(r.tw))
                rows.append((r.store, r.series, r.dataset, r.level, r.ty, r.tx, r.th, r.tw, r.channels, px, error))
                held += len(px or b"")
                if held > HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    plan, broken = tile_plan(levels)
    return plan.mapInPandas(read, TILES).unionByName(broken)


def read_tile(paths: list[str], axes: list[str], array: str, height: int, width: int) -> tuple[bytes | None, str | None]:
    """(pixels, None) of a tile from the chunks of its channels in order, or (None, error)."""
    meta = json.loads(array)
    shape, chunks = dict(zip(axes, meta["shape"])), dict(zip(axes, meta["chunks"]))
    channels, step = shape.get("c", 1), chunks.get("c", 1)
    out = np.full((height, width, channels), meta.get("fill_value") or 0, np.uint8)
    try:
        if meta.get("dtype") not in ("|u1", "<u1", ">u1") or meta.get("order", "C") != "C":
            raise ValueError(f"unsupported array: dtype {meta.get('dtype')}, order {meta.get('order')}")
        for i, path in enumerate(paths):
            try:
                data = storage.read(path)
            except FileNotFoundError:
                continue
            block = np.frombuffer(decoded(data, (meta.get("compressor") or {}).get("id")), np.uint8).reshape([chunks[a] for a in axes])
            # index 0 of all axes but y, x and c; then these in this order
            block = block[tuple(slice(None) if a in "yxc" else 0 for a in axes)]
            left = [a for a in axes if a in "yxc"]
            block = np.transpose(block, [left.index(a) for a in "yxc" if a in left]).reshape(chunks["y"], chunks["x"], step)
            out[:, :, i * step : (i + 1) * step] = block[:height, :width, : channels - i * step]
        return out.tobytes(), None
    except (OSError, ValueError, zlib.error) as e:
        return None, f"{type(e).__name__}: {e}"
