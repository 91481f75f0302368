"""Queries that go through files: trees of sidecars and slides, and chunked image stores."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.operators import geometry, pixels
from slidelake.operators.catalog import Catalog
from slidelake.plans import fixtures as fx
from slidelake.sources import formats, sidecars, storage, zarr

_folder = storage.run_folder


def _write(files: DataFrame, folder: str, folders: Sequence[str] = ()) -> None:
    """Writes (name, body) rows as files below a folder, on the executors; spread over several folders in it, each is one task's.

    Tasks that make files in one folder at the same time mostly wait for each other.
    """
    files = files.select("name", "body")
    if len(folders) > 1:
        spread = files.withColumn("at", F.pmod(F.hash("name"), F.lit(len(folders)))).repartition(min(len(folders), storage.tasks(files.sparkSession)), "at")
        dealt = spread.select(F.concat_ws("/", F.get(F.array(*[F.lit(x) for x in folders]), "at"), "name").alias("name"), "body")
    else:
        dealt = storage.dealt(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, body in zip(b["name"], b["body"]):
                storage.write(f"{folder}/{name}", body)
            yield pd.DataFrame({"n": [len(b)]})

    dealt.mapInPandas(run, "n long").agg(F.sum("n")).collect()


#: Files of a round, and rounds at most: small files take a block of disk each, so only a part of them is there at a time.
FILES, ROUNDS = 50_000, 32
#: Files of a folder, and folders of a round at most, from two folders on; with fewer files they lie in the round's own.
WIDTH, FOLDERS = 1_000, 256


def _by_rounds(files: DataFrame, name: str, read: Callable[[str], DataFrame], most: int = ROUNDS, least: int = FILES) -> DataFrame:
    """What `read` finds of (name, body) files in a folder or in numbered ones in it: these are written in rounds, read, and deleted before the next.

    Every file is written and read once. The rows are stored by round, so nothing behind them is
    computed twice; what is found is stored too. Each numbered folder is written and deleted by one task.
    The folder that holds these stays for all rounds: on ext4 without a journal new files were made several
    times faster so, it seems as they are then placed away from those just deleted.
    """
    spark, base = files.sparkSession, _folder(files.sparkSession, name)
    part = F.pmod(F.xxhash64("name"), F.lit(most)).cast("int").alias("round")
    files.select("name", "body", part).write.partitionBy("round").parquet(f"{base}/rows")
    rows = spark.read.schema("name string, body binary, round int").parquet(f"{base}/rows")
    count = rows.count()
    n = max(1, min(most, -(-count // least)))
    folders = [f"{j:03}" for j in range(min(FOLDERS, count // n // WIDTH))]
    folder = f"{base}/files"
    for i in range(n):
        _write(rows.where(F.col("round").isin(*range(i, most, n))), folder, folders)
        found = read(folder)
        found.write.parquet(f"{base}/found/turn={i}")
        if len(folders) > 1:
            storage.removed_each(spark.createDataFrame([(f"{folder}/{x}",) for x in folders], "path string"), len(folders))
        if len(folders) < 2 or i == n - 1:
            storage.removed(spark, folder)
    return spark.read.schema(found.schema).parquet(*[f"{base}/found/turn={i}" for i in range(n)])


def sidecar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sidecars, written as files below hidden and plain folders and scanned again."""
    texts = fx.sidecars(spark, sf_dir)
    hidden = F.concat(F.when(F.col("k") % 3 == 0, ".hidden/_u").otherwise("plain/"), F.col("k").cast("string"), F.lit(".json"))
    files = texts.select(hidden.alias("name"), F.encode("text", "UTF-8").alias("body"))
    name = F.regexp_replace(F.expr("substring(sidecar_path, length(directory) + 2)"), "^[0-9]+/", "")
    return _by_rounds(files, "sidecars", lambda folder: sidecars.scan(spark, folder).select(name.alias("name"), F.get_json_object("text", "$.file").alias("file")))


SIDECAR_SCAN = f"WITH {fx.SIDECAR_SQL} SELECT CASE WHEN k % 3 = 0 THEN '.hidden/_u' ELSE 'plain/' END || k || '.json' AS name, name AS file FROM s2"


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slide files among files named after all orders, some of them hidden or empty, with their lengths."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".CZI", ".tif", ".txt", ".ome.tiff", ".svs")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    names = F.concat(F.when(F.col("o_orderkey") % 7 == 0, ".s").when(F.col("o_orderkey") % 7 == 1, "_s").otherwise("s"), F.col("o_orderkey").cast("string"), suffix)
    body = F.encode(F.repeat(F.lit("x"), (F.col("o_orderkey") % 9).cast("int")), "UTF-8")
    files = fx.table(spark, sf_dir, "orders").select(names.alias("name"), body.alias("body"))

    def found(folder: str) -> DataFrame:
        own = spark.createDataFrame([(folder,)], "path string")
        folders = own.union(sidecars.list_folders(own, 1).where("is_folder").select("path"))
        return formats.slide_files(folders, FOLDERS).select(formats.base_name().alias("name"), "length")

    return _by_rounds(files, "files", found).orderBy("name")  # as one folder's files in path order


FILE_INVENTORY = """SELECT CASE o_orderkey % 7 WHEN 0 THEN '.s' WHEN 1 THEN '_s' ELSE 's' END || o_orderkey || ['.CZI', '.tif', '.txt', '.ome.tiff', '.svs'][o_orderkey % 5 + 1] AS name, o_orderkey % 9 AS length FROM orders WHERE o_orderkey % 5 <> 2"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, p): each embedding's numbers as 64 values from 0 to 250."""
    value = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("long") % 251)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", value.alias("p"))


def _bytes(values: F.Column) -> F.Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def bgr_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoded 7 x 3 tile per embedding, asked for as 8 x 4."""
    size = lambda n, name: F.lit(n).cast("long").alias(name)
    return _pixels(spark, sf_dir).select("vec_id", size(7, "got_h"), size(3, "got_w"), size(8, "th"), size(4, "tw"), _bytes(F.slice("p", 1, 63)).alias("px"))


def level0_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of up to four 8 x 8 tiles; the three channels are an embedding's values, each less one more."""
    channels = F.flatten(F.transform("p", lambda v: F.array(v, v + 1, v + 2)))
    return _pixels(spark, sf_dir).select(
        F.concat(F.lit("/e"), F.expr("vec_id div 4").cast("string")).alias("path"), F.lit(0).cast("long").alias("scene"), F.lit(0).alias("level"), F.expr("(vec_id % 4) div 2").alias("ty"), F.expr("vec_id % 2").alias("tx"),
        F.lit(8).cast("long").alias("th"), F.lit(8).cast("long").alias("tw"), _bytes(channels).alias("px"),
    )


def _store_tiles(spark: SparkSession, sf_dir: str, channels: int, steps: tuple[int, ...]) -> DataFrame:
    """The tiles of a store per embedding: channels of 7 x 8 pixels in zlib chunks of 4 x 4; steps: channels of a chunk, by vec_id."""
    folder = _folder(spark, "stores")

    def meta(step: int) -> dict[str, dict]:
        return {
            "OME/.zattrs": {"series": ["0"]},
            "0/.zattrs": {"multiscales": [{"name": "scan", "axes": [{"name": a} for a in "tczyx"], "datasets": [{"path": "0", "coordinateTransformations": [{"scale": [1, 1, 1, 0.25, 0.25]}]}]}]},
            "0/0/.zarray": {"shape": [1, channels, 1, 7, 8], "chunks": [1, step, 1, 4, 4], "dtype": "|u1", "order": "C", "dimension_separator": "/", "fill_value": 0, "compressor": {"id": "zlib"}},
        }

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for vec_id, p in zip(b["vec_id"], b["p"]):
                step = steps[vec_id % len(steps)]
                rows += [(f"{vec_id}.zarr/{name}", json.dumps(x).encode()) for name, x in meta(step).items()]
                for first in range(0, channels, step):
                    for y in (0, 1):
                        for x in (0, 1):
                            block = bytes((int(p[8 * (4 * y + i) + 4 * x + j]) + c) % 256 for c in range(first, first + step) for i in range(4) for j in range(4))
                            rows.append((f"{vec_id}.zarr/0/0/0/{first // step}/0/{y}/{x}", zlib.compress(block)))
            yield pd.DataFrame(rows, columns=["name", "body"])

    embedded = _pixels(spark, sf_dir)
    _write(embedded.mapInPandas(files, "name string, body binary"), folder)
    stores = embedded.select(F.concat(F.lit(f"{folder}/"), F.col("vec_id").cast("string"), F.lit(".zarr")).alias("store"))
    tiles = zarr.tiles(geometry.zarr_levels(zarr.metadata_texts(stores)))
    return tiles.withColumn("vec_id", F.regexp_extract("store", r"(\d+)\.zarr$", 1).cast("long"))


def zarr_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of 3 channels in chunks of one: sums by tile and channel."""
    sums = pixels.channel_sums(_store_tiles(spark, sf_dir, 3, (1,)))
    return sums.select("vec_id", "ty", "tx", "th", "tw", "sum_r", "sum_g", "sum_b", "error")


def zarr_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of 4 channels in chunks of 1, 3 or 4: sums by tile and channel."""
    sums = pixels.channel_sums(_store_tiles(spark, sf_dir, 4, (1, 3, 4)), "abcd")
    return sums.select("vec_id", "ty", "tx", "th", "tw", "channels", "sum_a", "sum_b", "sum_c", "sum_d", "error")


_BYTES = "list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 251)"
_TILE_SUMS = f"""WITH p AS (SELECT vec_id, {_BYTES} AS p FROM embeddings),
t AS (SELECT vec_id, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, CAST(least(4, 7 - ty) AS BIGINT) AS th, CAST(4 AS BIGINT) AS tw, p FROM p, (VALUES (0), (4)) a(ty), (VALUES (0), (4)) b(tx)),
s AS (SELECT *, CAST(list_sum(list_transform(range(0, th * 4), lambda i: p[8 * (ty + i // 4) + tx + i % 4 + 1])) AS BIGINT) AS s FROM t)"""
ZARR_TILES = f"{_TILE_SUMS} SELECT vec_id, ty, tx, th, tw, s AS sum_r, s + 4 * th AS sum_g, s + 8 * th AS sum_b, CAST(NULL AS VARCHAR) AS error FROM s"
ZARR_CHANNELS = f"{_TILE_SUMS} SELECT vec_id, ty, tx, th, tw, CAST(4 AS BIGINT) AS channels, s AS sum_a, s + 4 * th AS sum_b, s + 8 * th AS sum_c, s + 12 * th AS sum_d, CAST(NULL AS VARCHAR) AS error FROM s"


def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog on disk: all three roots are built, then one again from half of its sidecars; SQL on the stored table."""
    texts = storage.stored(fx.sidecars(spark, sf_dir), _folder(spark, "texts"))  # read by each build
    catalog = Catalog(spark, _folder(spark, "catalog"))
    for root in ("/data/root_0", "/data/root_1", "/data/root_2"):
        catalog.build(texts.where(F.col("directory") == root), root)
    catalog.build(texts.where("directory = '/data/root_1' and k % 2 = 0"), "/data/root_1")
    return catalog.query("-- of the stored snapshot\nSELECT directory, file, scene, stain, dose_mg_per_kg FROM slides WHERE dose_mg_per_kg > ?", [100])


CATALOG_BUILD = f"""WITH {fx.SLIDES_SQL.replace("FROM orders)", "FROM orders WHERE NOT (CAST(floor(o_orderkey / 100) AS BIGINT) % 3 = 1 AND o_orderkey % 2 = 1))")}
SELECT directory, file, scene, stain, dose_mg_per_kg FROM slides WHERE dose_mg_per_kg > 100"""


def sized_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of 1, 2 x 2 and 4 x 4 tiles of 8 pixels, an embedding each; the last row is 5 high and the last column 7 wide."""
    wide = _pixels(spark, sf_dir).withColumn("side", F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.expr("vec_id div 16") % 3 + 1).cast("int")))
    wide = wide.withColumn("ty", F.expr("(vec_id % (side * side)) div side")).withColumn("tx", F.expr("vec_id % side"))
    wide = wide.withColumn("th", F.when(F.expr("ty = side - 1"), 5).otherwise(8).cast("long")).withColumn("tw", F.when(F.expr("tx = side - 1"), 7).otherwise(8).cast("long"))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.col("th").cast("int") - 1), lambda i: F.slice("p", i * 8 + 1, F.col("tw").cast("int"))))
    channels = F.flatten(F.transform(rows, lambda v: F.array(v, v + 1, v + 2)))
    path = F.concat(F.lit("/o"), F.expr("cast(vec_id div (side * side) as string)"), F.lit("_"), F.col("side").cast("string"))
    return wide.select(path.alias("path"), F.lit(0).cast("long").alias("scene"), F.lit(0).alias("level"), "ty", "tx", "th", "tw", _bytes(channels).alias("px"))


def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels above slides of different sizes, each up to its own last one, written and read again: sums by tile and channel."""
    paths = pixels.build_pyramid(sized_tiles(spark, sf_dir), 8, _folder(spark, "pyramid"))
    levels = [spark.read.schema(pixels.LEVEL).parquet(p) for p in paths]
    return pixels.channel_sums(reduce(DataFrame.union, levels))


_MEAN = "CAST((2 * sum(v) + count(*)) // (2 * count(*)) AS BIGINT) AS v"
PYRAMID_LEVELS = f"""WITH q AS (SELECT vec_id, [1, 2, 4][CAST(vec_id // 16 % 3 + 1 AS INT)] AS side, {_BYTES} AS p FROM embeddings),
p AS (SELECT *, '/o' || (vec_id // (side * side)) || '_' || side AS path, (vec_id % (side * side)) // side AS ty, vec_id % side AS tx FROM q),
l0 AS (SELECT path, 8 * ty + i AS y, 8 * tx + j AS x, p[8 * i + j + 1] AS v FROM p, range(0, 8) a(i), range(0, 8) b(j) WHERE (ty < side - 1 OR i < 5) AND (tx < side - 1 OR j < 7)),
n AS (SELECT path, 1 + len(list_filter(range(0, 9), lambda k: greatest(max(y), max(x)) + 1 > 8 * CAST(pow(2, k) AS BIGINT))) AS n_levels FROM l0 GROUP BY path),
l1 AS (SELECT path, y // 2 AS y, x // 2 AS x, {_MEAN} FROM l0 JOIN n USING (path) WHERE n_levels > 1 GROUP BY ALL), l2 AS (SELECT path, y // 2 AS y, x // 2 AS x, {_MEAN} FROM l1 JOIN n USING (path) WHERE n_levels > 2 GROUP BY ALL),
u AS (SELECT 1 AS level, * FROM l1 UNION ALL SELECT 2, * FROM l2)
SELECT path, CAST(0 AS BIGINT) AS scene, CAST(level AS INT) AS level, CAST(y // 8 AS BIGINT) AS ty, CAST(x // 8 AS BIGINT) AS tx, CAST(max(y) % 8 + 1 AS BIGINT) AS th, CAST(max(x) % 8 + 1 AS BIGINT) AS tw,
 CAST(sum(v) AS BIGINT) AS sum_r, CAST(sum(v) + count(*) AS BIGINT) AS sum_g, CAST(sum(v) + 2 * count(*) AS BIGINT) AS sum_b FROM u GROUP BY path, level, y // 8, x // 8"""


def catalog_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog on disk answers from its partial counts: slides and scenes by group, and the facets of one root."""
    texts = storage.stored(fx.sidecars(spark, sf_dir), _folder(spark, "texts"))  # read by each build
    catalog = Catalog(spark, _folder(spark, "catalog"))
    for root in ("/data/root_0", "/data/root_1", "/data/root_2"):
        catalog.build(texts.where(F.col("directory") == root), root)
    groups = catalog.summary().select(F.concat_ws(" ", "species", "substance", F.col("dose_mg_per_kg").cast("string"), "stain").alias("name"), "n", "n_scenes")
    facets = catalog.facets("/data/root_1").select(F.concat_ws(" ", "facet", "value").alias("name"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_scenes"))
    return groups.union(facets).union(catalog.counts().select(F.lit("all").alias("name"), "slides", "n_scenes"))


CATALOG_ANSWERS = f"""WITH {fx.SLIDES_SQL}, s AS (SELECT * FROM slides WHERE directory = '/data/root_1')
SELECT concat_ws(' ', species, substance, dose_mg_per_kg, stain) AS name, count(DISTINCT (directory, file)) AS n, count(*) AS n_scenes FROM slides GROUP BY species, substance, dose_mg_per_kg, stain
UNION ALL SELECT DISTINCT 'species ' || species, 0, 0 FROM s UNION ALL SELECT DISTINCT 'stain ' || stain, 0, 0 FROM s UNION ALL SELECT DISTINCT 'dose_mg_per_kg ' || dose_mg_per_kg, 0, 0 FROM s
UNION ALL SELECT f || ' All', 0, 0 FROM (VALUES ('species'), ('stain'), ('dose_mg_per_kg')) t(f) UNION ALL SELECT 'all', count(DISTINCT (directory, file)), count(*) FROM slides"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {"sidecar_scan": sidecar_scan, "file_inventory": file_inventory, "zarr_tiles": zarr_tiles, "zarr_channels": zarr_channels, "catalog_build": catalog_build, "catalog_answers": catalog_answers, "pyramid_levels": pyramid_levels}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {"sidecar_scan": SIDECAR_SCAN, "file_inventory": FILE_INVENTORY, "zarr_tiles": ZARR_TILES, "zarr_channels": ZARR_CHANNELS, "catalog_build": CATALOG_BUILD, "catalog_answers": CATALOG_ANSWERS, "pyramid_levels": PYRAMID_LEVELS}
