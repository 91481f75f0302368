"""Slide collections made from the given tables: orders are sidecars, lineitems their scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Runs in Spark and in DuckDB alike. s2: a row per sidecar; rec: per scene; slides: the table.
SIDECAR_SQL = """
sc AS (
 SELECT o_orderkey AS k,
        CASE WHEN o_orderkey % 50 = 49 THEN o_orderkey - 1 ELSE o_orderkey END AS fk,
        '/data/root_' || CAST(CAST(floor(o_orderkey / 100) AS BIGINT) % 3 AS STRING) AS directory,
        'batch_' || CAST(CAST(floor(o_orderkey / 100) AS BIGINT) % 7 AS STRING) AS batch,
        CASE o_orderkey % 3 WHEN 0 THEN 'mouse' WHEN 1 THEN 'pig' ELSE 'human' END AS species,
        'sub_' || o_orderstatus AS substance,
        CAST((o_orderkey % 8) * 50 AS BIGINT) AS dose_mg_per_kg,
        'A' || CAST(o_custkey % 500 AS STRING) AS animal_id,
        CASE o_orderkey % 2 WHEN 0 THEN 'he' ELSE 'cyp2e1' END AS stain,
        CASE o_orderkey % 2 WHEN 0 THEN 'brightfield' ELSE 'fluorescence' END AS modality,
        'B' || CAST(o_custkey % 97 AS STRING) AS serial_block
 FROM orders),
s2 AS (SELECT *, batch || '/sc_' || lpad(CAST(k AS STRING), 10, '0') || '.json' AS sidecar,
        'slide_' || CAST(fk AS STRING) || CASE WHEN fk % 10 < 7 THEN '.czi' WHEN fk % 10 < 9 THEN '.ome.zarr' ELSE '.svs' END AS name FROM sc)"""
SLIDES_SQL = f"""{SIDECAR_SQL},
ln AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS pos
 FROM lineitem),
rec AS (SELECT s2.directory, batch || '/' || name AS file, s2.sidecar, CAST(coalesce(ln.pos, 0) AS BIGINT) AS pos,
        CAST(CASE WHEN ln.pos IS NULL THEN 0 WHEN ln.l_linestatus = 'F' THEN ln.l_linenumber ELSE ln.pos END AS BIGINT) AS scene,
        species, substance, dose_mg_per_kg, animal_id,
        CASE ln.l_returnflag WHEN 'R' THEN 'cyp2e1' WHEN 'A' THEN 'he' ELSE stain END AS stain, modality, serial_block
 FROM s2 LEFT JOIN ln ON s2.k = ln.l_orderkey),
slides AS (SELECT file, species, substance, dose_mg_per_kg, animal_id, stain, modality, serial_block, CAST(NULL AS STRING) AS original_name, directory, scene
 FROM (SELECT *, row_number() OVER (PARTITION BY directory, file, scene ORDER BY sidecar DESC, pos DESC) AS rn FROM rec) z WHERE rn = 1)"""

#: Scene rectangles and headers of every sidecar's slide, by its key k.
RECTS_SQL = f"""{SIDECAR_SQL},
rects AS (SELECT directory || '/' || batch || '/' || name AS path, CAST(k % 2 AS INT) AS scene,
        -((k * 31) % 200000) AS x, -((k * 17) % 200000) AS y, 1 + (k * 7919) % 12000 AS w, 1 + (k * 6101) % 9000 AS h, k
 FROM s2),
geometry AS (SELECT path, scene, CAST(count(*) OVER (PARTITION BY path) AS BIGINT) AS n_scenes, x AS x0, y AS y0, w AS width, h AS height FROM rects),
headers AS (SELECT path, min(x) AS bx0, max(x + w) AS bx1, min(y) AS by0, max(y + h) AS by1, min(k) AS k FROM rects GROUP BY path)"""


def over_orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a text of the SQL above, which reads the table of orders; the session keeps no view."""
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(directory, sidecar_path, text, k): a JSON text per order, scenes from its lineitems."""
    heads = over_orders(spark, sf_dir, f"WITH {SIDECAR_SQL} SELECT * FROM s2")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    # one sort by order and line, which the join below has a use for too, in place of a sort of each
    # list; dealt out first, as a table that is read by one task would stay in one up to the join
    turn = Window.partitionBy("l_orderkey").orderBy(*order)
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").select("l_orderkey", F.collect_list(F.struct("l_linestatus", "l_linenumber", "l_returnflag")).over(whole).alias("lines"), F.row_number().over(turn).alias("turn")).where("turn = 1")
    entry = lambda e: F.struct(
        F.when(e["l_linestatus"] == "F", e["l_linenumber"]).alias("scene"),
        F.when(e["l_returnflag"] == "R", "cyp2e1").when(e["l_returnflag"] == "A", "he").alias("stain"),
    )
    joined = heads.join(lines, F.col("k") == F.col("l_orderkey"), "left")
    fields = ["species", "substance", "dose_mg_per_kg", "animal_id", "stain", "modality", "serial_block"]
    body = F.to_json(F.struct(F.col("name").alias("file"), *fields, F.transform("lines", entry).alias("scenes"), F.lit("x").alias("note")))
    return joined.select("directory", F.concat_ws("/", "directory", "sidecar").alias("sidecar_path"), body.alias("text"), "k")


def corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars without scenes, each with the fault that its key mod 20 names (or none)."""
    heads = over_orders(spark, sf_dir, f"WITH {SIDECAR_SQL} SELECT * FROM s2")
    case, out = F.col("k") % 20, {}
    value = lambda name, plain, *faults: F.concat(F.lit(f'"{name}": '), sum_when(plain, faults))

    def sum_when(plain: F.Column, faults: tuple) -> F.Column:
        return F.coalesce(*[F.when(case == n, F.lit(text)) for n, text in faults], plain) if faults else plain

    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    out = [
        F.when(case != 12, value("file", quoted("name"), (13, '"a/b.czi"'))),
        F.when(case != 1, value("species", quoted("species"))),
        value("substance", quoted("substance")),
        value("dose_mg_per_kg", F.col("dose_mg_per_kg").cast("string"), (3, '" 300 "'), (4, '"1_000"'), (5, '"3e2"'), (6, "300.5"), (7, "true")),
        value("animal_id", quoted("animal_id"), (8, "7"), (10, "7")),
        value("stain", quoted("stain"), (2, '"HE"'), (10, '"HE"')),
        value("modality", quoted("modality")),
        value("serial_block", quoted("serial_block")),
        F.when(case == 9, F.lit('"scenes": [{"scene": null}]')).when(case == 16, F.lit('"scenes": {"a": 1}')).when(case == 17, F.lit('"scenes": [1]')),
        F.when(case == 11, F.lit('"note": "x"')),
    ]
    text = F.when(case == 14, "{bad").when(case == 15, "[1]").otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *out), F.lit("}")))
    return heads.select("directory", F.concat_ws("/", "directory", "sidecar").alias("sidecar_path"), text.alias("text"), "k")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene rectangles of the slides."""
    return over_orders(spark, sf_dir, f"WITH {RECTS_SQL} SELECT * FROM rects")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header per slide file; some have no pixel size, some none of x and y equal, some failed."""
    return over_orders(spark, sf_dir, f"""WITH {RECTS_SQL}
        SELECT path, k, map('X', named_struct('start', bx0, 'stop', bx1), 'Y', named_struct('start', by0, 'stop', by1), 'C', named_struct('start', 0L, 'stop', 1 + k % 3)) AS bbox,
               if(k % 3 = 0, map(0, 'Bgr24', 1, 'Gray8'), map(0, 'Bgr24')) AS pixel_types,
               if(k % 11 = 0, null, (200 + k % 50) / 1e9) AS pixel_x_m, if(k % 7 = 0, (201 + k % 50) / 1e9, if(k % 11 = 0, null, (200 + k % 50) / 1e9)) AS pixel_y_m,
               k % 4 = 0 AS is_ome, if(k % 2 = 0, 'JPEG', 'LZW') AS compression, k % 5 <> 0 AS is_tiled, CAST(256 AS INT) AS tile_w, CAST(512 AS INT) AS tile_h,
               if(k % 13 = 0, 'RuntimeError: bad header', null) AS error
        FROM headers""")


def tiff_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images per slide file."""
    return over_orders(spark, sf_dir, f"""WITH {RECTS_SQL}
        SELECT path, CAST(s AS INT) AS series, array(by1 - by0, bx1 - bx0, 3L) AS shape, 'uint8' AS dtype, 'YXS' AS axes, CAST(if(s = 0, 1 + k % 4, 1) AS INT) AS n_levels
        FROM headers LATERAL VIEW explode(array(0, 1)) t AS s""")


def zarr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata texts of one store per order: a label image and two scenes of two levels each."""
    base = over_orders(spark, sf_dir, "SELECT o_orderkey AS k, '/data/z' || o_orderkey || '.zarr' AS store, 1 + (o_orderkey * 7919) % 12000 AS w, 1 + (o_orderkey * 6101) % 9000 AS h FROM orders")
    series = base.withColumn("s", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))))
    ome = base.select("store", F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("dataset"), F.lit("ome").alias("kind"), F.lit('{"series": ["0", "1", "2"]}').alias("text"))
    attributes = F.format_string(
        '{"multiscales": [{"name": "%s", "axes": [{"name": "t"}, {"name": "c"}, {"name": "z"}, {"name": "y"}, {"name": "x"}], "datasets": [{"path": "0", "coordinateTransformations": [{"scale": [1, 1, 1, %s, %s]}]}, {"path": "1", "coordinateTransformations": [{"scale": [1, 1, 1, 1.0, 1.0]}]}]}]}',
        F.when(F.col("s") == "0", "label image").otherwise(F.concat(F.lit("scan "), "s")),
        F.when(F.col("k") % 7 == 0, "0.5").otherwise("0.25"),
        F.lit("0.25"),
    )
    attrs = series.select("store", F.col("s").alias("series"), F.lit(None).cast("string").alias("dataset"), F.lit("series").alias("kind"), attributes.alias("text"))
    levels = series.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
    half = lambda c: F.expr(f"({c} + d) div (1 + d)")
    array = F.format_string('{"shape": [1, 3, 1, %d, %d], "chunks": [1, 1, 1, 1024, 1024], "dtype": "|u1", "order": "C", "dimension_separator": "/", "fill_value": 0, "compressor": {"id": "zlib"}}', half("h"), half("w"))
    arrays = levels.select("store", F.col("s").alias("series"), F.col("d").cast("string").alias("dataset"), F.lit("array").alias("kind"), array.alias("text"))
    return ome.union(attrs).union(arrays)
