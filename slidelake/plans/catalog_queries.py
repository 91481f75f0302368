"""Queries of the slide engine over the given tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.functions.contract import COLUMNS
from slidelake.operators import browse as b
from slidelake.operators import catalog as c
from slidelake.operators import geometry as g
from slidelake.operators import pixels, probe, pyramid, validate
from slidelake.plans import fixtures as fx
from slidelake.plans import store_queries
from slidelake.sources import formats, storage
from slidelake.sources import sidecars as sc

_S = fx.SLIDES_SQL
_COLS = ", ".join(COLUMNS)
ROOT, STAIN, DOSE = "/data/root_1", "he", "100"


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slides table, from JSON texts."""
    return c.slides_of(fx.sidecars(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.project(sc.records(fx.sidecars(spark, sf_dir)))


def summary(spark, sf_dir):
    return b.summary(slides(spark, sf_dir))


SUMMARY = f"""WITH {_S} SELECT species, substance, dose_mg_per_kg, stain, count(DISTINCT directory || file) AS n, count(*) AS n_scenes
FROM slides GROUP BY ALL"""


def scene_records(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return rows.select("directory", "file", F.expr("substring(sidecar_path, length(directory) + 2)").alias("sidecar"), "pos", "scene", "species", "substance", "dose_mg_per_kg", "animal_id", "stain", "modality", "serial_block")


SCENE_RECORDS = f"WITH {_S} SELECT directory, file, sidecar, pos, scene, species, substance, dose_mg_per_kg, animal_id, stain, modality, serial_block FROM rec"


def scene_override_null(spark, sf_dir):
    texts = fx.corrupted(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"^\{", '{"scenes": [{"scene": null}, {"stain": "he"}], '))
    checked = validate.check(sc.records(texts)).where("reject is null and problems like '%scene: %'")
    return checked.select(validate.file_of(checked).alias("file"), "pos")


SCENE_OVERRIDE_NULL = f"""WITH {fx.SIDECAR_SQL} SELECT CASE WHEN k % 20 = 12 THEN NULL ELSE batch || '/' || name END AS file, CAST(0 AS BIGINT) AS pos FROM s2
WHERE k % 20 NOT IN (9, 12, 13, 14, 15, 16, 17) UNION ALL
SELECT batch || '/' || name, CAST(0 AS BIGINT) FROM s2 WHERE k % 20 = 9"""


def last_wins(spark, sf_dir):
    return slides(spark, sf_dir)


LAST_WINS = f"WITH {_S} SELECT {_COLS} FROM slides"


def replace_directory(spark, sf_dir):
    """The whole table, after one root was built anew with a new block name."""
    table = storage.stored(slides(spark, sf_dir), storage.run_folder(spark, "slides"))  # read three times
    anew = table.where(F.col("directory") == ROOT).where("dose_mg_per_kg >= 100").withColumn("serial_block", F.lit("new"))
    return c.replace_directory(table, anew, ROOT)


REPLACE_DIRECTORY = f"""WITH {_S} SELECT {_COLS} FROM slides WHERE directory <> '{ROOT}' UNION ALL
SELECT {_COLS.replace('serial_block', "'new'")} FROM slides WHERE directory = '{ROOT}' AND dose_mg_per_kg >= 100"""


def stale_schema(spark, sf_dir):
    """A table whose columns are in another order is dropped whole before one root is built."""
    table = slides(spark, sf_dir)
    stale = table.select(*reversed(COLUMNS))
    return c.replace_directory(c.fresh(stale), table.where(F.col("directory") == ROOT), ROOT)


STALE_SCHEMA = f"WITH {_S} SELECT {_COLS} FROM slides WHERE directory = '{ROOT}'"


def build_counts(spark, sf_dir):
    return c.build_counts(_records(spark, sf_dir)).select(*[F.col(x).cast("long") for x in ("records_read", "rows_written", "slides")], "note")


BUILD_COUNTS = f"""WITH {_S}, n AS (SELECT (SELECT count(*) FROM rec) AS records_read, count(*) AS rows_written, count(DISTINCT directory || file) AS slides FROM slides)
SELECT *, CASE WHEN records_read <> slides THEN ' (' || records_read || ' scenes)' ELSE '' END AS note FROM n"""


def distinct_slides_exact(spark, sf_dir):
    return slides(spark, sf_dir).agg(b.n_slides(exact=True).alias("exact"), b.n_slides().alias("joined"))


DISTINCT_SLIDES_EXACT = f"WITH {_S} SELECT count(DISTINCT (directory, file)) AS exact, count(DISTINCT directory || file) AS joined FROM slides"


def _checked(spark, sf_dir):
    return validate.check(sc.records(fx.corrupted(spark, sf_dir)))


def validation_report(spark, sf_dir):
    checked = _checked(spark, sf_dir).where("problems is not null")
    return checked.select("sidecar_path", "pos", "problems")


_PROBLEMS = """CASE k % 20
 WHEN 1 THEN 'species: Field required'
 WHEN 2 THEN 'stain: Input should be ''he'' or ''cyp2e1'''
 WHEN 5 THEN 'dose_mg_per_kg: Input should be a valid integer, unable to parse string as an integer'
 WHEN 6 THEN 'dose_mg_per_kg: Input should be a valid integer, got a number with a fractional part'
 WHEN 8 THEN 'animal_id: Input should be a valid string'
 WHEN 9 THEN 'scene: Input should be a valid integer'
 WHEN 10 THEN 'animal_id: Input should be a valid string; stain: Input should be ''he'' or ''cyp2e1'''
 WHEN 12 THEN 'no file' WHEN 13 THEN 'file is not a bare name' WHEN 14 THEN 'not a JSON object' WHEN 15 THEN 'not a JSON object'
 WHEN 16 THEN 'scenes is not a list of objects' WHEN 17 THEN 'scenes is not a list of objects' END"""
_BAD = f"WITH {fx.SIDECAR_SQL}, bad AS (SELECT directory || '/' || sidecar AS sidecar_path, CAST(0 AS BIGINT) AS pos, {_PROBLEMS} AS problems, batch || '/' || name AS file, k FROM s2)"
VALIDATION_REPORT = f"{_BAD} SELECT sidecar_path, pos, problems FROM bad WHERE problems IS NOT NULL"


def validation_first(spark, sf_dir):
    return validate.first_problem(_checked(spark, sf_dir))


VALIDATION_FIRST = f"""{_BAD} SELECT CASE WHEN k % 20 >= 12 THEN sidecar_path ELSE file END AS file, problems FROM bad
WHERE problems IS NOT NULL ORDER BY string_split(sidecar_path, '/'), pos LIMIT 1"""


def validation_gate(spark, sf_dir):
    return validate.gate_counts(_checked(spark, sf_dir))


VALIDATION_GATE = f"{_BAD} SELECT count(*) AS records, count(*) FILTER (problems IS NULL) AS valid, count(problems) AS rejected FROM bad"


def browse(spark, sf_dir):
    return b.browse(slides(spark, sf_dir))


_LABEL = """rpad(species, CAST(greatest(6, length(species)) AS INT), ' ') || ' ' || substance || ' ' || lpad(CAST(dose_mg_per_kg AS VARCHAR), CAST(greatest(3, length(CAST(dose_mg_per_kg AS VARCHAR))) AS INT), ' ') || ' mg/kg  '
 || rpad(animal_id, CAST(greatest(3, length(animal_id)) AS INT), ' ') || ' ' || stain || CASE WHEN n_scenes > 1 THEN '  scene ' || scene ELSE '' END AS label, directory || '/' || file AS path"""
_BROWSE = "SELECT *, {label} FROM (SELECT *, count(*) OVER (PARTITION BY directory, file) AS n_scenes FROM slides {where})"
BROWSE = f"WITH {_S} {_BROWSE.format(label=_LABEL, where='')}"


def browse_filtered(spark, sf_dir):
    return b.browse(slides(spark, sf_dir), ROOT, {"stain": STAIN, "dose_mg_per_kg": DOSE, "species": b.ANY})


_WHERE = f"WHERE directory = '{ROOT}' AND stain = '{STAIN}' AND dose_mg_per_kg = {DOSE}"
BROWSE_FILTERED = f"WITH {_S} {_BROWSE.format(label=_LABEL, where=_WHERE)}"


def facets(spark, sf_dir):
    return b.facets(slides(spark, sf_dir), ROOT)


FACETS = f"""WITH {_S}, s AS (SELECT * FROM slides WHERE directory = '{ROOT}')
SELECT 'species' AS facet, species AS value, CAST(NULL AS BIGINT) AS sort_key FROM s GROUP BY ALL
UNION ALL SELECT 'stain', stain, CAST(NULL AS BIGINT) FROM s GROUP BY ALL
UNION ALL SELECT 'dose_mg_per_kg', CAST(dose_mg_per_kg AS VARCHAR), dose_mg_per_kg FROM s GROUP BY ALL
UNION ALL SELECT f, 'All', CAST(NULL AS BIGINT) FROM (VALUES ('species'), ('stain'), ('dose_mg_per_kg')) t(f)"""


def shown_of_total(spark, sf_dir):
    return b.shown_of_total(slides(spark, sf_dir), ROOT, {"stain": STAIN})


SHOWN_OF_TOTAL = f"""WITH {_S}, n AS (SELECT count(*) FILTER (stain = '{STAIN}') AS shown, count(*) AS total FROM slides WHERE directory = '{ROOT}')
SELECT *, CASE WHEN shown = total THEN shown || ' slides' ELSE shown || ' of ' || total || ' slides' END AS status FROM n"""


def sql_dose_over_200(spark, sf_dir):
    return c.query(slides(spark, sf_dir), "SELECT file, dose_mg_per_kg FROM slides WHERE dose_mg_per_kg > ?", [200])


SQL_DOSE_OVER_200 = f"WITH {_S} SELECT file, dose_mg_per_kg FROM slides WHERE dose_mg_per_kg > 200"


def path_order(spark, sf_dir):
    """The sidecars in path order."""
    return fx.sidecars(spark, sf_dir).select("sidecar_path").orderBy(sc.path_order())


PATH_ORDER = f"WITH {fx.SIDECAR_SQL} SELECT directory || '/' || sidecar AS sidecar_path FROM s2 ORDER BY string_split(directory || '/' || sidecar, '/')"


def reader_dispatch(spark, sf_dir):
    paths = fx.rects(spark, sf_dir).select("path").distinct()
    return formats.classify(formats.dispatch(paths)).select("path", "suffix", "error", "vendor", "openable", "probe")


READER_DISPATCH = f"""WITH {fx.RECTS_SQL}, p AS (SELECT DISTINCT path, regexp_extract(path, '[.][^.]*$') AS suffix FROM rects)
SELECT path, suffix, CASE WHEN suffix = '.svs' THEN 'no reader for ''.svs'': ' || regexp_extract(path, '[^/]*$') || '. Known formats: .czi, .zarr' END AS error,
 CASE suffix WHEN '.czi' THEN 'Zeiss' WHEN '.svs' THEN 'Leica / Aperio' END AS vendor, suffix <> '.svs' AS openable, CASE suffix WHEN '.czi' THEN 'czi' ELSE 'tiff' END AS probe FROM p"""


def _geometry(spark, sf_dir):
    return g.scene_geometry(fx.rects(spark, sf_dir), fx.headers(spark, sf_dir))


def scene_geometry(spark, sf_dir):
    return _geometry(spark, sf_dir).select("path", "scene", "n_scenes", "x0", "y0", "width", "height")


SCENE_GEOMETRY = f"WITH {fx.RECTS_SQL} SELECT path, scene, n_scenes, x0, y0, width, height FROM geometry"


def pixel_size(spark, sf_dir):
    return _geometry(spark, sf_dir).select("path", "scene", "pixel_size_um", "anisotropic")


_PX = "CASE WHEN k % 11 = 0 THEN NULL ELSE (200 + k % 50) / 1e9 END"
_PY = f"CASE WHEN k % 7 = 0 THEN (201 + k % 50) / 1e9 ELSE {_PX} END"
PIXEL_SIZE = f"""WITH {fx.RECTS_SQL}, p AS (SELECT path, {_PX} AS px, {_PY} AS py FROM headers)
SELECT path, scene, px * 1e6 AS pixel_size_um, coalesce(abs(px - coalesce(py, px)) > 1e-6 * greatest(px, coalesce(py, px)), false) AS anisotropic FROM geometry JOIN p USING (path)"""


def _wanted(spark, sf_dir):
    """Catalog references: what slides there are, and the scenes that their sidecars name."""
    return slides(spark, sf_dir).select(b.slide_path().alias("path"), F.col("scene").cast("int").alias("scene"))


def open_slides(spark, sf_dir):
    found = pyramid.open_pyramids(_wanted(spark, sf_dir), _geometry(spark, sf_dir))
    return found.select("path", "scene", "suffix", "n_levels", "error")


_LEVELS = "CAST(1 + len(list_filter(range(0, 41), lambda i: greatest(width, height) > 2048 * CAST(pow(2, i) AS BIGINT))) AS INT)"
_WANTED = f"{_S}, {fx.RECTS_SQL.split('AS name FROM sc),', 1)[1].lstrip()}, want AS (SELECT directory || '/' || file AS path, CAST(scene AS INT) AS scene FROM slides)"
OPEN_SLIDES = f"""WITH {_WANTED}, there AS (SELECT path, list_sort(list(scene)) AS scenes FROM geometry GROUP BY path),
j AS (SELECT w.path, w.scene, regexp_extract(w.path, '[^/]*$') AS name, regexp_extract(w.path, '[.][^.]*$') AS suffix, width, height, scenes FROM want w LEFT JOIN geometry g USING (path, scene) LEFT JOIN there t ON w.path = t.path),
e AS (SELECT *, CASE WHEN suffix = '.svs' THEN 'no reader for ''.svs'': ' || name || '. Known formats: .czi, .zarr'
 WHEN scenes IS NULL THEN 'no geometry: ' || name WHEN width IS NULL THEN name || ' has no scene ' || scene || ', only [' || array_to_string(scenes, ', ') || ']' END AS error FROM j)
SELECT path, scene, suffix, CASE WHEN error IS NULL THEN {_LEVELS} END AS n_levels, error FROM e"""


def broken_references(spark, sf_dir):
    return g.broken_references(_wanted(spark, sf_dir), _geometry(spark, sf_dir))


BROKEN_REFERENCES = f"WITH {_WANTED} SELECT path, scene FROM want WHERE NOT EXISTS (SELECT 1 FROM geometry g WHERE g.path = want.path AND g.scene = want.scene)"


def layer_names(spark, sf_dir):
    return _geometry(spark, sf_dir).select("path", "scene", g.layer_name().alias("name"), g.layer_status().alias("status"))


LAYER_NAMES = f"""WITH {fx.RECTS_SQL}, n AS (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') || CASE WHEN n_scenes > 1 THEN ' s' || scene ELSE '' END AS name FROM geometry)
SELECT path, scene, name, name || '  ' || width || 'x' || height || ' px' AS status FROM n"""


def level_table(spark, sf_dir):
    return pyramid.levels(_geometry(spark, sf_dir)).select("path", "scene", "level", "ds", "level_w", "level_h")


_LEVEL = f"""lv AS (SELECT *, (width + ds - 1) // ds AS level_w, (height + ds - 1) // ds AS level_h FROM
 (SELECT *, CAST(pow(2, level) AS BIGINT) AS ds FROM (SELECT *, CAST(unnest(range(0, {_LEVELS})) AS INT) AS level FROM geometry)))"""
LEVEL_TABLE = f"WITH {fx.RECTS_SQL}, {_LEVEL} SELECT path, scene, level, ds, level_w, level_h FROM lv"


def _tiles(spark, sf_dir):
    return pyramid.tiles(pyramid.levels(_geometry(spark, sf_dir)))


def tile_grid(spark, sf_dir):
    return _tiles(spark, sf_dir).select("path", "scene", "level", "y", "x", "th", "tw")


_TILE = """tl AS (SELECT *, least(2048, level_h - y) AS th, least(2048, level_w - x) AS tw FROM
 (SELECT *, unnest(range(0, level_w, 2048)) AS x FROM (SELECT *, unnest(range(0, level_h, 2048)) AS y FROM lv)))"""
TILE_GRID = f"WITH {fx.RECTS_SQL}, {_LEVEL}, {_TILE} SELECT path, scene, level, y, x, th, tw FROM tl"


def tile_grid_even(spark, sf_dir):
    """The same tiles, cut evenly to tasks."""
    return pyramid.even_tiles(_geometry(spark, sf_dir)).select("path", "scene", "level", "y", "x", "th", "tw")


TILE_GRID_EVEN = TILE_GRID


def tile_regions(spark, sf_dir):
    return pyramid.regions(_tiles(spark, sf_dir)).select("path", "scene", "level", "y", "x", "roi_x", "roi_y", "roi_w", "roi_h")


TILE_REGIONS = f"""WITH {fx.RECTS_SQL}, {_LEVEL}, {_TILE} SELECT path, scene, level, y, x, x0 + x * ds AS roi_x, y0 + y * ds AS roi_y,
 least(tw * ds, width - x * ds) AS roi_w, least(th * ds, height - y * ds) AS roi_h FROM tl"""


def zarr_geometry(spark, sf_dir):
    return g.zarr_geometry(fx.zarr_texts(spark, sf_dir))


ZARR_GEOMETRY = """SELECT '/data/z' || o_orderkey || '.zarr' AS path, CAST(s AS INT) AS scene, CAST(2 AS BIGINT) AS n_scenes, CAST(0 AS BIGINT) AS x0, CAST(0 AS BIGINT) AS y0,
 1 + (o_orderkey * 7919) % 12000 AS width, 1 + (o_orderkey * 6101) % 9000 AS height, CAST(0.25 AS DOUBLE) AS pixel_size_um, o_orderkey % 7 = 0 AS anisotropic
FROM orders, range(0, 2) t(s)"""


def zarr_levels(spark, sf_dir):
    rows = g.zarr_levels(fx.zarr_texts(spark, sf_dir))
    return rows.select("store", "scene", "series", "level", "dataset", F.col("array.shape")[3].alias("level_h"), F.col("array.shape")[4].alias("level_w"))


ZARR_LEVELS = """SELECT '/data/z' || o_orderkey || '.zarr' AS store, CAST(s AS INT) AS scene, CAST(s + 1 AS VARCHAR) AS series, CAST(d AS INT) AS level, CAST(d AS VARCHAR) AS dataset,
 (1 + (o_orderkey * 6101) % 9000 + d) // (1 + d) AS level_h, (1 + (o_orderkey * 7919) % 12000 + d) // (1 + d) AS level_w
FROM orders, range(0, 2) t(s), range(0, 2) u(d)"""


def tile_normalize(spark, sf_dir):
    """An embedding's numbers as a decoded 7 x 3 BGR tile, in place of one of 8 x 4 pixels; sums by channel."""
    tiles = store_queries.bgr_tiles(spark, sf_dir)
    return pixels.channel_sums(pixels.normalise(tiles)).select("vec_id", "sum_r", "sum_g", "sum_b")


_BYTES = "list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 251)"
TILE_NORMALIZE = f"""WITH p AS (SELECT vec_id, {_BYTES} AS p FROM embeddings)
SELECT vec_id, {', '.join(f"CAST(list_sum(list_transform(range(0, 21), lambda i: p[3 * i + {3 - k}])) + 11 * 255 AS BIGINT) AS sum_{n}" for k, n in enumerate('rgb'))} FROM p"""


def pyramid_build(spark, sf_dir):
    """Level 1 of slides of four 8 x 8 tiles each: sums by channel of the means."""
    return pixels.channel_sums(pixels.next_level(store_queries.level0_tiles(spark, sf_dir), 8))


_AT = "p[16 * (i // 4) + 2 * (i % 4) + {}]"
PYRAMID_BUILD = f"""WITH p AS (SELECT vec_id, {_BYTES} AS p FROM embeddings),
s AS (SELECT vec_id, list_sum(list_transform(range(0, 16), lambda i: ({' + '.join(_AT.format(n) for n in (1, 2, 9, 10))} + 2) // 4)) AS s FROM p)
SELECT '/e' || (vec_id // 4) AS path, CAST(0 AS BIGINT) AS scene, CAST(1 AS INT) AS level, CAST(0 AS BIGINT) AS ty, CAST(0 AS BIGINT) AS tx,
 CAST(CASE WHEN max(vec_id % 4) >= 2 THEN 8 ELSE 4 END AS BIGINT) AS th, CAST(CASE WHEN max(vec_id % 4) >= 1 THEN 8 ELSE 4 END AS BIGINT) AS tw,
 CAST(sum(s) AS BIGINT) AS sum_r, CAST(sum(s) + 16 * count(*) AS BIGINT) AS sum_g, CAST(sum(s) + 32 * count(*) AS BIGINT) AS sum_b FROM s GROUP BY vec_id // 4"""


def probe_axes(spark, sf_dir):
    return probe.axes(fx.headers(spark, sf_dir)).select("path", "code", "name", "extent", "line")


PROBE_AXES = f"""WITH {fx.RECTS_SQL}, a AS (SELECT path, 'X' AS code, 'width' AS name, bx0 AS a, bx1 AS z FROM headers UNION ALL SELECT path, 'Y', 'height', by0, by1 FROM headers UNION ALL SELECT path, 'C', 'channels', 0, 1 + k % 3 FROM headers)
SELECT path, code, name, z - a AS extent, '    ' || code || ' ' || rpad(name, 12, ' ') || ' ' || lpad(CAST(z - a AS VARCHAR), CAST(greatest(7, length(CAST(z - a AS VARCHAR))) AS INT), ' ') || CASE WHEN code = 'C' THEN '' ELSE ' px   from ' || a || ' to ' || z END AS line FROM a"""


def probe_scenes(spark, sf_dir):
    return probe.scene_rollup(fx.rects(spark, sf_dir), fx.headers(spark, sf_dir)).select("path", "n_scenes", "scene_px", "union_w", "union_h", "union_px", "empty_percent", "rgb_gb")


_ROLL = "roll AS (SELECT path, count(*) AS n_scenes, CAST(sum(w * h) AS BIGINT) AS scene_px FROM rects GROUP BY path), r AS (SELECT *, bx1 - bx0 AS union_w, by1 - by0 AS union_h, (bx1 - bx0) * (by1 - by0) AS union_px FROM roll JOIN headers USING (path))"
PROBE_SCENES = f"""WITH {fx.RECTS_SQL}, {_ROLL} SELECT path, n_scenes, scene_px, union_w, union_h, union_px, 100 * (1 - scene_px / union_px) AS empty_percent, scene_px * 3 / 1e9 AS rgb_gb FROM r"""


def _files(spark, sf_dir):
    """The inventory that the headers belong to, and one file more for each tenth without a header."""
    there = fx.headers(spark, sf_dir).select("path", (F.col("k") * 1_000_003).alias("length"), "k")
    lost = there.where("k % 10 = 3").select(F.concat(F.lit("/lost/x"), F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, ".czi").otherwise(".tif")).alias("path"), "length")
    return there.drop("k").union(lost)


def probe_czi(spark, sf_dir):
    return probe.czi_report(_files(spark, sf_dir), fx.headers(spark, sf_dir), fx.rects(spark, sf_dir))


_FILES = """f AS (SELECT path, k * 1000003 AS length FROM headers UNION ALL SELECT '/lost/x' || k || CASE WHEN k % 3 = 0 THEN '.czi' ELSE '.tif' END, k * 1000003 FROM headers WHERE k % 10 = 3)"""
_MB = "printf('%.0f MB', length / 1e6) AS on_disk"
_FINE = "CASE WHEN failed IS NULL THEN"
PROBE_CZI = f"""WITH {fx.RECTS_SQL}, {_ROLL}, {_FILES},
sl AS (SELECT path, string_agg(printf('    [%d] x=%d y=%d w=%d h=%d', scene, x, y, w, h), chr(10) ORDER BY scene) AS lines FROM rects GROUP BY path),
j AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'RuntimeError: bad header' WHEN n_scenes IS NULL THEN 'RuntimeError: no header' END AS failed FROM f LEFT JOIN r USING (path) LEFT JOIN sl USING (path) WHERE path LIKE '%.czi')
SELECT path, regexp_extract(path, '[^/]*$') AS name, CASE WHEN failed IS NULL AND (bx0 < 0 OR by0 < 0) THEN '(' || bx0 || ', ' || by0 || ')' END AS origin, n_scenes, {_MB},
 {_FINE} printf('%-11s %d x %d px  (%.2f Gpx)', CASE WHEN n_scenes = 1 THEN 'size' ELSE 'union size' END, union_w, union_h, union_px / 1e9) END AS size_line,
 {_FINE} CASE WHEN k % 3 = 0 THEN '{{0: ''Bgr24'', 1: ''Gray8''}}' ELSE '{{0: ''Bgr24''}}' END END AS pixel_type, {_FINE} lines END AS scene_lines,
 CASE WHEN failed IS NULL AND n_scenes > 1 THEN printf('%.2f Gpx  (%.0f%% of the union is empty stage)', scene_px / 1e9, 100 * (1 - scene_px / union_px)) END AS scene_line,
 {_FINE} printf('%.1f GB', scene_px * 3 / 1e9) END AS in_memory,
 {_FINE} CASE WHEN k % 11 = 0 THEN 'not found in metadata, image has no physical scale' ELSE printf('%.4f um', (200 + k % 50) / 1e9 * 1e6) END END AS pixel_size,
 {_FINE} CASE WHEN k % 11 <> 0 THEN printf('%.4f um', (200 + k % 50) / 1e9 * 1e6) END END AS pixel_x,
 {_FINE} CASE WHEN k % 7 = 0 THEN printf('%.4f um', (201 + k % 50) / 1e9 * 1e6) WHEN k % 11 <> 0 THEN printf('%.4f um', (200 + k % 50) / 1e9 * 1e6) END END AS pixel_y,
 CASE WHEN failed IS NULL AND n_scenes > 1 THEN 'multi-scene file, readers assuming one scene will miss data' END AS note, 'FAILED: ' || failed AS error FROM j"""


def probe_tiff(spark, sf_dir):
    return probe.tiff_report(_files(spark, sf_dir), fx.headers(spark, sf_dir), fx.tiff_series(spark, sf_dir))


PROBE_TIFF = f"""WITH {fx.RECTS_SQL}, {_FILES},
j AS (SELECT f.path, length, k, CASE WHEN k % 13 = 0 THEN 'RuntimeError: bad header' WHEN k IS NULL THEN 'ValueError: no header' END AS failed FROM f LEFT JOIN headers h ON f.path = h.path WHERE f.path NOT LIKE '%.czi')
SELECT path, regexp_extract(path, '[^/]*$') AS name, CASE WHEN failed IS NULL THEN CASE WHEN k % 4 = 0 THEN 'OME-TIFF' ELSE 'TIFF' END END AS format, {_MB},
 CASE WHEN failed IS NULL THEN CAST(2 AS BIGINT) END AS n_series, CASE WHEN failed IS NULL THEN CASE WHEN k % 2 = 0 THEN 'JPEG' ELSE 'LZW' END END AS compression,
 CASE WHEN failed IS NULL THEN CASE WHEN k % 5 <> 0 THEN 'True (256x512)' ELSE 'False' END END AS tiled,
 CASE WHEN failed IS NULL THEN concat_ws('; ', CASE WHEN k % 5 = 0 THEN 'not tiled, reading a region costs whole image rows' END, CASE WHEN k % 4 = 0 THEN 'no pyramid, zoomed-out views must read full resolution' END) END AS notes,
 'FAILED: ' || failed AS error FROM j"""


def probe_series(spark, sf_dir):
    return probe.series_lines(fx.tiff_series(spark, sf_dir))


PROBE_SERIES = f"""WITH {fx.RECTS_SQL} SELECT path, CAST(s AS INT) AS series, '    [' || s || '] (' || (by1 - by0) || ', ' || (bx1 - bx0) || ', 3) uint8 axes=YXS pyramid levels=' || CASE WHEN s = 0 THEN 1 + k % 4 ELSE 1 END AS line
FROM headers, range(0, 2) t(s)"""


def probe_failures(spark, sf_dir):
    """Every file that a probe would report as failed."""
    files, heads = _files(spark, sf_dir), fx.headers(spark, sf_dir)
    czi = probe.czi_report(files, heads, fx.rects(spark, sf_dir)).select("path", "name", "error")
    tiff = probe.tiff_report(files, heads, fx.tiff_series(spark, sf_dir)).select("path", "name", "error")
    return czi.union(tiff).where("error is not null")


PROBE_FAILURES = f"""WITH {fx.RECTS_SQL}, {_FILES} SELECT f.path, regexp_extract(f.path, '[^/]*$') AS name,
 CASE WHEN k IS NOT NULL THEN 'FAILED: RuntimeError: bad header' WHEN f.path LIKE '%.czi' THEN 'FAILED: RuntimeError: no header' ELSE 'FAILED: ValueError: no header' END AS error
FROM f LEFT JOIN headers h ON f.path = h.path WHERE k IS NULL OR k % 13 = 0"""

_NAMES = """summary scene_records scene_override_null last_wins replace_directory stale_schema build_counts distinct_slides_exact
validation_report validation_first validation_gate browse browse_filtered facets shown_of_total sql_dose_over_200 path_order reader_dispatch
scene_geometry pixel_size open_slides broken_references layer_names level_table tile_grid tile_grid_even tile_regions zarr_geometry zarr_levels
tile_normalize pyramid_build probe_axes probe_scenes probe_czi probe_tiff probe_series probe_failures""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {name: globals()[name] for name in _NAMES} | store_queries.queries()


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: globals()[name.upper()] for name in _NAMES if name.upper() in globals()} | store_queries.oracle_sql()
