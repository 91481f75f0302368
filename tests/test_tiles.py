import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake.operators import browse, geometry, pixels, pyramid
from slidelake.sources import formats, zarr


def grid(spark, sizes):
    rows = [(f"/p{i}", 0, 1, -5 * i, 7, w, h) for i, (w, h) in enumerate(sizes)]
    scenes = spark.createDataFrame(rows, "path string, scene int, n_scenes long, x0 long, y0 long, width long, height long")
    plain = pyramid.tiles(pyramid.levels(scenes))
    found = pyramid.regions(pyramid.even_tiles(scenes, tasks=7))
    assert sorted(pyramid.regions(plain).select(*found.columns).collect()) == sorted(found.collect())
    return found


SIZES = [(1, 1), (2047, 2048), (2048, 2049), (2049, 1), (4097, 8193), (12345, 6789), (0, 5)]


def test_tiles_cover_each_level_once(spark):
    found = grid(spark, SIZES).toPandas()
    assert "/p6" not in set(found.path)
    for (path, level), tiles in found.groupby(["path", "level"]):
        w, h = SIZES[int(path[2:])]
        lw, lh = -(-w // 2**level), -(-h // 2**level)
        assert (tiles.tw * tiles.th).sum() == lw * lh and not tiles.duplicated(["x", "y"]).any()
        assert (tiles.x + tiles.tw).max() == lw and (tiles.y + tiles.th).max() == lh
        assert (tiles.roi_x - tiles.x0 + tiles.roi_w <= w).all() and (tiles.roi_w > 0).all() and (tiles.roi_h > 0).all()
    for path, tiles in found.groupby("path"):
        assert len(tiles[tiles.level == tiles.level.max()]) == 1
        w, h = SIZES[int(path[2:])]
        n = 1
        while max(w, h) / 2 ** (n - 1) > 2048:
            n += 1
        assert tiles.level.max() + 1 == n


def store(folder, image, chunks, compressor="zlib", skip=()):
    """A Zarr v2 store of a (1, c, 1, y, x) image."""
    meta = {"shape": list(image.shape), "chunks": list(chunks), "dtype": "|u1", "order": "C", "dimension_separator": "/", "fill_value": 9, "compressor": {"id": compressor} if compressor else None}
    attrs = {"multiscales": [{"name": "scan", "axes": [{"name": a} for a in "tczyx"], "datasets": [{"path": "0", "coordinateTransformations": [{"scale": [1, 1, 1, 0.5, 0.25]}]}]}]}
    thumb = {"multiscales": [attrs["multiscales"][0] | {"name": "label image"}]}
    for name, text in {"OME/.zattrs": {"series": ["0", "1"]}, "0/.zattrs": thumb, "1/.zattrs": attrs, "1/0/.zarray": meta}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps(text))
    grid = [range(-(-n // c)) for n, c in zip(image.shape, chunks)]
    for key in np.ndindex(*map(len, grid)):
        if key in skip:
            continue
        block = np.zeros(chunks, np.uint8)
        part = image[tuple(slice(k * c, (k + 1) * c) for k, c in zip(key, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        path = folder / "1/0" / "/".join(map(str, key))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(zlib.compress(block.tobytes()) if compressor == "zlib" else block.tobytes())


@pytest.mark.parametrize("channels", [1, 3, 4, 6])
@pytest.mark.parametrize("chunks", [(1, 1, 1, 4, 4), (1, 3, 1, 4, 4), (1, 4, 1, 3, 7), (1, 6, 1, 8, 8)])
def test_zarr_tiles_equal_numpy(spark, tmp_path, channels, chunks):
    image, compressor = np.random.default_rng(1).integers(0, 255, (1, channels, 1, 5, 7), np.uint8), "zlib" if channels != 3 else None
    store(tmp_path / "s.zarr", image, chunks, compressor)
    texts = zarr.metadata_texts(spark.createDataFrame([(str(tmp_path / "s.zarr"),)], "store string"))
    shape = geometry.zarr_geometry(texts).first()
    assert (shape.scene, shape.n_scenes, shape.width, shape.height, shape.pixel_size_um, shape.anisotropic) == (0, 1, 7, 5, 0.25, True)
    tiles = zarr.tiles(geometry.zarr_levels(texts)).collect()
    whole = np.zeros((5, 7, channels), np.uint8)
    assert len({(t.ty, t.tx) for t in tiles}) == len(tiles)
    for t in tiles:
        assert t.error is None and t.channels == channels
        whole[t.ty : t.ty + t.th, t.tx : t.tx + t.tw] = np.frombuffer(t.px, np.uint8).reshape(t.th, t.tw, channels)
    assert (whole == np.moveaxis(image[0, :, 0], 0, -1)).all()


def test_each_file_is_opened_once(spark, tmp_path, monkeypatch):
    image = np.ones((1, 4, 1, 5, 7), np.uint8)
    store(tmp_path / "s.zarr", image, (1, 3, 1, 4, 4))
    read, names = zarr.storage.read, []
    monkeypatch.setattr(zarr.storage, "read", lambda path: names.append(path) or read(path))
    texts = list(zarr._texts(str(tmp_path / "s.zarr")))
    levels = geometry.zarr_levels(spark.createDataFrame([t for t in texts if t[4]], zarr.TEXTS))
    plan = zarr.tile_plan(levels)[0].collect()
    assert all(zarr.read_tile(r.paths, r.axes, r.array, r.th, r.tw)[1] is None for r in plan)
    chunks = {str(p) for p in tmp_path.rglob("1/0/*/*/*/*/*") if p.is_file()}
    assert len(names) == len(set(names)) and {n for n in names if not n.endswith((".zattrs", ".zarray"))} == chunks and len(chunks) == 8
    # the plan reads chunks in one place, and no metadata: that was read when the levels were stored
    whole = zarr.tiles(geometry.zarr_levels(zarr.metadata_texts(spark.createDataFrame([(str(tmp_path / "s.zarr"),)], "store string"))))
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1 and whole.count() == 4


def test_stores_and_files_by_uri(spark, tmp_path):
    store(tmp_path / "s.zarr", np.full((1, 3, 1, 5, 7), 7, np.uint8), (1, 3, 1, 4, 4))
    texts = zarr.metadata_texts(spark.createDataFrame([(f"file://{tmp_path}/s.zarr",)], "store string"))
    assert {frozenset(t.px) for t in zarr.tiles(geometry.zarr_levels(texts)).collect()} == {frozenset({7})}
    for name in (".h.czi", "_u.tif", "empty.svs", ".czi", "x.txt", "b.NDPI"):
        (tmp_path / name).write_bytes(b"" if name == "empty.svs" else b"12")
    found = formats.inventory(spark, f"file://{tmp_path}").collect()
    assert [(r.path.rpartition("/")[2], r.length) for r in found] == [(".h.czi", 2), ("_u.tif", 2), ("b.NDPI", 2), ("empty.svs", 0)]


def test_an_inventory_lists_its_folder_once_and_names_are_cut_without_a_search(spark, tmp_path):
    for name in ("b.svs", "a.czi", "x.txt"):
        (tmp_path / name).write_bytes(b"1")
    found = formats.inventory(spark, str(tmp_path))
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # its sort would run it for each of its passes
    assert [r.path for r in found.collect()] == [f"{tmp_path}/a.czi", f"{tmp_path}/b.svs"]
    names = spark.createDataFrame([("a/b//",), ("/",), ("",), ("b",), ("/x/.b.CZI",), (None,)], "path string").select(formats.base_name().alias("name"))
    assert [r.name for r in names.collect()] == ["b", "", "", "b", ".b.CZI", None]
    assert "regexp" not in names._jdf.queryExecution().optimizedPlan().toString()


def test_absent_chunk_and_unknown_codec(spark, tmp_path):
    image = np.ones((1, 3, 1, 4, 4), np.uint8)
    store(tmp_path / "a.zarr", image, (1, 3, 1, 4, 4), skip={(0, 0, 0, 0, 0)})
    store(tmp_path / "b.zarr", image, (1, 3, 1, 4, 4), "blosc")
    texts = zarr.metadata_texts(spark.createDataFrame([(str(tmp_path / n),) for n in ("a.zarr", "b.zarr", "none.zarr")], "store string"))
    tiles = {t.store[-6:]: t for t in zarr.tiles(geometry.zarr_levels(texts)).collect()}
    assert set(tiles["a.zarr"].px) == {9} and tiles["a.zarr"].error is None
    assert tiles["b.zarr"].px is None and "unsupported codec: blosc" in tiles["b.zarr"].error


@pytest.mark.parametrize("shape", [(8, 8), (13, 9), (5, 16)])
def test_next_level_is_the_box_mean(spark, shape):
    image = np.random.default_rng(2).integers(0, 255, (*shape, 3), np.uint8)
    cut = [("/p", 0, 0, y, x, image[8 * y : 8 * y + 8, 8 * x : 8 * x + 8]) for y in range(-(-shape[0] // 8)) for x in range(-(-shape[1] // 8))]
    rows = [(*r[:5], r[5].shape[0], r[5].shape[1], bytearray(r[5].tobytes())) for r in cut]
    found = pixels.next_level(spark.createDataFrame(rows, pixels.LEVEL), 8).collect()
    h, w = -(-shape[0] // 2), -(-shape[1] // 2)
    whole = np.zeros((h, w, 3), np.uint8)
    for t in found:
        whole[8 * t.ty : 8 * t.ty + t.th, 8 * t.tx : 8 * t.tx + t.tw] = np.frombuffer(t.px, np.uint8).reshape(t.th, t.tw, 3)
    for y in range(h):
        for x in range(w):
            part = image[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].reshape(-1, 3).astype(int)
            assert (whole[y, x] == (2 * part.sum(0) + len(part)) // (2 * len(part))).all()


def cut_to_tiles(path, image, tile):
    parts = [(path, 0, 0, y, x, image[tile * y : tile * y + tile, tile * x : tile * x + tile]) for y in range(-(-image.shape[0] // tile)) for x in range(-(-image.shape[1] // tile))]
    return [(*p[:5], p[5].shape[0], p[5].shape[1], bytearray(p[5].tobytes())) for p in parts]


@pytest.mark.parametrize("up", [1, 2, 3])
@pytest.mark.parametrize("given", [True, False])
def test_slides_of_different_sizes_end_at_their_own_level(spark, tmp_path, up, given):
    sizes = {"/one": (4, 3), "/low": (5, 40), "/odd": (17, 13), "/wide": (9, 33), "/large": (33, 31)}
    images = {p: np.random.default_rng(i).integers(0, 255, (*size, 3), np.uint8) for i, (p, size) in enumerate(sizes.items())}
    rows = [r for p, image in images.items() for r in cut_to_tiles(p, image, 4)]
    geometry = spark.createDataFrame([(p, 0, w, h) for p, (h, w) in sizes.items()], "path string, scene int, width long, height long")
    paths = pixels.build_pyramid(spark.createDataFrame(rows, pixels.LEVEL).repartition(5), 4, str(tmp_path / "p"), geometry if given else None, up)
    found = {(r.path, r.level, r.ty, r.tx): r for p in paths for r in spark.read.parquet(p).collect()}
    n = 0
    for path, image in images.items():
        level = 0
        while max(image.shape[:2]) > 4:
            wide = np.pad(image.astype(int), ((0, image.shape[0] % 2), (0, image.shape[1] % 2), (0, 0)))
            count = np.pad(np.ones((*image.shape[:2], 1), int), ((0, image.shape[0] % 2), (0, image.shape[1] % 2), (0, 0)))
            total, k = (sum(a[y::2, x::2] for y in (0, 1) for x in (0, 1)) for a in (wide, count))
            image, level = ((2 * total + k) // (2 * k)).astype(np.uint8), level + 1
            for _, _, _, y, x, h, w, px in cut_to_tiles(path, image, 4):
                r = found[path, level, y, x]
                assert (r.th, r.tw, r.px) == (h, w, px)
                n += 1
    assert n == len(found) and len(paths) == -(-4 // up)


def test_morton_numbers(spark):
    rows = spark.range(256).selectExpr("id div 16 y", "id % 16 x").select("y", "x", pixels.morton("y", "x").alias("m")).collect()
    assert {r.m for r in rows} == set(range(256)) and all({r.m for r in rows if r.y // 4 == gy and r.x // 4 == gx} == set(range(16 * k, 16 * k + 16)) for k, (gy, gx) in ((0, (0, 0)), (5, (0, 3)), (15, (3, 3))))


def test_even_tiles_of_one_huge_slide(spark):
    rows = [("/huge", 0, 400_000, 300_000)] + [(f"/s{i}", 0, 10, 10) for i in range(300)]
    tiles = pyramid.even_tiles(spark.createDataFrame(rows, "path string, scene int, width long, height long"), tasks=8)
    each = [r.n for r in tiles.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sum(each) == tiles.count() > 30_000 and max(each) < 2 * sum(each) / 8


def test_normalise_turns_and_pads(spark):
    bgr = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    tile = spark.createDataFrame([(1, 2, 2, 3, 1, bytearray(bgr.tobytes())), (2, 2, 2, 3, 1, None)], "id int, got_h long, got_w long, th long, tw long, px binary")
    found = {r.id: r.px for r in pixels.normalise(tile).collect()}
    assert np.frombuffer(found[1], np.uint8).reshape(3, 1, 3).tolist() == [[[2, 1, 0]], [[8, 7, 6]], [[255, 255, 255]]]
    assert found[2] is None


def test_dispatch(spark):
    names = ["/d/a.CZI", "/d/b.ome.zarr", "/d/c.ome.tiff", "/d/.czi", "/d/none", "/d/x.txt"]
    found = formats.classify(formats.dispatch(spark.createDataFrame([(n,) for n in names], "path string"))).collect()
    assert [r.suffix for r in found] == [".czi", ".zarr", ".tiff", ".czi", "", ".txt"]
    assert found[2].error == "no reader for '.tiff': c.ome.tiff. Known formats: .czi, .zarr"
    assert [r.vendor for r in found] == ["Zeiss", None, "TIFF", None, None, None]


def test_missing_scene_lists_the_others(spark):
    there = spark.createDataFrame([("/a.czi", 0, 2, 0, 0, 5, 5), ("/a.czi", 1, 2, 0, 0, 5, 5)], "path string, scene int, n_scenes long, x0 long, y0 long, width long, height long")
    wanted = spark.createDataFrame([("/a.czi", 1), ("/a.czi", -1), ("/b.czi", 0)], "path string, scene int")
    found = {(r.path, r.scene): r.error for r in geometry.open_slides(wanted, there).collect()}
    assert found == {("/a.czi", 1): None, ("/a.czi", -1): "a.czi has no scene -1, only [0, 1]", ("/b.czi", 0): "no geometry: b.czi"}
    assert geometry.broken_references(wanted, there).count() == 2


def test_facet_filter_takes_facets_only():
    with pytest.raises(ValueError, match="no facet"):
        browse.facet_filter({"file": "x"})


def test_filters_reach_the_files(spark, tmp_path):
    spark.range(10).select(F.lit("mouse").alias("species"), F.lit("he").alias("stain"), F.col("id").alias("dose_mg_per_kg"), F.lit("/d").alias("directory")).write.parquet(str(tmp_path / "t"))
    shown = browse.in_directory(spark.read.parquet(str(tmp_path / "t")), "/d").where(browse.facet_filter({"dose_mg_per_kg": "3"}))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(dose_mg_per_kg,3)" in plan and "EqualTo(directory,/d)" in plan


def test_bad_stores_give_error_rows(spark, tmp_path):
    meta = {"multiscales": [{"axes": [{"name": a} for a in "yx"], "datasets": [{"path": "0"}, {"path": 7}, {}]}]}
    array = {"shape": [4, 4], "chunks": [4, 4], "dtype": "|u1", "order": "C", "dimension_separator": "/", "fill_value": 3}
    stores = {
        "list": {"OME/.zattrs": b"[1]"}, "number": {"OME/.zattrs": b'{"series": 5}'}, "latin": {"OME/.zattrs": b"\xff\xfe"}, "empty": {"OME/.zattrs": b""}, "absent": {},
        "no-array": {"OME/.zattrs": b'{"series": ["s"]}', "s/.zattrs": json.dumps(meta).encode()},
        "odd-array": {"OME/.zattrs": b'{"series": ["s"]}', "s/.zattrs": json.dumps(meta).encode(), "s/0/.zarray": json.dumps(array | {"shape": [4]}).encode()},
        "zero-chunk": {"OME/.zattrs": b'{"series": ["s"]}', "s/.zattrs": json.dumps(meta).encode(), "s/0/.zarray": json.dumps(array | {"chunks": [0, 4]}).encode()},
        "good": {"OME/.zattrs": b'{"series": ["s", 3]}', "s/.zattrs": json.dumps(meta).encode(), "s/0/.zarray": json.dumps(array).encode()},
    }
    for store, files in stores.items():
        for name, body in files.items():
            path = tmp_path / store / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(body)
    texts = zarr.metadata_texts(spark.createDataFrame([(f"{tmp_path}/{s}",) for s in stores], "store string"))
    levels = geometry.zarr_levels(texts).where("dataset = '0'")
    found = {r.store.rpartition("/")[2]: r for r in zarr.tiles(levels).collect()}
    assert set(found) == {"no-array", "odd-array", "zero-chunk", "good"}
    assert found["good"].px == bytes([3] * 16) and found["good"].error is None
    assert all("no array metadata" in found[s].error and found[s].px is None for s in ("no-array", "odd-array", "zero-chunk"))


def test_reports_round_as_printf(spark):
    from slidelake.operators import probe
    from slidelake.plans import fixtures as fx

    values = [0.125, 0.375, 0.135, 2.5, 3.5, 1500004.5, 1e-9, 0.0, 99.995, 123456789.125, 0.045, 1.005]
    numbers = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 1, 2, 4):
        assert [r[0] for r in numbers.select(probe._fixed(F.col("x"), digits)).collect()] == [f"{x:.{digits}f}" for x in values]
    files = spark.createDataFrame([("/a.czi", 1_500_004_500_000), ("/b.tif", 2_500_000), ("/c.tif", 3_500_000)], "path string, length long")
    empty = lambda frame: frame(spark, "/root/testdata/sf0.001").limit(0)
    czi = probe.czi_report(files, empty(fx.headers), empty(fx.rects)).select("path", "on_disk")
    tiff = probe.tiff_report(files, empty(fx.headers), empty(fx.tiff_series)).select("path", "on_disk")
    assert {tuple(r) for r in czi.union(tiff).collect()} == {("/a.czi", "1500004 MB"), ("/b.tif", "2 MB"), ("/c.tif", "4 MB")}


def test_a_czi_report_joins_headers_and_rectangles_once_and_loses_no_file(spark):
    from slidelake.operators import probe
    from slidelake.plans import fixtures as fx

    heads, rects = fx.headers(spark, "/root/testdata/sf0.001"), fx.rects(spark, "/root/testdata/sf0.001")
    paths = sorted(r.path for r in heads.where("error is null and path like '%.czi'").select("path").collect())[:3]
    files = spark.createDataFrame([(p, 5) for p in paths], "path string, length long")
    report = probe.czi_report(files, heads.where(F.col("path") != paths[0]), rects.where(F.col("path") != paths[1]))
    found = report.select("path", "n_scenes", "size_line", "scene_lines", "error").orderBy("path").collect()
    assert [tuple(r)[1:] for r in found[:2]] == [(None, None, None, "FAILED: RuntimeError: no header")] * 2
    assert [r.path for r in found] == paths and found[2].error is None and found[2].n_scenes == len(found[2].scene_lines.split("\n"))
    assert probe.czi_report(files, heads, rects)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
