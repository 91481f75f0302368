import json

import pytest
from pyspark.sql import functions as F

from slidelake.functions.contract import COLUMNS, SIDECARS
from slidelake.operators import browse, catalog, validate
from slidelake.sources import sidecars

GOOD = {"file": "a.czi", "species": "mouse", "substance": "s", "dose_mg_per_kg": 5, "animal_id": "A1", "stain": "he", "modality": "brightfield", "serial_block": "B1"}


def rows(spark, *bodies):
    texts = [(("/d", f"/d/{i:02d}.json", b if isinstance(b, str | None) else json.dumps(b))) for i, b in enumerate(bodies)]
    return sidecars.records(spark.createDataFrame(texts, SIDECARS))


def problems(spark, **change):
    body = {k: v for k, v in (GOOD | change).items() if v is not ...}
    return [r.problems for r in validate.check(rows(spark, body)).collect()]


@pytest.mark.parametrize("scenes", [None, [], {}, "", 0, False])
def test_falsy_scenes_give_scene_0(spark, scenes):
    found = sidecars.project(rows(spark, GOOD | {"scenes": scenes, "scene": 9})).collect()
    assert [(r.scene, r.file, r.directory) for r in found] == [(0, "a.czi", "/d")]


def test_entries_override_key_by_key(spark):
    body = GOOD | {"scenes": [{}, {"scene": 7, "stain": "cyp2e1"}, {"file": "z/other.czi", "directory": "/e"}]}
    found = sidecars.project(rows(spark, body)).orderBy("pos").collect()
    assert [(r.scene, r.stain, r.file, r.directory) for r in found] == [(0, "he", "a.czi", "/d"), (7, "cyp2e1", "a.czi", "/d"), (2, "he", "z/other.czi", "/e")]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("300", 300), (" 300 ", 300), ("+300", 300), ("1_000", 1000), ("300.0", 300), (300.0, 300), (True, 1), (False, 0), (-4, -4), ("3e2", None), (300.5, None), ("", None), ("abc", None), (None, None), ([], None), (2**63, None), ("1__0", None)],
)
def test_integers(spark, value, expected):
    checked = validate.check(rows(spark, GOOD | {"dose_mg_per_kg": value}))
    assert [r.dose_mg_per_kg for r in sidecars.project(checked).collect()] == [expected]
    assert (checked.first().problems is None) == (expected is not None)


def test_problem_messages(spark):
    assert problems(spark) == [None]
    assert problems(spark, species=...) == ["species: Field required"]
    assert problems(spark, stain="HE", animal_id=7) == ["animal_id: Input should be a valid string; stain: Input should be 'he' or 'cyp2e1'"]
    assert problems(spark, species="cat") == ["species: Input should be 'mouse', 'pig' or 'human'"]
    assert problems(spark, dose_mg_per_kg="3e2") == ["dose_mg_per_kg: Input should be a valid integer, unable to parse string as an integer"]
    assert problems(spark, scenes=[{"scene": None}]) == ["scene: Input should be a valid integer"]
    assert problems(spark, note="x", original_name=None) == [None]


def test_rejects(spark):
    bodies = [None, "{bad", "[1]", GOOD | {"file": "a/b.czi"}, GOOD | {"file": 1}, {"species": "pig"}, GOOD | {"scenes": {"a": 1}}, GOOD | {"scenes": [1]}, GOOD | {"scenes": "x"}]
    found = rows(spark, *bodies).orderBy("sidecar_path").select("reject").collect()
    assert [r.reject for r in found] == ["not a JSON object"] * 3 + ["file is not a bare name"] * 2 + ["no file"] + ["scenes is not a list of objects"] * 3


def test_last_of_a_repeated_key_counts(spark):
    text = json.dumps(GOOD)[:-1] + ', "stain": "cyp2e1"}'
    assert sidecars.project(rows(spark, text)).first().stain == "cyp2e1"


@pytest.fixture
def tree(tmp_path):
    def put(name, **change):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(GOOD | change))

    return tmp_path, put


def test_scan_build_and_rebuild(spark, tree, tmp_path_factory):
    root, put = tree
    for name in (".h.json", "_u.json", ".hid/c.json", "up.JSON", "s.zarr/zarr.json"):
        put(name, file=f"{name.replace('/', '_')}.czi")
    put("a/b.json", scenes=[{"file": "z.czi", "animal_id": "from a/b"}])
    put("a-b.json", scenes=[{"file": "z.czi", "animal_id": "from a-b"}])
    found = sidecars.scan(spark, str(root))
    assert {r.sidecar_path.removeprefix(f"{root}/") for r in found.collect()} == {".h.json", "_u.json", ".hid/c.json", "a/b.json", "a-b.json"}
    table = catalog.Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    counts = table.build(found, str(root))
    assert (counts["records_read"], counts["rows_written"]) == (5, 4)
    assert [r.animal_id for r in table.query("SELECT * FROM slides WHERE file = ?", ["z.czi"]).collect()] == ["from a-b"]
    first = sorted(table.read().collect())
    table.build(found, str(root))
    assert sorted(table.read().collect()) == first
    other = found.withColumn("sidecar_path", F.regexp_replace("sidecar_path", str(root), "/other")).withColumn("directory", F.lit("/other"))
    table.build(other, "/other")
    table.build(found.limit(0), str(root))
    assert {r.directory for r in table.read().collect()} == {"/other"}
    with pytest.raises(ValueError, match="only SELECT"):
        table.query("DROP TABLE slides")


def test_strict_build_writes_nothing(spark, tmp_path):
    table = catalog.Catalog(spark, str(tmp_path))
    bad = spark.createDataFrame([("/d", "/d/a.json", json.dumps(GOOD | {"stain": "HE"})), ("/d", "/d/b.json", json.dumps(GOOD))], SIDECARS)
    with pytest.raises(ValueError, match="a.czi: stain: "):
        table.build(bad, "/d")
    assert table.read().columns == COLUMNS and table.read().count() == 0
    assert table.build(bad, "/d", strict=False)["rejected"] == 1
    assert table.read().count() == 1


def test_stale_table_is_dropped(spark):
    stale = spark.createDataFrame([(1,)], "file int")
    assert catalog.fresh(stale).columns == COLUMNS and catalog.fresh(stale).count() == 0


def test_queries_keep_to_select_and_to_their_view(spark, tmp_path):
    table = catalog.Catalog(spark, f"file://{tmp_path}")
    good = spark.createDataFrame([("/d", "/d/a.json", json.dumps(GOOD))], SIDECARS)
    for _ in range(4):
        table.build(good, "/d")
    assert len(list((tmp_path / "versions").glob("0*.json"))) == len(list((tmp_path / "rows").glob("*/part=*"))) == 2
    spark.range(3).createOrReplaceTempView("slides")
    for sql in ("-- a note\nSELECT file FROM slides", "/* a\nnote */ (SELECT file FROM slides)", " WITH s AS (SELECT * FROM slides) SELECT file FROM s", "FROM slides SELECT file"):
        assert [r.file for r in table.query(sql).collect()] == ["a.czi"]
    assert spark.table("slides").count() == 3
    spark.catalog.dropTempView("slides")
    assert table.query("SELECT 1").count() == 1 and not spark.catalog.tableExists("slides")


def test_only_queries_are_run(spark, tmp_path):
    spark.sql(f"CREATE TABLE tt (a INT) USING parquet LOCATION '{tmp_path}/tt'")
    slides = spark.createDataFrame([], catalog.SLIDES)
    bad = ["", "  ", "-- SELECT 1", "/* x */ DROP TABLE slides", "SELECTED", "SELECT 1; DROP TABLE tt", "WITH s AS (SELECT 1 a) INSERT INTO tt SELECT a FROM s", "FROM (SELECT 2 a) x INSERT INTO tt SELECT a", "CREATE TABLE u AS SELECT 1 a", "EXECUTE IMMEDIATE 'INSERT INTO tt SELECT 1'", "BEGIN INSERT INTO tt SELECT 1; END", "SET x = 1", "CACHE TABLE tt"]
    for sql in bad:
        with pytest.raises(ValueError, match="only SELECT"):
            catalog.query(slides, sql)
    assert spark.table("tt").count() == 0
    spark.sql("DROP TABLE tt")


def test_folders_of_a_depth_are_listed_by_several_tasks(spark, tree):
    root, put = tree
    for i in range(48):
        put(f"d{i}/e/s.json")
    folders = spark.createDataFrame([(f"{root}/d{i}",) for i in range(48)], "path string")
    assert sidecars.list_folders(folders).select(F.spark_partition_id()).distinct().count() == 4
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = sidecars.list_sidecars(spark, f"file://{root}")
    assert found.count() == 48 and {r.length for r in found.collect()} == {len(json.dumps(GOOD))}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert sidecars.scan_paths(found, size=100).rdd.getNumPartitions() > 48 and sidecars.scan(spark, f"{root}/none").count() == 0


def rows_of(spark, *keys, **change):
    """Rows of the slides table with these (directory, file)."""
    plain = {c: GOOD.get(c, "x") for c in COLUMNS} | {"scene": 0, "original_name": None} | change
    return spark.createDataFrame([tuple((plain | {"directory": d, "file": f})[c] for c in COLUMNS) for d, f in keys], catalog.SLIDES)


def held(table):
    return {(r.directory, r.file, r.animal_id) for r in table.read().collect()}


def test_a_build_writes_its_own_directories_only(spark, tmp_path):
    table = catalog.Catalog(spark, str(tmp_path))
    table.replace(rows_of(spark, *[(f"/d{i}", f"{k}.czi") for i in range(40) for k in range(5)]), "/d0")
    before = {p: p.stat().st_size for p in tmp_path.rglob("*.parquet")}
    version = table.replace(rows_of(spark, ("/d7", "new.czi")), "/d7")
    written = {p for p in tmp_path.rglob("*.parquet")} - set(before)
    assert len(written) <= 3 and sum(p.stat().st_size for p in written) < sum(before.values()) / 10
    assert {r.file for r in table.read(["/d7"]).collect()} == {"new.czi"} and table.read().count() == 39 * 5 + 1
    assert len(version.directories) == 40
    assert "d7" not in str(table.read(["/d1"]).inputFiles()) and len(table.read(["/d1"]).inputFiles()) == 1


def test_entries_of_other_directories_are_merged(spark, tmp_path):
    table = catalog.Catalog(spark, str(tmp_path))
    table.replace(rows_of(spark, ("/b", "1.czi"), ("/b", "2.czi")), "/b")
    table.replace(rows_of(spark, ("/a", "1.czi"), ("/b", "2.czi"), animal_id="new"), "/a")
    assert held(table) == {("/a", "1.czi", "new"), ("/b", "1.czi", "A1"), ("/b", "2.czi", "new")}
    table.replace(rows_of(spark), "/b")
    assert held(table) == {("/a", "1.czi", "new")}


@pytest.mark.parametrize(("root", "expected"), [
    ("/b", {("/a", "1.czi", "first"), ("/c", "1.czi", "first"), ("/b", "1.czi", "second")}),  # different roots both survive
    ("/a", {("/a", "1.czi", "first"), ("/c", "1.czi", "first")}),  # of one root, as if one after the other
    ("/c", {("/a", "1.czi", "first"), ("/c", "1.czi", "first"), ("/c", "2.czi", "second")}),  # rows that it merges with are merged again
])
def test_interleaved_builds(spark, tmp_path, monkeypatch, root, expected):
    first, second = (catalog.Catalog(spark, str(tmp_path)) for _ in range(2))
    first.replace(rows_of(spark, ("/c", "1.czi"), animal_id="old"), "/c")
    create, done = catalog.Catalog._create, []

    def late(self, version):
        if self is first and not done:
            done.append(1)
            second.replace(rows_of(spark, (root, "2.czi" if root == "/c" else "1.czi"), animal_id="second"), root)
        return create(self, version)

    monkeypatch.setattr(catalog.Catalog, "_create", late)
    first.replace(rows_of(spark, ("/a", "1.czi"), ("/c", "1.czi"), animal_id="first"), "/a")
    assert done and held(first) == held(second) == expected
    assert first.version().number == 3


def test_builds_at_once_all_survive(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    roots = [f"/r{i}" for i in range(6)]
    new = {root: rows_of(spark, (root, "1.czi"), animal_id=root) for root in roots}
    with ThreadPoolExecutor(3) as pool:
        versions = [v.number for v in pool.map(lambda root: catalog.Catalog(spark, str(tmp_path)).replace(new[root], root), roots)]
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert held(catalog.Catalog(spark, str(tmp_path))) == {(root, "1.czi", root) for root in roots}


def test_a_number_is_taken_once(spark, tmp_path):
    table = catalog.Catalog(spark, str(tmp_path), attempts=2)
    assert table._create(catalog.Version(1)) and not table._create(catalog.Version(1))
    table._create = lambda version: False
    with pytest.raises(catalog.Conflict, match="/a"):
        table.replace(rows_of(spark, ("/a", "1.czi")), "/a")


def test_stale_versions_are_dropped_whole(spark, tmp_path):
    table = catalog.Catalog(spark, str(tmp_path))
    table.replace(rows_of(spark, ("/a", "1.czi")), "/a")
    version = table.version()
    table._create(catalog.Version(2, COLUMNS[::-1], version.directories))
    assert table.read().count() == 0 and table.read().columns == COLUMNS
    table.replace(rows_of(spark, ("/b", "1.czi")), "/b")
    assert held(table) == {("/b", "1.czi", "A1")}


def test_partial_counts_equal_the_scan(spark, tmp_path):
    table = catalog.Catalog(spark, str(tmp_path))
    for i, root in enumerate(("/a", "/b")):
        rows = rows_of(spark, *[(root, f"{k}.czi") for k in range(7)])
        more = rows.withColumn("scene", F.lit(1).cast("long")).withColumn("stain", F.lit("cyp2e1")).where(f"file > '{i + 2}'")
        table.replace(rows.union(more).withColumn("dose_mg_per_kg", F.expr("cast(substring(file, 1, 1) as long) * 50")), root)
    stored = table.read()
    assert table.summary().collect() == browse.summary(stored).collect()
    for root in (None, "/a"):
        assert table.facets(root).collect() == browse.facets(stored, root).collect()
        assert table.shown_of_total(root, {"stain": "he"}).collect() == browse.shown_of_total(stored, root, {"stain": "he"}).collect()
    assert tuple(table.counts().first()) == (14, stored.count()) and tuple(table.counts(["/none"]).first()) == (0, 0)
    assert not any("/rows/" in f for f in table.summary().inputFiles() + table.facets("/a").inputFiles())


def test_variants_are_read_before_the_explode_only(spark):
    checked = validate.check(rows(spark, GOOD))
    valid, rejected = validate.gate(checked)
    plan = catalog.last_wins(sidecars.project(valid))._jdf.queryExecution().optimizedPlan().toString()
    after, _, before = plan.partition("Generate posexplode")
    assert "variant" not in after and "Field required" not in after and before


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from slidelake.sources import storage

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(SimpleNamespace(sparkContext=context))


def test_the_gate_is_compiled_apart(spark):
    valid, _ = validate.gate(validate.check(rows(spark, GOOD)))
    plan = valid._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "forall" in line]
    assert filters and not any("*(" in line for line in filters)


def test_sidecars_are_parsed_once_where_the_table_is_read_again(spark):
    from slidelake.plans import catalog_queries

    plan = catalog_queries.replace_directory(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "Relation" in plan


def test_files_are_there_a_round_at_a_time(spark):
    from pathlib import Path

    from slidelake.plans import store_queries
    from slidelake.sources import formats

    seen = []

    def read(folder):
        seen.append({p.name for p in Path(folder).iterdir()})
        return formats.inventory(spark, folder).select(formats.base_name().alias("name"), "length")

    files = spark.range(90).selectExpr("concat('s', id, '.czi') name", "cast(repeat('x', cast(id % 4 as int)) as binary) body")
    found = store_queries._by_rounds(files, "rounds", read, most=8, least=30)
    assert {tuple(r) for r in found.collect()} == {(f"s{i}.czi", i % 4) for i in range(90)} and found.count() == 90
    assert len(seen) == 3 and sum(map(len, seen)) == 90 and max(map(len, seen)) < 60
    assert not list(Path(storage_root(spark)).glob("rounds-*/files-*"))


def test_many_files_are_spread_over_folders_with_one_writer_each(spark, monkeypatch):
    from pathlib import Path

    from slidelake.plans import store_queries

    monkeypatch.setattr(store_queries, "WIDTH", 10)
    seen, written = [], []

    def read(folder):
        seen.append((folder, {p.name: {x.name for x in p.iterdir()} for p in Path(folder).iterdir()}))
        return sidecars.scan(spark, folder).select("sidecar_path", F.col("text").alias("name"))

    kind = type(spark.range(0))
    spread = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda rows, *a: (written.append(rows), spread(rows, *a))[1])
    files = spark.range(120).selectExpr("concat('s', id, '.json') name", "cast(concat('s', id, '.json') as binary) body")
    found = store_queries._by_rounds(files, "spread", read, most=8, least=60).collect()
    assert sorted(r.name for r in found) == sorted(f"s{i}.json" for i in range(120)) and all(r.sidecar_path.endswith(f"/{r.name}") for r in found)
    assert len(seen) == 2 and len({folder for folder, _ in seen}) == 1
    assert all(1 < len(held) <= 6 and set(held) <= {f"00{i}" for i in range(6)} for _, held in seen)
    writers = next(w for w in written if w.columns == ["name", "body"]).select(F.substring_index("name", "/", 1).alias("at"), F.spark_partition_id().alias("task"))
    assert {r["count"] for r in writers.distinct().groupBy("at").count().collect()} == {1}
    assert not list(Path(storage_root(spark)).glob("spread-*/files*"))


def test_small_folders_and_files_share_tasks(spark, tree):
    root, put = tree
    for i in range(60):
        put(f"f{i}/a.json")
    folders = spark.createDataFrame([(f"{root}/f{i}",) for i in range(60)], "path string")
    assert sidecars.list_folders(folders, 2).rdd.getNumPartitions() == 2 and sidecars.list_folders(folders, 2).count() == 60
    found = sidecars.list_sidecars(spark, str(root))
    read = sidecars.scan_paths(found, batch=1)
    assert read.rdd.getNumPartitions() == 8 and read.where("text is not null").count() == 60


def storage_root(spark):
    from slidelake.sources import storage

    return storage.shared_root(spark)


def test_a_table_of_slides_is_shuffled_once_and_its_list_is_sorted_without_labels(spark):
    table = catalog.last_wins(sidecars.project(rows(spark, GOOD)))
    listed = browse.browse(table, ordered=False)
    assert listed.count() == 1 and listed._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(") == 1
    plan = browse.browse(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("format_string") < plan.index("Sort [") and "format_string" not in plan[plan.index("Sort [") :]


def test_lines_of_sidecars_are_in_order_and_no_list_is_sorted(spark):
    from slidelake.plans import fixtures

    made = fixtures.sidecars(spark, "/root/testdata/sf0.001")
    assert "sort_array" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == fixtures.table(spark, "/root/testdata/sf0.001", "orders").count()


def test_a_build_counts_what_it_read_rejected_and_wrote(spark, tmp_path):
    entry = '{"file": "a.czi", "species": "pig", "substance": "s", "dose_mg_per_kg": 1, "animal_id": "A", "stain": "he", "modality": "brightfield", "serial_block": "B", "scenes": [{"scene": 1}, {"scene": 1}, {"scene": 2}, {"scene": "x"}]}'
    texts = spark.createDataFrame([("/d", "/d/1.json", entry), ("/d", "/d/2.json", "{bad")], SIDECARS)
    found = catalog.Catalog(spark, str(tmp_path)).build(texts, "/d", strict=False)
    assert found == {"records_read": 3, "rows_written": 2, "slides": 1, "note": " (3 scenes)", "rejected": 2}
    with pytest.raises(ValueError, match="a.czi: scene: "):
        catalog.Catalog(spark, str(tmp_path)).build(texts, "/d")


def test_plain_texts_are_read_by_their_types_and_as_variants_alike(spark):
    entries = [{}, {"scene": 7, "stain": "cyp2e1"}, {"file": "z/other.czi", "directory": "/e", "original_name": "o"}]
    plain = [GOOD, GOOD | {"scenes": entries, "note": 'a ": STRING b'}, GOOD | {"species": "cat"}, {"file": "a.czi"}, GOOD | {"scene": 3, "scenes": [{}, {}]}]
    odd = [GOOD | {"dose_mg_per_kg": "5"}, GOOD | {"animal_id": 7}, GOOD | {"scenes": [{"scene": "1"}]}, GOOD | {"scenes": [{"stain": 1}, {}]}, GOOD | {"scenes": [{"stain": None}, {"stain": "he"}]}, GOOD | {"scenes": "x"}]
    odd += [GOOD | {"scene: BIGINT": 1.5}, GOOD | {"file": "a/b.czi"}, json.dumps(GOOD)[:-1] + ', "scenes": [{"stain": "he", "stain": "he"}]}', json.dumps(GOOD)[:-1] + ', "stain": "cyp2e1"}']
    found = rows(spark, *plain, *odd)
    assert {r[0] for r in found.where("typed is not null").select("sidecar_path").collect()} == {f"/d/{i:02d}.json" for i in range(len(plain))}
    read = lambda *bodies: [tuple(r) for r in validate.check(rows(spark, *bodies)).transform(sidecars.project, "valid", "problems", "fields").orderBy("sidecar_path", "pos").collect()]
    assert read(*plain) == read(*[b | {"further": None} for b in plain])  # with a null in it a text is read as variants
    problems = [r.problems for r in validate.check(found).where(f"sidecar_path >= '/d/{len(plain):02d}'").orderBy("sidecar_path", "pos").collect()]
    assert problems[:2] == [None, "animal_id: Input should be a valid string"] and problems[3].startswith("stain: ") and problems[5].startswith("stain: ")
