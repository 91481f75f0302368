"""Sidecars: from files to one record per scene."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.functions.contract import COLUMNS, SIDECARS, WHOLE
from slidelake.sources import storage


#: Rows of a listing.
ENTRIES = "path string, length long, is_folder boolean"


def list_folders(folders: DataFrame, n: int | None = None) -> DataFrame:
    """(path, length, is_folder) of what folders (column path) hold: sidecars, and folders but for image stores and links.

    The folders are dealt out to all tasks, or to as many as n folders are worth; a folder's entries
    are handed on some thousands at a time, however wide it is.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        for rows in batches:
            found = []
            for folder in rows["path"]:
                system, base = storage.opened(folder)
                for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                    is_folder = x.type == fs.FileType.Directory
                    if is_folder and not x.base_name.endswith(".zarr") and not os.path.islink(x.path) or x.is_file and x.base_name.endswith(".json"):
                        found.append((f"{folder}/{x.base_name}", x.size or 0, is_folder))
                    if len(found) >= 5_000:
                        yield pd.DataFrame(found, columns=names)
                        found = []
            yield pd.DataFrame(found, columns=names)

    return storage.dealt(folders, most=n and storage.pieces(folders.sparkSession, n, 16)).mapInPandas(entries, ENTRIES)


def list_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(directory, sidecar_path, length) of every *.json file below a folder; also hidden ones, but none within image stores.

    root is a path or a URI. The folders of one depth are listed in all tasks, and what they
    find is stored; its folders are the next depth's. So no folder is listed twice, and the
    tables of the depths are deleted when the files' table is written.
    """
    root = root.rstrip("/") if "://" in root else os.path.abspath(root)
    folder, depths = storage.run_folder(spark, "listing"), []
    frontier, n = spark.createDataFrame([(root,)], "path string"), 1
    while n:
        depths.append(storage.stored(list_folders(frontier, n), f"{folder}/depth-{len(depths)}"))
        frontier = depths[-1].where("is_folder").select("path")
        n = frontier.count()
    files = [d.where("not is_folder").select(F.lit(root).alias("directory"), F.col("path").alias("sidecar_path"), "length") for d in depths]
    found = storage.stored(reduce(DataFrame.union, files), f"{folder}/files")
    for i in range(len(depths)):
        storage.removed(spark, f"{folder}/depth-{i}")
    return found


def scan_paths(paths: DataFrame, batch: int = 500, size: int = 32 << 20) -> DataFrame:
    """Reads the files of a (directory, sidecar_path) table on the executors.

    Spark's own readers skip names that begin with '.' or '_', so files are opened by path.
    About `batch` files make a task, or `size` bytes where the table has their length; with two
    tasks a core, up to 8 batches do. A file that can't be read or isn't UTF-8 has a null text.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 100):
                some, texts = rows.iloc[at : at + 100], []
                for path in some["sidecar_path"]:
                    try:
                        texts.append(storage.read(path).decode())
                    except (OSError, UnicodeDecodeError):
                        texts.append(None)
                yield some.assign(text=texts)

    length = F.col("length") if "length" in paths.columns else F.lit(0)
    n, total = paths.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    return paths.select("directory", "sidecar_path").repartition(max(storage.pieces(paths.sparkSession, -(-n // batch), 8), -(-total // size))).mapInPandas(read, SIDECARS)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The sidecars below a folder that the executors can open by path or URI."""
    return scan_paths(list_sidecars(spark, root))


def path_order(path: str = "sidecar_path") -> F.Column:
    """Sort key that compares paths part by part, so a/b sorts before a-b."""
    return F.split(path, "/")


def _read_value(value: str) -> str:
    """SQL that reads a variant: its kind, and its text. Everything else follows from these two."""
    return f"named_struct('kind', coalesce(schema_of_variant({value}), 'VOID'), 'text', try_variant_get({value}, '$', 'string'))"


def _plain() -> F.Column:
    """Whether a typed reader reads a text as variants do: by the kinds of its values (column kinds), the contract's
    are strings and whole numbers, and scenes a list of objects.

    kinds is null for texts with a null, which a list's kind doesn't show, or with a repeated key.
    """
    wholes = [f"{c}: BIGINT" for c in WHOLE]
    others = reduce(lambda kinds, known: F.replace(kinds, F.lit(known)), [*wholes, "scenes: ARRAY<OBJECT<", ": STRING"], F.col("kinds"))
    wrong = reduce(or_, [F.contains("kinds", F.lit(f"{c}: STRING")) for c in (*WHOLE, "scenes")])
    return F.startswith("kinds", F.lit("OBJECT<")) & ~wrong & ~F.contains(others, F.lit(":"))


#: What a typed reader takes of a plain text.
_TYPES = {c: "bigint" if c in WHOLE else "string" for c in COLUMNS}
_ENTRY = f"struct<{', '.join(f'{c}: {t}' for c, t in _TYPES.items())}>"
_FIELDS = f"struct<{', '.join(f'{c}: struct<kind: string, text: string>' for c in COLUMNS)}>"
_PLAIN = f"struct<{', '.join(f'{c}: {t}' for c, t in _TYPES.items() if c not in ('directory', 'scene'))}, scenes: array<{_ENTRY}>>"


def records(sidecars: DataFrame) -> DataFrame:
    """One row per scene: directory, sidecar_path, pos, reject, typed, and fields (kind and text of each column's value).

    An absent or empty scenes list gives one scene 0. An entry overrides the slide's fields
    key by key, explicit nulls included; what neither names keeps the entry's position as its
    scene. A sidecar that can't be taken apart gives one row with a reason in reject instead.
    What no one names has a null kind.

    Texts whose values are all of the contract's kinds are read by their types; typed then
    holds the values, and fields follow from it. Others are read as variants, and typed is null.
    """
    read = sidecars.withColumn("kinds", F.expr("if(contains(text, 'null'), null, schema_of_variant(try_parse_json(text)))"))
    read = read.withColumn("slide", F.when(_plain(), F.from_json("text", _PLAIN))).drop("kinds")
    bare = F.col("slide.file").isNotNull() & ~F.col("slide.file").isin("", ".") & ~F.col("slide.file").contains("/")
    folder = F.regexp_replace(F.expr("substring(sidecar_path, length(directory) + 2)"), "[^/]*$", "")
    read = read.withColumn("slide", F.when(bare, F.col("slide"))).withColumn("folder", folder)
    # what an entry lacks is the slide's; merged before the explode, so that a row carries its own values only
    own = {"file": "concat(folder, slide.file)", "directory": "directory", "scene": "cast(pos AS bigint)"}
    merged = ", ".join(f"'{c}', coalesce(entry.{c}, {own.get(c, f'slide.{c}')})" for c in COLUMNS)
    nothing = f"cast(named_struct({', '.join(f"'{c}', null" for c in COLUMNS)}) AS {_ENTRY})"
    plain = f"transform(if(size(slide.scenes) > 0, slide.scenes, array({nothing})), (entry, pos) -> named_struct('typed', named_struct({merged}), 'reject', cast(null AS string), 'fields', cast(null AS {_FIELDS})))"
    # as a column of its own the list would have a filter on its size inferred, into which Spark writes all that is behind it
    scenes = F.expr(f"if(slide IS NOT NULL, {plain}, others)")
    rows = _with_variants(read).select("directory", "sidecar_path", F.posexplode(scenes).alias("pos", "scene"))
    value = lambda c: F.struct(F.lit("BIGINT" if c in WHOLE else "STRING").alias("kind"), F.col(f"scene.typed.{c}").cast("string").alias("text"))
    fields = F.struct(*[F.when(F.col(f"scene.typed.{c}").isNotNull(), value(c)).alias(c) for c in COLUMNS])
    fields = F.when(F.col("scene.typed").isNotNull(), fields).otherwise(F.col("scene.fields"))
    return rows.select("directory", "sidecar_path", F.col("pos").cast("long").alias("pos"), "scene.reject", "scene.typed", fields.alias("fields"))


def _with_variants(read: DataFrame) -> DataFrame:
    """Adds others: (typed, reject, fields) of each scene of the texts that are not plain (slide is null), from variants."""
    parsed = read.withColumn("m", F.when(F.col("slide").isNull(), F.from_json("text", "map<string,variant>")))
    # of a key that occurs twice the last value counts
    last = "filter(map_entries(m), (e, i) -> i = size(m) - array_position(reverse(map_keys(m)), e.key))"
    repeated = "size(array_distinct(map_keys(m))) < size(m)"
    parsed = parsed.withColumn("m", F.expr(f"if({repeated}, map_from_entries({last}), m)"))
    # of an entry's keys the contract's are taken; one that it lacks is null, an explicit null is a variant
    entry = f"struct<{', '.join(f'{c}: variant' for c in COLUMNS)}>"
    name = F.expr("if(schema_of_variant(m['file']) = 'STRING', variant_get(m['file'], '$', 'string'), null)")
    parsed = parsed.withColumn("name", name).withColumn("entries", F.expr(f"try_cast(m['scenes'] AS array<{entry}>)"))
    # a text is made of scenes only where they are no list of objects
    falsy = F.expr("to_json(m['scenes'])").isin("null", "[]", "{}", '""', "0", "0.0", "false")
    none = F.coalesce(F.when(F.col("entries").isNotNull(), F.size("entries") == 0).otherwise(falsy), F.lit(True))
    reject = (
        F.when(F.col("m").isNull(), "not a JSON object")
        .when(~F.map_contains_key("m", F.lit("file")), "no file")
        .when(F.col("name").isNull() | F.col("name").isin("", ".") | F.col("name").contains("/"), "file is not a bare name")
        .when(~F.col("none") & (F.col("entries").isNull() | F.exists("entries", lambda e: e.isNull())), "scenes is not a list of objects")
    )
    parsed = parsed.withColumn("none", none).withColumn("reject", reject)
    # the slide's own fields, read once for all of its scenes; an explicit null is a variant, too
    of_slide = [c for c in COLUMNS if c not in ("file", "directory", "scene")]
    listed = ", ".join(f"m['{c}']" for c in of_slide)
    parsed = parsed.withColumn("shared", F.expr(f"transform(array({listed}), v -> if(v IS NOT NULL, {_read_value('v')}, null))"))
    text = lambda value: F.struct(F.lit("STRING").alias("kind"), value.alias("text"))
    parsed = parsed.withColumn("own_file", text(F.concat("folder", "name"))).withColumn("own_directory", text(F.col("directory")))
    own = {"file": "own_file", "directory": "own_directory", "scene": "named_struct('kind', 'BIGINT', 'text', cast(pos AS string))"} | {c: f"shared[{i}]" for i, c in enumerate(of_slide)}
    # an entry is read only where it overrides; all before the explode, whose rows then carry the
    # result: no later filter or projection reads a variant again
    merged = ", ".join(f"'{c}', if(entry.{c} IS NOT NULL, {_read_value(f"entry.{c}")}, {own[c]})" for c in COLUMNS)
    nothing = f"cast(named_struct({', '.join(f"'{c}', null" for c in COLUMNS)}) AS {entry})"
    scenes = F.expr(f"""if(slide IS NOT NULL, null, if(reject IS NOT NULL, array(named_struct('typed', cast(null AS {_ENTRY}), 'reject', reject, 'fields', null)),
        transform(if(none, array({nothing}), entries), (entry, pos) -> named_struct('typed', cast(null AS {_ENTRY}), 'reject', cast(null AS string), 'fields', named_struct({merged})))))""")
    return parsed.withColumn("others", scenes).select(*read.columns, "others")


def whole_number(field: F.Column) -> F.Column:
    """A field (kind and text) as a 64-bit integer by the contract's coercions; null if it isn't one.

    Whole numbers, booleans and numeric strings (blanks around, a sign, single underscores
    between digits, a fraction of zeros) count.
    """
    kind, text = field["kind"], field["text"]
    trimmed, number = F.btrim(text, F.lit(" \t\n\r")), text.try_cast("double")
    digits = F.regexp_replace(F.regexp_replace(trimmed, "[.]0+$", ""), "_", "")
    return (
        F.when(kind == "BIGINT", text.try_cast("bigint"))
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
        .when((kind == "STRING") & trimmed.rlike("^[+-]?[0-9]+(_[0-9]+)*([.]0+)?$"), digits.try_cast("bigint"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.when((number == F.floor(number)) & (F.abs(number) < 9.2e18), number.try_cast("bigint")))
    )


def project(scenes: DataFrame, *further: str | F.Column) -> DataFrame:
    """The contract's columns of records, sidecar_path, pos and further ones; absent ones are null, further keys are dropped."""
    # where there are no typed values; apart from these, and not in one method with them, which the JVM would not compile
    text = lambda field: F.when(field["kind"] == "STRING", field["text"])
    read = F.transform(F.array("fields"), lambda f: F.struct(*[(whole_number(f[c]) if c in WHOLE else text(f[c])).alias(c) for c in COLUMNS]))
    kept = scenes.withColumn("read", F.when(F.col("typed").isNotNull(), F.col("typed")).otherwise(F.get(read, F.lit(0))))
    return kept.select("read.*", "sidecar_path", "pos", *further)
