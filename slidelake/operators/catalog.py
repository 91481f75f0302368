"""The slides table: last record wins, replacement by directory, versions of a stored table, SQL."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidelake.functions.contract import COLUMNS, KEY, SLIDES
from slidelake.operators import browse
from slidelake.operators.validate import check, file_of, gate, require_valid
from slidelake.sources.sidecars import path_order, project, records
from slidelake.sources.storage import removed, stored


def last_wins(projected: DataFrame) -> DataFrame:
    """Of records with one key the last in path order, then by position.

    Records are dealt out by slide, so windows over a table's slides need no further shuffle; the
    parts of the paths are made after it.
    """
    turn = Window.partitionBy(*KEY).orderBy(path_order().desc(), F.col("sidecar_path").desc(), F.col("pos").desc())
    return projected.repartition("directory", "file").withColumn("turn", F.row_number().over(turn)).where("turn = 1").select(*COLUMNS)


def slides_of(sidecars: DataFrame) -> DataFrame:
    """The slides table of sidecar rows, leaving rejected records out."""
    valid, _ = gate(check(records(sidecars)))
    return last_wins(project(valid))


def replace_directory(existing: DataFrame, new: DataFrame, root: str) -> DataFrame:
    """The table after deleting a root's rows and inserting new ones, which replace equal keys.

    An empty `new` empties the root.
    """
    kept = existing.where(F.col("directory") != root).join(new.select(*KEY), KEY, "left_anti")
    return kept.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def fresh(existing: DataFrame) -> DataFrame:
    """The stored table, or an empty one if its columns' names or order aren't the contract's."""
    if existing.columns == COLUMNS:
        return existing
    return existing.sparkSession.createDataFrame([], SLIDES)


def build_counts(projected: DataFrame) -> DataFrame:
    """One row: records_read, rows_written, slides and note, which tells scenes where they differ."""
    keys = projected.groupBy(*KEY).agg(F.count("*").alias("n"))
    return _counted(keys, F.coalesce(F.sum("n"), F.lit(0)))


def _counted(keys: DataFrame, records_read: Column) -> DataFrame:
    """The counts of a table with a row for each key."""
    found = keys.agg(records_read.alias("records_read"), F.count("*").alias("rows_written"), F.count_distinct(F.concat("directory", "file")).alias("slides"))
    return found.withColumn("note", F.when(F.col("records_read") != F.col("slides"), F.format_string(" (%d scenes)", "records_read")).otherwise(""))


@dataclass
class Version:
    """One state of a stored table: for each directory the folder of its rows, and that of their partial counts."""

    number: int = 0
    columns: list[str] = field(default_factory=lambda: list(COLUMNS))
    directories: dict[str, dict[str, str]] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Other builds kept changing what this one replaces."""


class Catalog:
    """A slides table kept as Parquet files by directory, with numbered versions that name them.

    A build writes the rows of the directories that it touches and carries all others over by
    name, so building one root of many costs that root. Its version is then created under the
    next number, which only one writer can do: another that comes later finds the number taken,
    looks at what has changed since it began, and takes a further number; where rows that it
    merged with have changed, it merges again. Readers see a version whole, and the one before
    stays for those that began earlier. The folder may be on any file system that Spark knows;
    creating a name only once is atomic on HDFS and on local disks.
    """

    #: Partial counts by directory: sums over directories are exact, as each slide is in one.
    PARTIAL = "directory string, species string, substance string, dose_mg_per_kg bigint, stain string, slides bigint, n_scenes bigint"

    def __init__(self, spark: SparkSession, folder: str, attempts: int = 20):
        self.spark, self.folder, self.attempts = spark, folder.rstrip("/"), attempts

    def _path(self, name: str):
        """A path in the folder and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, system = self._path("versions")
        if not system.exists(path):
            return []
        names = [x.getPath().getName() for x in system.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A stored version, by default the newest; an empty one before the first build."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return Version()
        path, system = self._path(f"versions/{number:09d}.json")
        stream = system.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _create(self, version: Version) -> bool:
        """Writes a version under its number; false if that number is taken."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        (new, system), (final, _) = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{version.number:09d}.json")
        out = system.create(new, False)
        out.write(json.dumps(vars(version)).encode())
        out.close()
        try:
            if system.getUri().getScheme() == "file":  # a link's name can be created once only
                files, name = jvm.java.nio.file.Files, lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                files.createLink(name(final), name(new))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
                none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(new, final, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            system.delete(new, False)

    def _rows(self, version: Version, kind: str, schema, directories: list[str] | None = None) -> DataFrame:
        chosen = version.directories if directories is None else [d for d in directories if d in version.directories]
        paths = [f"{self.folder}/{version.directories[d][kind]}" for d in chosen]
        if not paths or version.columns != COLUMNS:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, directories: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The table, or some directories of it, whose files alone are read; empty before the first build or if its schema is stale."""
        return self._rows(self.version(number), "rows", SLIDES, directories)

    def partials(self, directories: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The partial counts (PARTIAL) of the directories; a few rows each, whatever the number of slides."""
        return self._rows(self.version(number), "partials", self.PARTIAL, directories)

    def _write(self, rows: DataFrame) -> dict[str, dict[str, str]]:
        """Writes rows by directory, and their partial counts; gives the folders of each directory.

        Rows are clustered so that filters on dose and block skip row groups.
        """
        name, part = uuid.uuid4().hex, F.md5("directory")
        keyed = rows.select(*COLUMNS, part.alias("part"))
        keyed.sortWithinPartitions("part", "dose_mg_per_kg", "serial_block").write.partitionBy("part").parquet(f"{self.folder}/rows/{name}")
        written = self.spark.read.schema(SLIDES).parquet(f"{self.folder}/rows/{name}")
        groups = written.groupBy("directory", "species", "substance", "dose_mg_per_kg", "stain")
        counts = groups.agg(F.count_distinct("file").alias("slides"), F.count("*").alias("n_scenes"))
        # a slide may be in several groups: the directory's own number of slides is a row without them
        own = written.groupBy("directory").agg(F.count_distinct("file").alias("slides"), F.count("*").alias("n_scenes"))
        both = counts.unionByName(own, allowMissingColumns=True).withColumn("part", part)
        both.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/partials/{name}")
        there = self.spark.read.schema(f"{self.PARTIAL}, part string").parquet(f"{self.folder}/partials/{name}").select("directory", "part").distinct().collect()
        return {r.directory: {"rows": f"rows/{name}/part={r.part}", "partials": f"partials/{name}/part={r.part}"} for r in there}  # one per directory

    def replace(self, new: DataFrame, root: str) -> Version:
        """Commits the table after deleting a root's rows and inserting new ones, which replace equal keys.

        new: rows of the contract with distinct keys; an empty one empties the root. Rows of
        other directories, which an entry may name, are merged with what those hold.
        """
        return self._commit(self._write(new), root)  # computed once, whatever comes between

    def _commit(self, fresh: dict[str, dict[str, str]], root: str) -> Version:
        """Creates the version in which a root's rows are those that were written afresh."""
        others = [d for d in fresh if d != root]
        merged_with, merged = None, {}
        for _ in range(self.attempts):
            base = self.version()
            known = base.directories if base.columns == COLUMNS else {}  # a stale table is dropped whole
            there = {d: known[d] for d in others if d in known}
            if there != merged_with:
                merged_with, merged = there, self._merged(base, fresh, list(there))
            version = Version(base.number + 1, list(COLUMNS), {d: x for d, x in known.items() if d != root} | fresh | merged)
            if self._create(version):
                self._forget(version)
                return version
        raise Conflict(f"{root}: {self.attempts} versions came first")

    def _merged(self, base: Version, fresh: dict[str, dict[str, str]], directories: list[str]) -> dict[str, dict[str, str]]:
        """The folders of directories that keep their rows but for those of keys that come anew."""
        if not directories:
            return {}
        new = self._rows(Version(directories=fresh), "rows", SLIDES, directories)
        return self._write(self._rows(base, "rows", SLIDES, directories).join(new.select(*KEY), KEY, "left_anti").select(*COLUMNS).unionByName(new))

    def _forget(self, newest: Version, keep: int = 2) -> None:
        """Deletes versions but the last ones, and folders that only they name."""
        old = [n for n in self._numbers() if n <= newest.number - keep]
        named = lambda v: {p for x in v.directories.values() for p in x.values()}
        still = set().union(*(named(self.version(n)) for n in self._numbers() if n > newest.number - keep))
        for n in old:
            try:
                gone = named(self.version(n)) - still
            except Py4JJavaError:  # another writer has forgotten it
                continue
            for name in [*gone, f"versions/{n:09d}.json"]:
                path, system = self._path(name)
                system.delete(path, True)

    def build(self, sidecars: DataFrame, root: str, strict: bool = True) -> dict:
        """Replaces a root's rows by those of its sidecars; gives the build's counts.

        strict raises ValueError for the first bad record, before anything is written; else
        bad records are left out and counted.
        """
        path = f"{self.folder}/building/{uuid.uuid4().hex}"
        try:
            # the rows and what a message says are kept, not the fields behind them
            checked = check(records(sidecars))
            checked = stored(project(checked, "valid", "problems", file_of(checked).alias("shown")), path)
            if strict:
                require_valid(checked, F.col("shown"))
            read = checked.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("rejected")).first()
            fresh = self._write(last_wins(gate(checked)[0]))
            # what was written has each key once, so its columns tell the rest; another build may delete it later
            counts = _counted(self._rows(Version(directories=fresh), "rows", SLIDES), F.lit(read.valid)).first()
            self._commit(fresh, root)
            return counts.asDict() | {"rejected": read.rejected}
        finally:
            removed(self.spark, path)

    def summary(self, directories: list[str] | None = None) -> DataFrame:
        """browse.summary from the partial counts; reads no row of the table. Slides are counted by (directory, file)."""
        keys = ["species", "substance", "dose_mg_per_kg", "stain"]
        groups = self.partials(directories).where("species is not null").groupBy(*keys)
        return groups.agg(F.sum("slides").alias("n"), F.sum("n_scenes").alias("n_scenes")).orderBy(*keys)

    def facets(self, directory: str | None = None) -> DataFrame:
        """browse.facets from the partial counts."""
        return browse.facets(self._groups(directory))

    def shown_of_total(self, directory: str | None = None, chosen: dict[str, str] | None = None) -> DataFrame:
        """browse.shown_of_total from the partial counts: facets are among their columns."""
        return browse.shown_of_total(self._groups(directory), None, chosen, F.col("n_scenes"))

    def _groups(self, directory: str | None) -> DataFrame:
        return self.partials(None if directory is None else [directory]).where("species is not null")

    def counts(self, directories: list[str] | None = None) -> DataFrame:
        """One row: slides and n_scenes of the table, from the partial counts."""
        own = self.partials(directories).where("species is null")
        return own.agg(F.coalesce(F.sum("slides"), F.lit(0)).alias("slides"), F.coalesce(F.sum("n_scenes"), F.lit(0)).alias("n_scenes"))

    def query(self, sql: str, args: list | None = None) -> DataFrame:
        """A SELECT over view slides, with ? for each of args."""
        return query(self.read(), sql, args)


def require_select(spark: SparkSession, sql: str) -> None:
    """Raises ValueError unless a text parses to a query: one without any command or insert in its plan."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ValueError(f"only SELECT is supported: {e}") from e
    named = lambda name: spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")
    acts = [named(f"plans.logical.{x}") for x in ("Command", "ParsedStatement", "CompoundPlanStatement")]
    left = [plan]
    while left:
        node = left.pop()
        if any(a.isInstance(node) for a in acts) or "ExecuteImmediate" in node.getClass().getSimpleName():
            raise ValueError("only SELECT is supported")
        for below in (node.children(), node.innerChildren(), node.subqueries()):
            left += [x for x in (below.apply(i) for i in range(below.size())) if named("plans.logical.LogicalPlan").isInstance(x)]


def query(slides: DataFrame, sql: str, args: list | None = None) -> DataFrame:
    """A SELECT over view slides, with ? for each of args; lazy, and pushed down to the files.

    The text is parsed, and anything but a query is refused before it is run. A view of that
    name that the session already has is there again afterwards.
    """
    spark = slides.sparkSession
    require_select(spark, sql)
    before = next((spark.table("slides") for t in spark.catalog.listTables() if t.name == "slides" and t.isTemporary), None)
    slides.createOrReplaceTempView("slides")
    try:
        return spark.sql(sql, args=args or [])
    finally:
        if before is None:
            spark.catalog.dropTempView("slides")
        else:
            before.createOrReplaceTempView("slides")
