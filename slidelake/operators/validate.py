"""Validation of records against the contract."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.functions.contract import COLUMNS, ENUMS, OPTIONAL, WHOLE
from slidelake.sources.sidecars import path_order, whole_number


def _allowed(words: tuple[str, ...]) -> str:
    """'a', 'b' or 'c'."""
    quoted = [f"'{w}'" for w in words]
    return f"{', '.join(quoted[:-1])} or {quoted[-1]}"


def _wrong(name: str, field: F.Column) -> F.Column:
    """Whether a field that is there is wrong."""
    kind, text = field["kind"], field["text"]
    if name in WHOLE:
        return whole_number(field).isNull()
    if name in ENUMS:
        return ~((kind == "STRING") & F.coalesce(text.isin(*ENUMS[name]), F.lit(False)))
    return ~kind.isin("STRING", "VOID") if name in ("original_name", "directory") else kind != "STRING"


def _message(name: str, kind: F.Column) -> F.Column:
    """What to say of a wrong field of this kind."""
    if name in WHOLE:
        said = "Input should be a valid integer"
        return (
            F.when(kind == "STRING", f"{said}, unable to parse string as an integer")
            .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), f"{said}, got a number with a fractional part")
            .otherwise(said)
        )
    return F.lit(f"Input should be {_allowed(ENUMS[name])}" if name in ENUMS else "Input should be a valid string")


def check(scenes: DataFrame) -> DataFrame:
    """The records with valid, and problems: 'field: message' of every bad field, joined by '; ', or null.

    Both follow from the fields' kinds and texts, which records() has read; a filter by valid
    makes no message.
    """
    absent = lambda f, c: f[c]["kind"].isNull()
    bad = lambda f, c: F.when(absent(f, c), F.lit(c not in OPTIONAL)).otherwise(_wrong(c, f[c]))
    said = lambda f, c: F.when(bad(f, c), F.concat(F.lit(f"{c}: "), F.when(absent(f, c), F.lit("Field required")).otherwise(_message(c, f[c]["kind"]))))
    # typed values are of the right kinds already. The tests of others are beside a function of an
    # array: written into one method, as Spark does with a stage, they are too long for the JVM to compile
    right = reduce(and_, [F.col(f"typed.{c}").isin(*ENUMS[c]) if c in ENUMS else F.col(f"typed.{c}").isNotNull() for c in COLUMNS if c not in OPTIONAL])
    others = F.forall(F.array("fields"), lambda f: ~reduce(or_, [bad(f, c) for c in COLUMNS]))
    valid = F.when(F.col("reject").isNotNull(), F.lit(False)).when(F.col("typed").isNotNull(), F.coalesce(right, F.lit(False))).otherwise(others)
    checked = scenes.withColumn("valid", valid)
    problems = F.get(F.transform(F.array("fields"), lambda f: F.concat_ws("; ", *[said(f, c) for c in COLUMNS])), F.lit(0))
    return checked.withColumn("problems", F.when(~valid, F.coalesce(F.col("reject"), problems)))


def file_of(checked: DataFrame) -> F.Column:
    """The record's file for messages, or its sidecar if it has none."""
    return F.coalesce(F.col("fields.file.text"), F.col("sidecar_path"))


def first_problem(checked: DataFrame, file: F.Column | None = None) -> DataFrame:
    """The first bad record in path order, as (file, problems); a top-1, not a full sort. file: where file_of is, if stored."""
    bad = checked.where("not valid")
    return bad.orderBy(path_order(), "sidecar_path", "pos").limit(1).select((file_of(bad) if file is None else file).alias("file"), "problems")


def require_valid(checked: DataFrame, file: F.Column | None = None) -> None:
    """Raises ValueError for the first bad record."""
    for row in first_problem(checked, file).collect():  # one row at most
        raise ValueError(f"{row.file}: {row.problems}")


def gate(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) records."""
    return checked.where("valid"), checked.where("not valid")


def gate_counts(checked: DataFrame) -> DataFrame:
    """One row: records, valid and rejected; what a check without a build reports."""
    return checked.agg(F.count("*").alias("records"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("rejected"))
