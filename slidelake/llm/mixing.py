"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.shared import small, stored

#: Bits of a hash that make a uniform number.
_BITS = 52


def _uniform(seed: F.Column, *columns: str) -> F.Column:
    """A number in [0, 1) from the MD5 of the columns and a seed."""
    text = F.concat_ws("|", seed, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long") / F.lit(float(1 << _BITS))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: str = "n_chars", most: float | None = None, source: str = "source", text_column: str = "text") -> DataFrame:
    """(mix_source, mix_rate): how often each source's documents are repeated on average.

    The target share of a source is its weight, or by default its share of all `size` to the
    power `temperature`, made to sum to 1. The rate is target share over present share;
    `most` limits it where given, and then targets may not be reached. Where `size` is null or
    not above 0, the characters of the text count, if there is such a column. Sources without
    a weight get 0, so weights that name no source give 0 everywhere. All others are kept: one
    without any characters cannot change a share, and its rate is 1. Null is a source of its
    own, the same as an empty name. Rows that repeat count each; no rows give no rows.
    """
    measured = F.length(F.coalesce(F.col(text_column), F.lit(""))) if text_column in docs.columns else F.lit(0)
    known = F.when(F.col(size) > 0, F.col(size)).otherwise(measured)
    sizes = docs.select(F.coalesce(F.col(source), F.lit("")).alias("mix_source"), known.alias("known")).groupBy("mix_source").agg(F.sum("known").cast("double").alias("size"))
    if weights is not None:
        entries = [x for pair in weights.items() for x in (F.lit(pair[0]), F.lit(float(pair[1])))]
        goal = F.coalesce(F.try_element_at(F.create_map(*entries), F.col("mix_source")), F.lit(0.0)) if entries else F.lit(0.0)
    else:
        goal = F.pow("size", F.lit(temperature))
    # one row per source, from one scan; the totals over those that have a size are one row
    goals = stored(sizes.withColumn("goal", goal), "sizes")
    sized = lambda c: F.coalesce(F.sum(F.when(F.col("size") > 0, F.col(c))), F.lit(0.0)).alias(c)
    totals = goals.agg(sized("size"), sized("goal")).first()
    goals = goals.withColumn("all_size", F.lit(totals["size"])).withColumn("all_goal", F.lit(totals["goal"]))
    of_empty = F.lit(1.0) if weights is None else F.when(F.col("goal") > 0, 1.0).otherwise(0.0)
    rate = F.when(F.col("size") > 0, F.coalesce(F.expr("try_divide(goal, all_goal) / (size / all_size)"), F.lit(0.0))).otherwise(of_empty)
    return goals.select("mix_source", (rate if most is None else F.least(rate, F.lit(float(most)))).alias("mix_rate"))


def mixed(docs: DataFrame, repetition: DataFrame, seed: int = 0, most: float = 8.0, source: str = "source", id_column: str = "doc_id", added: tuple[str, ...] = ("copy", "rate", "shuffle_key")) -> DataFrame:
    """Each document as often as a Poisson draw with its source's rate says, in random order.

    The draw inverts the distribution at a uniform number that is hashed from seed and id, so
    it is the same in every run. A rate above `most` is drawn as the sum of several draws of
    equal rates up to `most`, each at a number of its own; `most` bounds the terms of an
    inversion, not the rates. The rows are dealt out by a hash of seed, id and copy, and sorted
    by it in each partition.

    Adds the columns of `added`: copy (from 0), rate and shuffle_key, in place of columns of
    these names; all other columns are kept, whatever their names. Rows of one id are drawn
    alike, and null ids share one draw; ties of the shuffle key, which only they can have, are
    in no order. A null source is matched as an empty one, and a source that `repetition`
    doesn't name has rate 1. Texts are neither read nor cut. No rows give no rows.
    """
    terms = int(most + 12 * most**0.5 + 12)
    # P(X <= k) for k = 0, 1, ..., by the recurrence of the terms
    step = lambda acc, k: F.struct((acc["p"] * F.col("part") / k).alias("p"), (acc["sum"] + acc["p"] * F.col("part") / k).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + acc["p"] * F.col("part") / k)).alias("cdf"))
    start = F.struct(F.exp(-F.col("part")).alias("p"), F.exp(-F.col("part")).alias("sum"), F.array(F.exp(-F.col("part"))).alias("cdf"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / F.lit(float(most)))).cast("int")
    tables = repetition.select("mix_source", F.col("mix_rate").alias("rate"), parts.alias("parts")).withColumn("part", F.col("rate") / F.col("parts"))
    tables = tables.select("mix_source", "rate", "parts", F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["cdf"]).alias("cdf"))
    # the row as one column, so that no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(source), F.lit("")).alias("mix_source"), F.col(id_column).alias("id"))
    drawn = rows.join(small(tables), "mix_source", "left")
    as_is = F.array(*[F.lit(p) for p in accumulate(math.exp(-1) / math.factorial(k) for k in range(terms + 1))])
    drawn = drawn.withColumn("rate", F.coalesce("rate", F.lit(1.0))).withColumn("cdf", F.coalesce("cdf", as_is))
    numbers = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda j: _uniform(F.when(j == 0, F.lit(str(seed))).otherwise(F.concat(F.lit(f"{seed} part "), j.cast("string"))), "id"))
    count = F.aggregate(numbers, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda x: x <= u)))
    copies = drawn.withColumn("n", count).where("n > 0").select("row", "id", "rate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)
