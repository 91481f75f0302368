"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from slidelake.llm.shared import Work, own


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the lexicon learned from the labels calls toxic.

    Every row is judged by its own text, also where ids repeat or are null; null and empty
    texts stay. All columns stay as they are, whatever their names; no rows give no rows.
    """
    lexicon = toxicity.learn(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = own("toxicity", docs)
    return toxicity.scored(docs, lexicon, into=found).where(F.col(found)["score"] < 0.5).drop(found)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; see exact_dedup.deduplicated."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by Jaccard similarities of 0.8 on 5-word shingles one stays; see ngram_join.without_near_copies."""
    return ngram_join.without_near_copies(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that large sources count less, and shuffles all; see mixing.mixed."""
    return mixing.mixed(docs, mixing.rates(docs, temperature=0.5), seed=42, added=())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens; see packing.pack."""
    return packing.pack(docs, capacity=2048, end_id=0)


STAGES = [
    ("toxicity", keep_clean),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenization and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; each stage's rows are written and read again, and deleted when the next stage's are there."""
    docs, work, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Work(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            work.drop(before)
        before = name.replace(" ", "-")
    return docs
