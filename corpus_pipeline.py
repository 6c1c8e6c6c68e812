"""A training corpus from documents: five stages, each on all that its predecessor kept.

Every stage but the last returns the columns of documents (n_chars follows the text where a stage changes it).
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontam, mixing, neardup, quality, suffix
from factloom.llm.common import fresh, stash, table


#: Rows of texts that go to Python at once: 10,000 of them, Spark's default, are tens of MB on either side, and sets of shingles as much again.
BATCH_ROWS = "200"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade; abusive words are learned from the labelled rows of the whole table.

    Null and empty texts go; very long texts are judged whole; repeated rows are judged each; an empty table stays empty.
    """
    kept = fresh(docs.columns, "kept")
    abusive = quality.abusive_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.judge(docs, name=kept, abusive=abusive).filter(kept).drop(kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that Jaccard similarities of 0.8 of 5-word shingles link: the one with the least id (a null id comes last).

    Texts without words, null ones among them, are one group; rows that repeat an id and a text are copies; texts are
    compared whole; an empty table stays empty.
    """
    small_batches(spark)
    return neardup.first_of_groups(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; a character that a cut has split goes too.

    Null and empty texts stay as they are; a text of nothing but repeats becomes an empty one and its row stays; rows
    that repeat a text lose all of it from 200 bytes on; n_chars follows texts that change; an empty table stays empty.
    """
    small_batches(spark)
    done = suffix.without_repeats(docs)
    kept = next(c for c in done.columns if c.rstrip("_") == "kept" and c not in docs.columns)
    removed = next(c for c in done.columns if c.rstrip("_") == "n_removed" and c not in docs.columns)

    @F.arrow_udf("string")
    def decoded(a: pa.Array) -> pa.Array:
        return pa.array([x.as_py().decode("utf-8", "ignore") if x.is_valid else None for x in a], pa.string())

    cut_text = decoded(F.when(F.col(removed) > 0, F.col(kept)))
    cut = done.withColumn("text", F.when(F.col(removed) > 0, cut_text).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Null and wordless texts have none; repeated rows are judged each; without items all documents stay.
    """
    small_batches(spark)
    hits = fresh(docs.columns, "hits")
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=hits)
    return found.filter(F.size(F.col(hits)["spans"]) == 0).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at the same share of the output, in a global random order.

    A null source is one more; null and repeated ids have draws by their texts; empty texts are carried along; an empty
    table gives an empty result.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Near-duplicates and suffix arrays are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    return last(spark, reduce(lambda d, s: stash(s[1](spark, d, sf_dir), s[0]), first, docs), sf_dir)
