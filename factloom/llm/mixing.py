"""Mixing sources to target weights by Poisson replication, then a global shuffle.

A source's mean repetition rate is its target share of the output over its share of the input. A document's number of
copies is a Poisson draw of that mean, inverted from a uniform value that a seeded hash of the document gives, so a
document's copies depend on nothing but its id, its text, the seed and the rate. A mean above STEP is drawn as a sum of
independent draws of at most STEP each (sums of Poisson draws are Poisson), so no mean is too large to invert.

Defined cases: a null source is a source of its own; a row is told apart by its id (null is one more) and its text, so
that rows with null or repeated ids have draws of their own, and only rows that repeat both share one; a source without weight gets none of the output; empty and very long texts are
carried along; an empty table gives an empty result; added columns get a trailing underscore where a name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: The largest mean of one draw, and how many copies its distribution table spans (the rest has less than 1e-25).
STEP, SPAN = 16.0, 96
#: Sources up to which their rates (a row of about 900 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source") -> DataFrame:
    """(source, rate): how often a document of a source is to occur on average in an output of the input's size.

    weights: share of the output by source, in any unit; without it all sources get the same share.
    """
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = n.withColumn("weight", F.lit(1.0))
    else:
        told = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
        weighed = n.join(F.broadcast(told), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    return weighed.crossJoin(F.broadcast(total)).select("source", (F.col("weight") / F.col("all_weight") * F.col("all_n") / F.col("n")).alias("rate"))


def distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... SPAN of a Poisson variable of that mean."""
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(SPAN)), first, step, lambda s: s["c"])


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 42, source: str = "source", key: str = "doc_id", text: str = "text", copy: str = "copy", order: str = "shuffle_key"
) -> DataFrame:
    """docs with each row as often as drawn; copy numbers a row's copies from 0, order is the global random order.

    The rows are dealt to partitions by the order column's hash and sorted by it in each: a random permutation that
    depends on ids, texts and seed alone.
    """
    own = docs.columns
    names = list(own)
    for n in (copy, order, "source", "draws", "table", "draw", "u", "n", "number", "ident"):
        names.append(fresh(names, n))
    copy, order, of, draws, given, draw, u, n, number, ident = names[len(own) :]
    per = rates(docs, weights, source).select(
        F.col("source").alias(of),
        F.ceil(F.col("rate") / STEP).cast("int").alias(draws),
        distribution(F.col("rate") / F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP))).alias(given),
    )
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    who = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    drawn = (
        docs.withColumn(ident, who)
        .join(per, F.col(source).eqNullSafe(F.col(of)))
        .filter(F.col(draws) > 0)
        .withColumn(draw, F.explode(F.sequence(F.lit(0), F.col(draws) - 1)))
        .withColumn(u, uniform(F.lit(str(seed)), F.col(ident), F.col(draw).cast("string")))
        .withColumn(n, F.size(F.filter(given, lambda c: c <= F.col(u))))
        .filter(F.col(n) > 0)
        .withColumn(number, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    )
    number = (F.col(draw) * (SPAN + 2) + F.col(number)).cast("long")
    out = drawn.select(*own, number.alias(copy), F.md5(F.concat_ws("|", F.lit(f"order-{seed}"), ident, number.cast("string"))).alias(order))
    return out.repartition(order).sortWithinPartitions(order)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def mix_sql(docs: str, columns: str, seed: int = 42) -> str:
    """DuckDB: mix() of a relation at equal shares."""
    return f"""
WITH per AS (SELECT source, CAST(sum(count(*)) OVER () AS DOUBLE) / count(*) OVER () / count(*) AS rate FROM {docs} GROUP BY source),
steps AS (SELECT source, CAST(ceil(rate / {STEP}) AS INTEGER) AS draws, rate / greatest(1, ceil(rate / {STEP})) AS m FROM per),
cdf AS (SELECT source, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM steps, (SELECT unnest(range(0, {SPAN + 1})) AS k)),
draws AS (SELECT d.*, s.draw, CAST(CAST(('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) || '|' || s.draw), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM {docs} d JOIN (SELECT source, unnest(range(0, draws)) AS draw FROM steps) s ON d.source IS NOT DISTINCT FROM s.source),
n AS (SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS n FROM draws d),
x AS (SELECT *, CAST(draw * {SPAN + 2} + unnest(range(0, n)) AS BIGINT) AS copy FROM n)
SELECT {columns}, copy, md5('order-{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) || '|' || copy) AS shuffle_key FROM x"""


SQL = {"op1_mix_sources": mix_sql("documents", "doc_id, source, text")}
