"""Attempts, unit counts, availability and layer summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """(slot, attempt, state): each slot's last attempt. A running maximum, combined before the shuffle."""
    return attempts.groupBy("slot").agg(F.max(F.struct("attempt", "state")).alias("a")).select("slot", "a.attempt", "a.state")


def failed_slots(attempts: DataFrame) -> DataFrame:
    return latest_attempts(attempts).filter("state IN ('failed', 'interrupted')")


def unit_counts(committed: DataFrame, failed: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: total = committed or failed, succeeded = committed and not failed, failed, stale. Each input: a column slot."""
    mark = lambda df, n: df.select("slot").distinct().withColumn(n, F.lit(True))
    all_of = mark(committed, "c").join(mark(failed, "f"), "slot", "full").join(mark(stale, "s"), "slot", "left")
    yes = lambda n: F.coalesce(n, F.lit(False))
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return all_of.agg(F.count("*").alias("total"), total(yes("c") & ~yes("f")).alias("succeeded"), total(yes("f")).alias("failed"), total(yes("s")).alias("stale"))


def availability(counts: DataFrame) -> DataFrame:
    """counts with availability: nothing and no failures is missing, nothing but failures failed, failures beside results partial, else ready."""
    none, failed = F.col("succeeded") == 0, F.col("failed") > 0
    return counts.withColumn("availability", F.when(none & ~failed, "missing").when(none, "failed").when(failed, "partial").otherwise("ready"))


def user_status(layers: DataFrame) -> DataFrame:
    """layers (layer, applicable, availability, freshness) with status: failed, missing, stale unless fresh, partial, ready."""
    status = F.when(F.col("availability").isin("failed", "missing"), F.col("availability")).when(F.col("freshness") != "fresh", "stale").when(F.col("availability") == "partial", "partial").otherwise("ready")
    return layers.withColumn("status", F.when(F.col("applicable"), status))


def overall(layers: DataFrame) -> DataFrame:
    """One row, the user's status: structure decides when it is missing or failed, then any stale layer, then any that isn't ready."""
    s = user_status(layers).filter("applicable")
    structure = F.max(F.when((F.col("layer") == "structure") & F.col("status").isin("missing", "failed"), F.col("status")))
    return s.agg(F.when(F.count("*") == 0, "missing").when(structure.isNotNull(), structure).when(F.max(F.col("status") == "stale"), "stale").when(F.max(F.col("status") != "ready"), "partial").otherwise("ready").alias("status"))
