"""Fact sets: union as sets, retraction, pruning, find-or-insert keys, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.sources.shared import stash


def merge(*sets: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Contributions as one set. Columns in ignore (how a name was spelled) don't make facts differ; the least one stays."""
    both = reduce(DataFrame.unionByName, sets)
    key = [c for c in both.columns if c not in ignore]
    return both.groupBy(*key).agg(*(F.min(c).alias(c) for c in ignore)).select(both.columns) if ignore else both.distinct()


def without(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Facts that are left when units go: their owners are anti-joined, all else follows from what is left."""
    return facts.join(units.select("unit"), "unit", "left_anti")


def prune(rows: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows that something still refers to; references: one column each, nulls refer to nothing."""
    used = reduce(DataFrame.union, (r.select(F.col(r.columns[0]).alias(key)) for r in references)).filter(F.col(key).isNotNull()).distinct()
    return rows.join(used, key, "left_semi")


def upsert(existing: DataFrame, new: DataFrame, key: list[str], ident: str = "id") -> DataFrame:
    """existing and those of new whose key isn't there, numbered on from the highest number in order of the key.

    Keys compare null-safe. Numbers are dealt by ranges: rows are counted in each range partition and only those counts
    are summed, so no single task sorts all rows.
    """
    match = reduce(Column.__and__, (F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key))
    fresh = new.select(*key).distinct().alias("n").join(existing.select(*key).alias("e"), match, "left_anti")
    top = existing.agg(F.coalesce(F.max(ident), F.lit(0)).alias("top"))
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ordered = fresh.repartitionByRange(*key).sortWithinPartitions(*key)
    ranged = stash(ordered.withColumn("__p", F.spark_partition_id()).withColumn("__i", place), "ranges")  # bounds come from a sample: dealt once
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).select("__p", "__before")  # a row for each partition
    numbered = ranged.join(F.broadcast(before), "__p").crossJoin(top).select((F.col("top") + F.col("__before") + F.col("__i") + 1).alias(ident), *key)
    return existing.select(ident, *key).unionByName(numbered)


def put(*columns: Column) -> Column:
    """Length-prefixed fields, one after the other; null has a mark of its own."""
    return F.concat(*(F.when(c.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"), F.lit(";"))) for c in columns))


def fingerprint(rows: DataFrame, by: list[str], *fields: Column, name: str = "fingerprint") -> DataFrame:
    """SHA-256 of each group's rows, serialized, sorted and joined. A group is one unit's rows."""
    return rows.select(*by, put(*fields).alias("__row")).groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__row")), ""), 256).alias(name))


def path_digest(paths: DataFrame) -> DataFrame:
    """One row: SHA-256 of the distinct paths in order, a line each. Withheld paths are few."""
    return paths.agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set("path")), "\n"), F.when(F.count("*") > 0, F.lit("\n")).otherwise("")), 256).alias("digest"), F.count_distinct("path").alias("n"))


#: Hex digits by which hashes of rows are grouped, level by level: a group of a level has 256 members of the one before.
DIGITS = (8, 6, 4, 2, 0)


def distributed_digest(facts: DataFrame) -> DataFrame:
    """One row, a digest of a set of rows: their hashes are digested in groups of equal prefix, those digests in turn, up to one."""
    rows = facts.distinct().select(F.sha2(put(*(F.col(c) for c in sorted(facts.columns))), 256).alias("d"))
    level = rows.select(F.col("d").alias("p"), "d")
    for n in DIGITS:
        group = level.groupBy(F.substring("p", 1, n).alias("g")).agg(F.array_sort(F.collect_list(F.struct("p", "d"))).alias("x"))
        level = group.select(F.col("g").alias("p"), F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), ""), 256).alias("d"))
    return level.select(F.col("d").alias("digest"))
