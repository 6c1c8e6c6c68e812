"""Change planning: what a profile run has to analyse, keep or retire, and which compile command a file has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_plan(committed: DataFrame, selected: DataFrame) -> DataFrame:
    """(slot, plan): new, changed, unchanged or retired. Both: slot, command_id."""
    c, s = committed.select("slot", F.col("command_id").alias("old")), selected.select("slot", F.col("command_id").alias("new"))
    have = lambda d: d.withColumn("__in", F.lit(True))
    both = have(c).withColumnRenamed("__in", "in_old").join(have(s).withColumnRenamed("__in", "in_new"), "slot", "full")
    plan = F.when(F.col("in_new").isNull(), "retired").when(F.col("in_old").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return both.select("slot", plan.alias("plan"))


def retired(committed: DataFrame, selected: DataFrame) -> DataFrame:
    return committed.select("slot").join(selected.select("slot"), "slot", "left_anti").distinct()


def command_selection(files: DataFrame, commands: DataFrame) -> DataFrame:
    """(file, selection, n_commands): none, unique or ambiguous by a file's distinct command ids; repeats of one command are one."""
    n = commands.groupBy("file").agg(F.count_distinct("command_id").alias("n"))
    found = files.select("file").distinct().join(n, "file", "left").withColumn("n_commands", F.coalesce("n", F.lit(0)))
    return found.select("file", F.when(F.col("n_commands") == 0, "none").when(F.col("n_commands") == 1, "unique").otherwise("ambiguous").alias("selection"), "n_commands")


def merge_inputs(inputs: DataFrame) -> DataFrame:
    """(path_key, n_hashes, conflict, is_system, role): observations of one file; hashes must agree, a source role wins, system only if all say so."""
    role = F.when(F.max(F.col("role") == "source"), "source").otherwise(F.min("role"))
    return inputs.groupBy("path_key").agg(F.count_distinct("hash").alias("n_hashes"), (F.count_distinct("hash") > 1).alias("conflict"), F.min("is_system").alias("is_system"), role.alias("role"))


def change_reasons(committed: DataFrame, requested: DataFrame, fields: list[str]) -> DataFrame:
    """(slot, reasons): of slots on both sides, the fields that differ, in the order given; null-safe."""
    a, b = committed.alias("a"), requested.alias("b")
    differ = F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields))
    return a.join(b, F.col("a.slot") == F.col("b.slot")).select(F.col("a.slot").alias("slot"), F.array_join(F.array_compact(differ), ",").alias("reasons"))


def input_changes(committed: DataFrame, requested: DataFrame) -> DataFrame:
    """(unit, path_key, change): added, removed, role_changed, modified, between two sets of (unit, path_key, role, hash)."""
    a = committed.select("unit", "path_key", F.col("role").alias("r0"), F.col("hash").alias("h0"), F.lit(True).alias("was"))
    b = requested.select("unit", "path_key", F.col("role").alias("r1"), F.col("hash").alias("h1"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("r0").eqNullSafe(F.col("r1")), "role_changed").when(~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return a.join(b, ["unit", "path_key"], "full").select("unit", "path_key", change.alias("change")).filter("change IS NOT NULL")
