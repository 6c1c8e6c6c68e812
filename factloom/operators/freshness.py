"""Two-pass freshness: recorded hashes against those of two probes, folded by unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(inputs: DataFrame) -> DataFrame:
    """inputs with kind: deleted, else modified (the later probe differs from what is recorded), else changed_during_check, else null.

    inputs: unit, path_key, role, recorded, first, second.
    """
    kind = (
        F.when(F.col("second").isNull(), "deleted")
        .when(F.col("second") != F.col("recorded"), "modified")
        .when(~F.col("first").eqNullSafe(F.col("second")), "changed_during_check")
    )
    return inputs.withColumn("kind", kind)


def by_change(inputs: DataFrame) -> DataFrame:
    """(path_key, kind, n_units, units): each change with the units that depend on it."""
    return changes(inputs).filter("kind IS NOT NULL").groupBy("path_key", "kind").agg(F.count_distinct("unit").alias("n_units"), F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("units"))


def by_unit(inputs: DataFrame, currency: DataFrame, context_roles: tuple[str, ...], uht: bool = True) -> DataFrame:
    """(unit, semantic, compile_context, uht, n_inputs, n_changes): any change makes the semantic verdict stale, one of a
    context role the context, one of a reflected header the generated one; fresh needs a verified build."""
    seen = changes(inputs).groupBy("unit").agg(
        F.count("*").alias("n_inputs"), F.count("kind").alias("n_changes"), F.max(F.col("kind").isNotNull() & F.col("role").isin(*context_roles)).alias("context"),
        F.max(F.col("kind").isNotNull() & (F.col("role") == "reflected_header")).alias("reflected"),
    )
    both = seen.join(currency, "unit", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
    context = F.when(F.col("context"), "stale").when(F.col("verified"), "fresh").otherwise("unknown")
    semantic = F.when(F.col("n_changes") > 0, "stale").when(context == "fresh", "fresh").otherwise("unknown")
    generated = F.when(F.col("reflected"), "stale").otherwise("unknown") if uht else F.lit("not_applicable")
    return both.select("unit", semantic.alias("semantic"), context.alias("compile_context"), generated.alias("uht"), "n_inputs", "n_changes")


def combine(verdict: str) -> Column:
    """Of many verdicts: none is unknown, any stale is stale, all fresh is fresh, else unknown."""
    c = F.col(verdict)
    return F.when(F.count(c) == 0, "unknown").when(F.max(c == "stale"), "stale").when(F.min(c == "fresh"), "fresh").otherwise("unknown")


def totals(inputs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: units by verdict, inputs in all and checked in both passes."""
    count = lambda v: F.sum((F.col("semantic") == v).cast("long"))
    u = verdicts.agg(F.count("*").alias("units_total"), count("fresh").alias("units_fresh"), count("stale").alias("units_stale"), count("unknown").alias("units_unknown"))
    checked = (F.col("first").isNotNull() & F.col("second").isNotNull()).cast("long")
    i = inputs.agg(F.count_distinct("path_key").alias("inputs_total"), F.sum(checked).alias("inputs_present"))
    return u.crossJoin(i)  # one row each
