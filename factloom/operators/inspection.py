"""Inspections: two passes over tracked inputs, what they conclude, and the state of units that is kept of them.

A state is (unit, semantic, compile_context, uht, checked_at, reasons). A complete inspection replaces the states of all
its units. One that isn't complete (the time ran out, or another generation was published meanwhile) can only take trust
away: what was fresh becomes unknown, units that were found stale so far are recorded as stale, nothing becomes fresh.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import freshness
from factloom.sources import files
from factloom.sources.shared import stash

VERDICTS = ("semantic", "compile_context", "uht")
STATE = "unit string, semantic string, compile_context string, uht string, checked_at timestamp, reasons string"
#: Reasons that are listed for a unit; their number is told where there are more.
REASONS = 20


def reasons(inputs: DataFrame) -> DataFrame:
    """(unit, reasons): the changes of each unit's inputs, in order, a line each."""
    seen = freshness.changes(inputs).filter("kind IS NOT NULL").select("unit", F.concat("kind", F.lit(" "), "path_key").alias("line"), "path_key", "kind").distinct()
    listed = F.slice(F.array_sort(F.collect_list(F.when(F.col("place") <= REASONS, F.struct("place", "line")))), 1, REASONS)
    placed = seen.withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy("path_key", "kind")))
    more = F.when(F.count("*") > REASONS, F.concat(F.lit("\nand "), (F.count("*") - REASONS).cast("string"), F.lit(" more"))).otherwise("")
    return placed.groupBy("unit").agg(F.concat(F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), more).alias("reasons"))


def conclude(inputs: DataFrame, currency: DataFrame, context_roles: tuple[str, ...], at: Column, uht: bool = True) -> DataFrame:
    """States of all units from inputs with both passes (unit, path_key, role, recorded, first, second)."""
    verdicts = freshness.by_unit(inputs, currency, context_roles, uht).select("unit", *VERDICTS)
    unverified = F.when((F.col("semantic") == "unknown") & F.col("r").isNull(), F.lit("the build isn't verified"))
    said = verdicts.join(reasons(inputs).withColumnRenamed("reasons", "r"), "unit", "left")
    return said.select("unit", *VERDICTS, at.cast("timestamp").alias("checked_at"), F.coalesce("r", unverified, F.lit("")).alias("reasons"))


def downgraded(states: DataFrame, outcome: str, found: DataFrame | None = None) -> DataFrame:
    """States after an inspection that ended as `outcome` says before it was complete. found: conclusions so far."""
    line = F.lit(f"the last inspection was incomplete: {outcome}")
    less = [F.when(F.col(v) == "fresh", "unknown").otherwise(F.col(v)).alias(v) for v in VERDICTS]
    kept = states.select("unit", *less, "checked_at", F.concat_ws("\n", F.when(F.col("reasons") != "", F.col("reasons")), line).alias("reasons"))
    if found is None:
        return kept
    stale = found.filter("semantic = 'stale'").select(kept.columns)
    return kept.join(stale.select("unit"), "unit", "left_anti").unionByName(stale)


def replaced(states: DataFrame, found: DataFrame) -> DataFrame:
    """States after a complete inspection: its units' are new, others (of other profiles) stay."""
    return states.join(found.select("unit"), "unit", "left_anti").unionByName(found.select(states.columns))


@dataclass
class Inspection:
    """outcome: complete, budget_exhausted or generation_changed. states: all states as they are to be kept. inputs: with both passes."""

    outcome: str
    states: DataFrame
    inputs: DataFrame
    checked: int


def inspect(
    recorded: DataFrame, currency: DataFrame, states: DataFrame, root: str, context_roles: tuple[str, ...], seconds: float, generation: Callable[[], int] = lambda: 0, uht: bool = True, between: Callable[[], None] = lambda: None
) -> Inspection:
    """Hashes every distinct input twice and concludes. recorded: unit, path_key, role, recorded (hash).

    generation: the committed generation, asked at the start and after the first pass. between: called between the
    passes. After a pass that isn't complete the second column repeats the first where that is known, and what wasn't
    looked at counts as unchanged, so that only what was seen to differ is stale.
    """
    until, began = time.monotonic() + seconds, generation()
    paths = stash(recorded.select(F.col("path_key").alias("path")).distinct(), "paths")

    def run() -> DataFrame:
        return stash(files.hashes(paths, root, max(0.0, until - time.monotonic())), "probe")

    def joined(first: DataFrame, second: DataFrame) -> DataFrame:
        one = first.select(F.col("path").alias("path_key"), F.col("hash").alias("first"), (F.col("state") == "late").alias("l1"))
        two = second.select(F.col("path").alias("path_key"), F.col("hash").alias("second"), (F.col("state") == "late").alias("l2"))
        both = recorded.join(one, "path_key").join(two, "path_key")
        known = F.when(F.col("l1"), F.col("recorded")).otherwise(F.col("first"))
        return both.select("unit", "path_key", "role", "recorded", known.alias("first"), F.when(F.col("l2"), known).otherwise(F.col("second")).alias("second"))

    now = F.current_timestamp()
    first = run()
    late = first.filter("state = 'late'").count()
    total = paths.count()
    outcome = "budget_exhausted" if late else None
    if outcome is None:
        between()
        outcome = "generation_changed" if generation() != began else None
    if outcome:
        inputs = joined(first, first)
        return Inspection(outcome, downgraded(states, outcome, conclude(inputs, currency, context_roles, now, uht) if generation() == began else None), inputs, total - late)
    second = run()
    inputs = joined(first, second)
    late = second.filter("state = 'late'").count()
    found = conclude(inputs, currency, context_roles, now, uht)
    if late or time.monotonic() >= until:
        return Inspection("budget_exhausted", downgraded(states, "budget_exhausted", found), inputs, total - late)
    return Inspection("complete", replaced(states, found), inputs, total)
