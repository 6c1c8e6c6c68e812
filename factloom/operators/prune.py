"""What goes when units go: their own rows, then shared rows that nothing refers to any more, table after table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import facts
from factloom.sources.shared import stash

#: A table that refers to another, and its columns for the other's key columns.
Reference = tuple[str, tuple[str, ...]]


def referred(rows: DataFrame, key: tuple[str, ...], references: list[tuple[DataFrame, tuple[str, ...]]], null_safe: bool = False) -> DataFrame:
    """Rows whose key something refers to. Keys are made distinct before they meet, so a key that is referred to often costs a row a partition."""
    used = reduce(DataFrame.unionByName, (r.select(*(F.col(c).alias(f"__{k}") for c, k in zip(columns, key, strict=True))) for r, columns in references))
    if not null_safe:
        used = used.dropna()
    match = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) if null_safe else F.col(k) == F.col(f"__{k}") for k in key))
    return rows.join(used.distinct(), match, "left_semi")


def remove_units(
    owned: dict[str, DataFrame], shared: dict[str, tuple[DataFrame, tuple[str, ...]]], references: dict[str, list[Reference]], units: DataFrame, null_safe: tuple[str, ...] = ()
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(owned, shared) tables after units (a column unit) left.

    owned: tables whose rows have a unit; shared: tables by name with their key columns; references: what refers to each
    shared table. Shared tables go in the order that they are given in. If one is referred to by itself or by a later
    one, passes are repeated until none of them shrinks. null_safe: tables in whose keys null is a value.
    """
    units = stash(units.select("unit").distinct(), "units")
    left = {t: facts.without(rows, units) for t, rows in owned.items()}
    kept = {t: rows for t, (rows, _) in shared.items()}
    order = list(shared)
    looped = any(r in order and order.index(r) >= order.index(t) for t, rs in references.items() for r, _ in rs)

    def once() -> None:
        for t in order:
            found = [((left | kept)[r], columns) for r, columns in references[t]]
            kept[t] = referred(kept[t], shared[t][1], found, t in null_safe)
            if not looped and any(r == t for rs in references.values() for r, _ in rs):
                kept[t] = stash(kept[t], t)  # read by what it refers to, and as a result

    once()
    while looped:
        before = {t: kept[t].count() for t in order}
        kept = {t: stash(rows, t) for t, rows in kept.items()}
        once()
        kept = {t: stash(rows, t) for t, rows in kept.items()}
        looped = any(kept[t].count() < before[t] for t in order)
    return left, kept
