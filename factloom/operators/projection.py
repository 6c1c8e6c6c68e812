"""The public projection: what is visible when files are withheld. Anti-joins come first, aggregates after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.shared import stash


def visible(rows: DataFrame, withheld: DataFrame) -> DataFrame:
    """Rows whose file isn't withheld; a null file is visible (a null key matches nothing)."""
    return rows.join(withheld.select("path"), "path", "left_anti")


def presence(locations: DataFrame, withheld: DataFrame, placeholders: DataFrame | None = None) -> DataFrame:
    """(symbol, presence, n_locations, n_visible): indexed by a visible real location, implicit_hidden by a visible
    implicit one only, external_placeholder without any location if registered as one, null where nothing is visible.
    Location counts include withheld ones. placeholders: a column symbol."""
    w = withheld.select("path", F.lit(True).alias("__w"))
    seen = locations.join(w, "path", "left").withColumn("__v", F.col("__w").isNull())
    real = F.max(F.col("__v") & (F.col("role") != "implicit_declaration"))
    located = seen.groupBy("symbol").agg(
        F.when(real, "indexed").when(F.max("__v"), "implicit_hidden").alias("presence"), F.count("*").alias("n_locations"), F.sum(F.col("__v").cast("long")).alias("n_visible")
    )
    if placeholders is None:
        return located
    bare = placeholders.select("symbol").distinct().join(located.select("symbol"), "symbol", "left_anti")
    none = F.lit(0).cast("long")
    return located.unionByName(bare.select("symbol", F.lit("external_placeholder").alias("presence"), none.alias("n_locations"), none.alias("n_visible")))


def public(locations: DataFrame, withheld: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(symbol, presence) of what may be shown.

    symbols (symbol, placeholder, scope_file, enclosing) adds what locations don't tell: placeholders, symbols of
    internal linkage, which go with their file, and local ones, which go with the symbol around them. A symbol that has
    neither a location nor a placeholder is an endpoint only and hides what it encloses.
    """
    if symbols is None:
        return presence(locations, withheld).filter("presence IS NOT NULL").select("symbol", "presence")
    shown = stash(presence(locations, withheld, symbols.filter("placeholder")).filter("presence IS NOT NULL").select("symbol", "presence"), "presence")
    known = symbols.groupBy("symbol").agg(F.min("scope_file").alias("scope_file"), F.min("enclosing").alias("enclosing"))
    scoped = known.join(withheld.select(F.col("path").alias("scope_file")), "scope_file", "left_semi").select("symbol")
    hidden = known.select("symbol").join(shown.select("symbol"), "symbol", "left_anti").unionByName(scoped)
    inner = known.filter("enclosing IS NOT NULL").select("symbol", "enclosing")
    return shown.join(withhold_locals(inner, hidden), "symbol", "left_anti")


def searchable(public_symbols: DataFrame) -> DataFrame:
    return public_symbols.filter("presence <> 'implicit_hidden'")


def primary_location(locations: DataFrame, withheld: DataFrame) -> DataFrame:
    """(symbol, role, path, b_off, e_off, unit): the least visible location by role (definition, declaration, implicit), path, offsets, unit."""
    rank = F.when(F.col("role") == "definition", 0).when(F.col("role") == "declaration", 1).otherwise(2)
    place = F.struct(rank.alias("rank"), "path", "b_off", "e_off", "unit", "role")
    return visible(locations, withheld).groupBy("symbol").agg(F.min(place).alias("l")).select("symbol", "l.role", "l.path", "l.b_off", "l.e_off", "l.unit")


#: Public symbols (about 40 bytes each) up to which they are broadcast to the evidence; beyond, both sides are shuffled.
BROADCAST_SYMBOLS = 500_000


def public_evidence(evidence: DataFrame, public_symbols: DataFrame, withheld: DataFrame) -> DataFrame:
    """Visible evidence of relations whose two ends are public. public_symbols is counted, so it should be a table."""
    ends = public_symbols.select("symbol")
    few = ends.count() <= BROADCAST_SYMBOLS
    side = lambda c: F.broadcast(ends.withColumnRenamed("symbol", c)) if few else ends.withColumnRenamed("symbol", c)
    return visible(evidence, withheld).join(side("source"), "source", "left_semi").join(side("target"), "target", "left_semi")


def public_relations(evidence: DataFrame, public_symbols: DataFrame, withheld: DataFrame) -> DataFrame:
    """(source, target, confidence, n_sites): relations with visible evidence; confidence is part of their identity."""
    return public_evidence(evidence, public_symbols, withheld).groupBy("source", "target", "confidence").agg(F.count("*").alias("n_sites"))


def withhold_locals(symbols: DataFrame, hidden: DataFrame) -> DataFrame:
    """Symbols (symbol, enclosing) hidden because what encloses them is: to the fixpoint, a level a round.

    hidden: those hidden to begin with. An enclosing symbol that is unknown hides nothing.
    """
    found = stash(hidden.select("symbol").distinct(), "hidden")
    level = found
    while True:
        inner = symbols.join(level.select(F.col("symbol").alias("enclosing")), "enclosing", "left_semi").select("symbol")
        level = stash(inner.join(found, "symbol", "left_anti").distinct(), "hidden")
        if level.isEmpty():
            return found
        found = stash(found.unionByName(level), "hidden")
