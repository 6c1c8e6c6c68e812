"""file_api: what a file declares and includes, with the number of units that saw it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def places(locations: DataFrame) -> DataFrame:
    """(symbol, path, b_off, e_off, role, n_units): a place is the same whoever saw it; implicit declarations are no API."""
    return locations.filter("role <> 'implicit_declaration'").groupBy("symbol", "path", "b_off", "e_off", "role").agg(F.count_distinct("unit").alias("n_units"))


def entries(locations: DataFrame) -> DataFrame:
    """(path, symbol, first_off, n_here, n_units): a file's symbols with their first place in it."""
    return (
        locations.filter("role <> 'implicit_declaration'")
        .groupBy("path", "symbol")
        .agg(F.min("b_off").alias("first_off"), F.count_distinct("b_off", "e_off", "role").alias("n_here"), F.count_distinct("unit").alias("n_units"))
    )


def elsewhere(locations: DataFrame) -> DataFrame:
    """(path, symbol, n_elsewhere): places of a file's symbols in other files; from counts, not from pairs of places."""
    here = entries(locations).select("path", "symbol", "n_here")
    total = places(locations).groupBy("symbol").agg(F.count("*").alias("n"))
    return here.join(total, "symbol").select("path", "symbol", (F.col("n") - F.col("n_here")).alias("n_elsewhere"))


def merge_includes(rows: DataFrame, key: list[str], unit: str = "unit", ident: str = "id") -> DataFrame:
    """Observations of an include, one row for each key: units that saw it, and its first row, whose condition path counts."""
    return rows.groupBy(*key).agg(F.count_distinct(unit).alias("n_units"), F.min(ident).alias("first_id"))


#: What makes two observations of an include one entry.
INCLUDE = ("b_off", "directive", "operand_kind", "operand", "expanded", "activity", "resolution", "target", "path")


def public_includes(rows: DataFrame, withheld: DataFrame) -> DataFrame:
    """Includes none of whose files, that of the directive, the includer and the target, is withheld; a null one is visible."""
    for c in ("path", "includer", "target"):
        if c in rows.columns:
            rows = rows.join(withheld.select(F.col("path").alias(c)), c, "left_anti")
    return rows


def condition_paths(terms: DataFrame) -> DataFrame:
    """(unit, id, conditions): the branches around an include from the outside in, each with its own term (number -1) and those of the branches before it."""
    term = lambda x: F.struct(x["kind"].alias("kind"), x["expression"].alias("expression"))
    one = terms.groupBy("unit", "id", "branch").agg(F.max("is_else").alias("is_else"), F.array_sort(F.collect_list(F.struct("term", "kind", "expression"))).alias("t"))
    own = F.get(F.transform(F.filter("t", lambda x: x["term"] < 0), term), F.lit(0))
    before = F.transform(F.filter("t", lambda x: x["term"] >= 0), term)
    branch = F.struct("branch", "is_else", own.alias("own"), before.alias("preceding"))
    return one.select("unit", "id", branch.alias("b")).groupBy("unit", "id").agg(F.array_sort(F.collect_list("b")).alias("b")).select("unit", "id", F.transform("b", lambda x: x.dropFields("branch")).alias("conditions"))


def includes_of(rows: DataFrame, terms: DataFrame | None, withheld: DataFrame) -> DataFrame:
    """A row for each include in order of its place: its fields, the number of units that saw it, and the condition path of its first observation."""
    merged = public_includes(rows, withheld).groupBy(*INCLUDE).agg(F.count_distinct("unit").alias("units"), F.min(F.struct("id", "unit")).alias("first"))
    if terms is None:
        return merged.drop("first").orderBy(*INCLUDE)
    path = condition_paths(terms.join(rows.select("unit", "id").distinct(), ["unit", "id"], "left_semi"))
    wide = merged.withColumn("id", F.col("first.id")).withColumn("unit", F.col("first.unit")).drop("first").join(path, ["unit", "id"], "left")
    return wide.drop("unit", "id").orderBy(*INCLUDE)
