"""find_code's four tiers as DataFrames: exact name, qualified name, component run, path run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.identifier import QualifiedQuery, contains_run, identifier_components, trim_ascii

TIERS = {1: "exact_identifier", 2: "qualified_name", 3: "identifier_component", 4: "path"}
#: Ties within a tier, bytewise.
ORDER = ("qualified", "kind", "signature", "symbol")


def exact(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("name") == name)


def qualified(symbols: DataFrame, query: str) -> DataFrame:
    """The last segment selects by name first; the rest is compared on what that leaves."""
    q = QualifiedQuery(query)
    return symbols.filter(F.col("name") == q.last).filter(q.matches(F.col("qualified")))


def by_components(symbols: DataFrame, query: str) -> DataFrame:
    """Names that hold the query's components as a run; of a qualified query its last segment in the name and all of it in the qualified name."""
    wanted = identifier_components(F.lit(query))
    last = identifier_components(F.lit(query.rpartition("::")[2])) if "::" in query else wanted
    hit = symbols.filter(contains_run(identifier_components(F.col("name")), last))
    return hit.filter(contains_run(identifier_components(F.col("qualified")), wanted)) if "::" in query else hit


def by_path(files: DataFrame, query: str) -> DataFrame:
    return files.filter(contains_run(identifier_components(F.col("path")), identifier_components(F.lit(query))))


def find(symbols: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """(tier, match, qualified, kind, signature, symbol, path): each symbol at its first tier, then files. symbols and files: what may be seen."""
    query = query.strip(" \t\r\n\f\v")
    if not query:
        raise ValueError("empty_query")
    own = [exact(symbols, query).withColumn("tier", F.lit(1))] if "::" not in query else [qualified(symbols, query).withColumn("tier", F.lit(2))]
    own.append(by_components(symbols, query).withColumn("tier", F.lit(3)))
    best = reduce(DataFrame.unionByName, own).withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy("tier"))).filter("rn = 1")
    shown = best.select("tier", *ORDER[:3], "symbol", F.lit(None).cast("string").alias("path"))
    none = F.lit(None).cast("string")
    paths = by_path(files, query).select(F.lit(4).alias("tier"), none.alias("qualified"), none.alias("kind"), none.alias("signature"), none.alias("symbol"), "path")
    match = F.element_at(F.array(*(F.lit(TIERS[i]) for i in range(1, 5))), F.col("tier"))
    return shown.unionByName(paths).withColumn("match", match)


def page(hits: DataFrame, returned: int, limit: int, order: tuple[str, ...] = ("tier", *ORDER, "path")) -> DataFrame:
    """Rows returned .. returned + limit of the total order, without numbering the others."""
    return hits.orderBy(*order).offset(returned).limit(limit)


__all__ = ["by_components", "by_path", "exact", "find", "page", "qualified", "trim_ascii"]
