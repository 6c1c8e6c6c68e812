"""Content versions of files, shared by all facts that were seen in them, and what stands at a fact's span.

A version is a path (null for what is in no file) with the digest of its content. Versions are found or inserted in
bulk, null-safe, and numbered on by range counts; facts refer to them by number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import lines
from factloom.operators import discovery, facts
from factloom.sources.shared import stash

KEY = ["path", "content"]
#: What orders the places of a symbol; a place whose bytes aren't known comes before one whose digest is.
PLACE = ("path", "begin_line", "begin_column", "end_line", "end_column", "span_hash")


def find_or_insert(existing: DataFrame, *seen: DataFrame) -> DataFrame:
    """(version, path, content): existing ones with their numbers, and those that only `seen` rows (path, content) have."""
    new = reduce(DataFrame.unionByName, (s.select(*KEY).distinct() for s in seen))
    return facts.upsert(existing, new, KEY, "version")


def with_version(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """rows (path, content, ...) with the number of their version."""
    v = versions.select("version", F.col("path").alias("__path"), F.col("content").alias("__content"))
    return rows.join(v, F.col("path").eqNullSafe(F.col("__path")) & (F.col("content") == F.col("__content")), "left").drop("__path", "__content")


#: Bytes of a slice in which an offset's line is looked for, and of file begins whose spans are digested at once.
SLICE, SPANS = 512, 1 << 20


def _offsets(offsets: DataFrame, contents: DataFrame) -> DataFrame:
    """offsets (path, content, off) inside contents, with at: struct(line, column). A slice knows the lines before it, so an offset costs a slice and not its file."""
    last = (F.octet_length("bytes") / SLICE).cast("int")  # where a file ends with a slice, one more is empty
    # a function's own argument isn't copied each time that it is looked at, as a column is
    cut = F.flatten(F.transform(F.array("bytes"), lambda b: F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(b, i * SLICE + 1, F.lit(SLICE)))))
    slices = contents.select(*KEY, F.posexplode(cut).alias("i", "slice"))
    text, own = F.decode("slice", "ISO-8859-1"), W.partitionBy(*KEY).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    back = F.instr(F.reverse(text), "\n")
    newline = F.when(back > 0, F.col("i").cast("long") * SLICE + F.length(text) - back)
    known = slices.select(
        *KEY, "i", "slice", F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n")))).over(own), F.lit(0)).alias("lines"), F.coalesce(F.max(newline).over(own), F.lit(-1)).alias("newline")
    )
    at = lines.line_column(F.col("slice"), F.col("off") - F.col("i") * SLICE)
    found = offsets.withColumn("i", F.floor(F.col("off") / SLICE).cast("int")).join(known, [*KEY, "i"]).withColumn("at", at).filter("at IS NOT NULL")
    column = F.when(F.col("at.line") > 1, F.col("at.column")).otherwise(F.col("off") - F.col("newline"))
    return found.select(*KEY, "off", F.struct((F.col("lines") + F.col("at.line")).alias("line"), column.alias("column")).alias("at"))


def with_spans(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """rows (path, content, b_off, e_off, ...) with lines, columns and the digest of the bytes; nulls where they aren't known.

    contents: path, content (the digest), bytes. A file's bytes meet the spans that begin in one part of it as one row.
    """
    places = rows.select(*KEY, "b_off", "e_off").distinct()
    found = stash(_offsets(places.select(*KEY, F.explode(F.array("b_off", "e_off")).alias("off")).distinct(), contents), "offsets")
    held = places.groupBy(*KEY, F.floor(F.col("b_off") / SPANS).alias("g")).agg(F.collect_list(F.struct("b_off", "e_off")).alias("x")).join(contents.select(*KEY, "bytes"), KEY)
    digest = lambda b, s: F.struct(s["b_off"].alias("b_off"), s["e_off"].alias("e_off"), F.sha2(lines.span_bytes(b, s["b_off"], s["e_off"]), 256).alias("span_hash"))
    told = F.flatten(F.transform(F.array("bytes"), lambda b: F.transform("x", lambda s: digest(b, s))))
    hashed = held.select(*KEY, told.alias("x")).select(*KEY, F.inline("x"))
    ends = [found.select(*KEY, F.col("off").alias(c), F.col("at").alias(f"__{c}")) for c in ("b_off", "e_off")]
    seen = rows.join(hashed, [*KEY, "b_off", "e_off"], "left").join(ends[0], [*KEY, "b_off"], "left").join(ends[1], [*KEY, "e_off"], "left")
    return seen.select(
        *rows.columns, F.col("__b_off.line").alias("begin_line"), F.col("__b_off.column").alias("begin_column"), F.col("__e_off.line").alias("end_line"), F.col("__e_off.column").alias("end_column"), "span_hash"
    )


def first_places(spans: DataFrame) -> DataFrame:
    """(symbol, PLACE): the first place of each symbol."""
    return spans.groupBy("symbol").agg(F.min(F.struct(*PLACE)).alias("p")).select("symbol", *(f"p.{c}" for c in PLACE))


def ordered_edges(edges: DataFrame, by: tuple[str, ...], owner: str = "unit") -> DataFrame:
    """edges with `ordinal`, from 0 within an owner, in the order that they were written in (by). Counts of ranges number them, so no owner is sorted in one task."""
    every = discovery.numbered(edges, owner, *by, name="ordinal")
    first = every.groupBy(F.col(owner).alias("__o")).agg(F.min("ordinal").alias("__f"))
    return every.join(first, F.col(owner) == F.col("__o")).withColumn("ordinal", F.col("ordinal") - F.col("__f")).drop("__o", "__f")


def edge_lists(edges: DataFrame, sites: DataFrame, owner: str = "unit", site: str = "site", fields: tuple[str, ...] = ()) -> DataFrame:
    """(owner, edges): each owner's sites as an array in the order of its edges, however they were dealt meanwhile."""
    joined = edges.select(owner, "ordinal", site).join(sites.select(site, *fields), site)
    held = F.array_sort(F.collect_list(F.struct("ordinal", site, *fields)))
    return joined.groupBy(owner).agg(F.transform(held, lambda x: F.struct(*(x[c].alias(c) for c in (site, *fields)))).alias("edges"))
