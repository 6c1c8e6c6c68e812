"""Traversal in discovery order, cut by a budget of nodes.

Discovery order is breadth first: levels by hop; within a level, what the earlier nodes lead to comes first, for each
node by slot (itself, then the bases that it overrides, nearest first) and for each slot by the order of its relations.
Outgoing, a relation's target comes first and, if a visible call of it is virtual, the target's overriders after it.

A level's candidates are met by equi-joins, each keeps its least place (parent's ordinal, slot, relation), and places
become ordinals by counts of range partitions, so that no task sorts a level whole. A budget keeps ordinals up to it;
a page that continues asks for more of the same order, so pages of any budgets add up to the whole list.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import trace
from factloom.sources.shared import stash


def numbered(rows: DataFrame, *by: Column | str, name: str = "ordinal", flag: str | None = None, flagged: str = "of_flagged") -> DataFrame:
    """A table of rows with their places, from 1, in the order of values that tell them apart.

    flag: a boolean column, for places among the rows that have it as well.
    """
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    held = stash(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__i", place), "numbered")  # bounds come from a sample: dealt once
    one = F.col(flag).cast("int") if flag else F.lit(0)
    sizes = held.groupBy("__p").agg(F.count("*").alias("__n"), F.sum(one).alias("__m"))
    every = W.orderBy("__p")  # a row for each partition
    before = sizes.select("__p", (F.sum("__n").over(every) - F.col("__n")).alias("__b"), (F.sum("__m").over(every) - F.col("__m")).alias("__c"))
    out = held.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__i") + 1)
    if flag:
        out = out.withColumn(flagged, F.col("__c") + F.sum(one).over(W.partitionBy("__p").orderBy("__i")))
    return out.select(*rows.columns, name, *([flagged] if flag else []))


def relations(evidence: DataFrame, *order: str) -> DataFrame:
    """(source, target, confidence, rel): relations ordered by their least evidence, of equals by their own values."""
    key = ["source", "target", "confidence"]
    least = evidence.groupBy(*key).agg(F.min(F.struct(*order)).alias("least"))
    return least.select(*key, F.struct("least", *key).alias("rel"))


def led_to(step: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(symbol, label, n, path): what the roots (symbol, label) lead to, themselves included, each with the least label that
    leads there and the place that it has from that root: the fewest steps, of equals the least relations on the way.

    step: (at, to, rel). Only a smaller label goes on from a symbol that has one, so a level is a row for each symbol at
    most and no pairs are held. All that stands on a least way has, at its step, the same label as its end.
    """
    path = F.array().cast(f"array<{step.schema['rel'].dataType.simpleString()}>")
    level = best = stash(roots.select("symbol", "label", path.alias("path")), "led")
    k = 0
    while depth is None or k < depth:
        k += 1
        met = level.join(step, F.col("symbol") == F.col("at")).select(F.col("to").alias("symbol"), F.struct("label", F.concat("path", F.array("rel")).alias("path")).alias("x"))
        had = best.groupBy("symbol").agg(F.min("label").alias("had"))
        met = met.groupBy("symbol").agg(F.min("x").alias("x")).join(had, "symbol", "left")
        level = stash(met.filter("had IS NULL OR x.label < had").select("symbol", "x.label", "x.path"), "led")
        if level.isEmpty():
            break
        best = best.unionByName(level)  # tables all, one for each level
    least = best.groupBy("symbol").agg(F.min(F.struct("label", F.size("path").alias("n"), "path")).alias("x"))
    return stash(least.select("symbol", "x.label", "x.n", "x.path"), "led")


@dataclass
class Found:
    """records: hop, ordinal, symbol, path_confirmed, confirmed_sites, possible_sites. total: how many. stopped: by which budget.

    sites: for each hop, what gives the call sites of those of its records that are among some symbols; few are asked for.
    """

    records: DataFrame | None
    total: int
    stopped: str | None
    sites: list[Callable[[list[str]], DataFrame]]

    @property
    def complete(self) -> bool:
        return self.stopped is None


class Traversal:
    """One snapshot's public calls, for traversals from any symbol.

    relations: all calls between public symbols (source, target, rel); evidence: those that are visible (see trace);
    overrides: public overrides (source, target, rel). rel is any value that sorts. chain: the longest chain of overrides
    that calls are followed through; order: the longest along which candidates are met; any if absent.
    """

    def __init__(self, relations: DataFrame, evidence: DataFrame, overrides: DataFrame, chain: int | None = None, order: int | None = None) -> None:
        self.relations = stash(relations.select("source", "target", "confidence", "rel"), "relations")
        self.evidence = stash(evidence, "evidence")
        step = overrides.filter("source <> target").groupBy(F.col("source").alias("at"), F.col("target").alias("to")).agg(F.min("rel").alias("rel"))
        self.up = stash(step, "overrides")
        self.down = self.up.select(F.col("to").alias("at"), F.col("at").alias("to"), "rel")
        self.bases = self.up.select(F.col("at").alias("node"), F.col("to").alias("base"))
        self.ids = trace.symbol_numbers(self.evidence, self.bases)
        self.chain, self.order = chain, order

    def _met(self, frontier: DataFrame, incoming: bool) -> DataFrame:
        """(other, x): everything that the frontier (symbol, ordinal) leads to, with its least place."""
        # numbers are compared first, and relations only where those are least
        if incoming:
            slots = led_to(self.up, frontier.select("symbol", F.col("ordinal").alias("label")), self.order)
            slots = trace.few(numbered(slots, "label", "n", "path", name="p").select(F.col("symbol").alias("target"), "p"))
            of = self.relations.join(slots, "target")
            first = stash(of.groupBy("source").agg(F.min("p").alias("p")), "met")
            least = of.join(trace.few(first), ["source", "p"]).groupBy(F.col("source").alias("other"), "p").agg(F.min("rel").alias("rel"))
            return least.select("other", F.struct("p", "rel").alias("x"))
        own = trace.few(frontier.select(F.col("symbol").alias("source"), F.col("ordinal").alias("p")))
        of = self.relations.join(own, "source")
        first = trace.few(stash(of.groupBy("target").agg(F.min("p").alias("p")), "met"))
        direct = of.join(first, ["target", "p"]).groupBy("target").agg(F.min(F.struct("p", "rel")).alias("label"))
        live = self.evidence.filter("dispatch = 'virtual_slot'").join(own, "source")
        first = trace.few(stash(live.groupBy("target").agg(F.min("p").alias("p")), "met"))
        live = stash(live.join(first, ["target", "p"]).select("source", "target", "confidence").distinct(), "live")
        roots = of.join(trace.few(live), ["source", "target", "confidence"], "left_semi").groupBy(F.col("target").alias("symbol")).agg(F.min(F.struct("p", "rel")).alias("label"))
        through = led_to(self.down, roots, self.order)
        here = direct.select(F.col("target").alias("symbol"), "label", F.lit(0).alias("n"), F.array().cast(through.schema["path"].dataType).alias("path"))
        return here.unionByName(through).groupBy(F.col("symbol").alias("other")).agg(F.min(F.struct("label", "n", "path")).alias("x"))

    def run(self, start: DataFrame, incoming: bool = True, depth: int | None = 1, budget: int | None = None, seconds: float | None = None, known: int = 0) -> Found:
        """start: one symbol, which isn't reported. depth None: to the end. budget: records that are found before it stops.

        seconds: no further level begins after them, once there are more than `known` records (so a page that
        continues always gets on).
        """
        began = time.monotonic()
        frontier = stash(start.select("symbol", F.lit(True).alias("path_confirmed"), F.lit(1).cast("long").alias("ordinal")), "frontier")
        visited, records, sites, n, hop = frontier.select("symbol"), None, [], 0, 0
        ends = frontier.select("symbol", "path_confirmed")
        while depth is None or hop < depth:
            hop += 1
            met = self._met(frontier, incoming).join(visited.withColumnRenamed("symbol", "other"), "other", "left_anti")
            if budget is not None and n >= budget:
                return Found(records, n, None if met.isEmpty() else "node_budget", sites)
            if seconds is not None and n > known and time.monotonic() - began > seconds and not met.isEmpty():
                return Found(records, n, "time_budget", sites)
            at = ends
            sealed = stash(trace.sealed(self.evidence, self.bases, at, visited, self.ids, incoming, self.chain).withColumnRenamed("symbol", "other"), "sealed")
            # candidates without a public call site take a place as well: after the budget is used up, they stop the traversal
            kept = met.join(sealed, "other", "left").select(F.col("other").alias("symbol"), F.col("confirmed_sites").isNotNull().alias("sealed"), "path_confirmed", "confirmed_sites", "possible_sites", "x")
            every = stash(numbered(kept, "x", name="place", flag="sealed", flagged="ordinal").drop("x"), "every")
            within = F.col("sealed") & (F.lit(True) if budget is None else F.col("ordinal") + n <= budget)
            last = every.agg(F.count(F.when(within, 1)).alias("n"), F.max(F.when(within, F.col("place"))).alias("place"), F.max("place").alias("end")).first()
            cut = budget is not None and last.n + n >= budget and (last.end or 0) > (last.place or 0)
            level = every.filter(within).select(F.lit(hop).alias("hop"), (F.col("ordinal") + n).alias("ordinal"), "symbol", "path_confirmed", "confirmed_sites", "possible_sites")
            sites.append(lambda asked, at=at, level=level: trace.sites(self.evidence, self.bases, at, incoming, level.filter(F.col("symbol").isin(asked)), self.chain))
            records = level if records is None else records.unionByName(level)
            if cut or not last.n:
                return Found(records, n + last.n, "node_budget" if cut else None, sites)
            n += sealed.count()
            # what only a chain beyond `order` leads to has call sites, too, and counts as visited from here on
            ends = sealed.select(F.col("other").alias("symbol"), "path_confirmed")
            visited = visited.unionByName(ends.select("symbol"))
            frontier = level.select("symbol", "path_confirmed", "ordinal")
        return Found(records, n, None, sites)
