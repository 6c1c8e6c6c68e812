"""Queries over a store from the command line: JSON on standard output, exit code 0, 1 (an error response) or 2 (usage)."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import identity
from factloom.operators import facts, projection
from factloom.plans import engine, response
from factloom.sources import files, store
from factloom.sources.shared import stash


def view(spark: SparkSession, root: str, workspace: str | None = None, profile: str | None = None) -> tuple[engine.View, dict]:
    """The current generation's public view; files that are excluded or gone from the workspace are withheld. Also the snapshot's tables."""
    meta = store.open_store(spark, root, workspace, profile)
    n = store.current(spark, root)
    t = store.snapshot(spark, root, n)
    told = store.excluded(spark, root)
    recorded = reduce(DataFrame.unionByName, (t[x].select("path") for x in ("location", "evidence", "unresolved", "include"))).filter("path IS NOT NULL").distinct()
    hidden = stash(files.withheld(told, recorded, files.scan(spark, workspace)) if workspace else told, "withheld")
    known = t["symbol"].select("symbol", F.coalesce("placeholder", F.lit(False)).alias("placeholder"), identity.scope_file(F.col("key")).alias("scope_file"), identity.enclosing(F.col("key")).alias("enclosing"))
    public = projection.public(t["location"], hidden, known)
    symbols = stash(t["symbol"].groupBy("symbol").agg(*(F.min(c).alias(c) for c in ("name", "qualified", "kind", "signature"))).join(public, "symbol"), "symbols")
    digest = facts.path_digest(hidden).first().digest
    calls, overrides = (t["evidence"].filter(F.col("kind") == k) for k in ("calls", "overrides"))
    state = response.Binding("", root, meta.profile, n, n, "", digest)
    return engine.View(symbols, t["location"], calls, overrides, hidden, state, t["unresolved"], t["include"], t["include_term"], "unreal" if meta.uht else "cpp"), t


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("store")
    p.add_argument("--workspace")
    p.add_argument("--profile")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("profiles")
    for name, what, limit in (("find", "query", 8), ("callers", "selector", 20), ("callees", "selector", 20), ("file", "path", 100)):
        c = commands.add_parser(name)
        c.add_argument(what)
        c.add_argument("--limit", type=int, default=limit)
        c.add_argument("--cursor")
        if what == "selector":
            c.add_argument("--depth", type=int, default=1)
            c.add_argument("--all", action="store_true")
            c.add_argument("--node-budget", type=int, default=20_000)
    return p


TOOLS = {"find": "find_code", "file": "file_api", "callers": "trace_calls", "callees": "trace_calls", "profiles": "profiles"}


def answer(spark: SparkSession, a: argparse.Namespace) -> dict:
    try:
        if a.command == "profiles":
            store.open_store(spark, a.store, a.workspace)
            return {"tool": "profiles", "status": "success", "diagnostics": [], "result": {"profiles": store.profiles(spark, a.store)}}
        v, _ = view(spark, a.store, a.workspace, a.profile)
    except store.StoreError as e:
        return response.error(TOOLS[a.command], e.code, str(e))
    if a.command == "find":
        shown = projection.searchable(v.symbols)
        seen = projection.visible(v.locations.select("path").distinct(), v.withheld)
        out = response.find_code(shown, seen, a.query, v.state, a.limit, a.cursor)
    elif a.command == "file":
        out = engine.file_api(v, a.path, a.limit, a.cursor)
    else:
        out = engine.trace_calls(v, a.selector, "incoming" if a.command == "callers" else "outgoing", a.depth, a.all, a.limit, a.node_budget, cursor=a.cursor)
    return out | {"project_kind": v.project_kind, "profile": v.state.profile, "fact_generation": v.state.fact_generation, "ranking_generation": v.state.ranking_generation}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    out = answer(SparkSession.builder.appName("factloom").getOrCreate(), a)
    json.dump(out, sys.stdout, ensure_ascii=False, indent=1)
    print()
    return int(out["status"] == "error")


if __name__ == "__main__":
    sys.exit(main())
