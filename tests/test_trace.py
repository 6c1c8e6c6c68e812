import random

import pytest

from factloom.operators import discovery, trace

pytestmark = pytest.mark.usefixtures("small_plans")


def test_closure_of_a_dense_graph(spark, monkeypatch):
    """Depths as of a plain search; what is written in between isn't a row for each pair, although most symbols reach most others."""
    rng = random.Random(5)
    edges = {tuple(rng.sample([f"s{k}" for k in range(120)], 2)) for _ in range(330)}
    told = {}
    for start in {a for a, _ in edges}:
        at, seen, depth = {start}, {start}, 0
        while at:
            depth += 1
            at = {b for a, b in edges if a in at} - seen
            seen |= at
            told |= {(start, b): depth for b in at}
    over = spark.createDataFrame(list(edges), "source string, target string")
    plain, tables = trace.stash, []
    monkeypatch.setattr(trace, "stash", lambda df, what: tables.append(plain(df, what)) or tables[-1])
    got = trace.override_closure(over).collect()
    assert len(got) == len(told) > 10_000 and {(r.node, r.base): r.depth for r in got} == told
    assert sum(t.count() for t in tables) < len(told) / 4
    some = spark.createDataFrame([("s7",), ("nothing",)], "symbol string")
    assert {(r.node, r.base): r.depth for r in trace.override_closure(over, some, 2).collect()} == {k: d for k, d in told.items() if k[0] == "s7" and d <= 2}


def test_traces_hold_no_pairs(spark, monkeypatch):
    """In a graph where nearly all symbols override nearly all others, a traversal finds what a plain one does and writes as many rows as there are symbols, not pairs."""
    rng = random.Random(8)
    names = [f"s{k}" for k in range(90)]
    over = {tuple(rng.sample(names, 2)) for _ in range(250)}
    calls = [(*rng.sample(names, 2), rng.choice(["confirmed", "possible"]), rng.choice(["virtual_slot", "static_target"]), "f.h", k // 2) for k in range(60)]
    bases = {}
    for start in names:
        at, seen = {start}, {start}
        while at:
            at = {b for a, b in over if a in at} - seen
            seen |= at
        bases[start] = seen - {start}
    evidence = spark.createDataFrame([(*c, f"u{k % 3}") for k, c in enumerate(calls)], "source string, target string, confidence string, dispatch string, path string, b_off long, unit string")
    step = spark.createDataFrame(list(over), "node string, base string")
    plain, tables = trace.stash, []
    monkeypatch.setattr(trace, "stash", lambda df, what: tables.append(plain(df, what)) or tables[-1])
    for incoming, begin in ((True, calls[0][1]), (False, calls[0][0])):
        want, frontier, visited = {}, {begin: True}, {begin}
        for hop in (1, 2):
            sites = {}
            for a, b, c, d, *place in calls:
                if incoming:
                    met = [(a, c == "possible", c != "possible" and frontier.get(b))] * (b in frontier) + [(a, True, False)] * (d == "virtual_slot" and any(b in bases[n] for n in frontier))
                else:
                    met = ([(b, c == "possible", c != "possible" and frontier.get(a))] + [(n, True, False) for n in names if d == "virtual_slot" and b in bases[n]]) * (a in frontier)
                for other, possible, along in met:
                    if other not in visited:
                        sites.setdefault(other, set()).add((possible, along, a, b, d, *place))
            frontier = {o: any(x[1] for x in s) for o, s in sites.items()}
            visited |= set(frontier)
            want |= {o: (hop, frontier[o], len({x[2:] for x in s if not x[0]}), len({x[2:] for x in s if x[0]})) for o, s in sites.items()}
        got = trace.trace(evidence, step, spark.createDataFrame([(begin,)], "symbol string"), incoming, 2).collect()
        assert {r.symbol: (r.hop, r.path_confirmed, r.confirmed_sites, r.possible_sites) for r in got} == want and want
    assert sum(map(len, bases.values())) > 4_000 and max(t.count() for t in tables) <= len(over)


def test_order_follows_chains_as_long_as_told(spark):
    """Callers of a slot eight overrides away come last, or not at all where candidates are met along six at most; none is met twice."""
    over = spark.createDataFrame([(f"n{k}", f"n{k + 1}", k) for k in range(8)], "source string, target string, rel long")
    rows = [("far", "n8"), ("near", "n3"), ("own", "n0")]
    rel = spark.createDataFrame([(a, b, "confirmed", k) for k, (a, b) in enumerate(rows)], "source string, target string, confidence string, rel long")
    evidence = spark.createDataFrame([(a, b, "confirmed", "virtual_slot", "f.h", k, "u1") for k, (a, b) in enumerate(rows)], "source string, target string, confidence string, dispatch string, path string, b_off long, unit string")
    start = spark.createDataFrame([("n0",)], "symbol string")
    for order, want in ((None, ["own", "near", "far"]), (6, ["own", "near"])):
        got = discovery.Traversal(rel, evidence, over, None, order).run(start).records.collect()
        assert [r.symbol for r in sorted(got, key=lambda r: r.ordinal)] == want
