import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import discovery

pytestmark = pytest.mark.usefixtures("small_plans")


def graph(seed):
    """Calls (source, target, confidence, dispatch, visible) by relation order, and overrides (source, target) in theirs."""
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(14)]
    calls, rel = [], 0
    for _ in range(45):
        a, b = rng.sample(names, 2)
        calls.append((a, b, rng.choice(["confirmed", "possible"]), rng.choice(["virtual_slot", "static_target"]), rng.random() < 0.8))
    relations = {}
    for a, b, c, *_ in calls:
        rel = relations.setdefault((a, b, c), len(relations))
    overrides = list(dict.fromkeys(tuple(rng.sample(names, 2)) for _ in range(9)))
    return names, calls, relations, overrides


def plain(names, calls, relations, overrides, start, incoming, depth, budget):
    """The traversal one node after the other."""

    def closure(node, up):
        out, at = [], 0
        while at <= len(out):
            x = node if at == 0 else out[at - 1]
            for a, b in overrides:
                y = b if up and a == x else a if not up and b == x else None
                if y is not None and y != node and y not in out:
                    out.append(y)
            at += 1
        return out

    seen = [c for c in calls if c[4]]
    visited, frontier, records, confirmed = {start}, [start], [], {start: True}

    def seal(other):
        sites = []
        for a, b, c, d, _ in seen:
            if incoming and a == other:
                if b in frontier:
                    sites.append((a, b, c == "possible", c != "possible" and confirmed[b]))
                if d == "virtual_slot" and any(b in closure(n, True) for n in frontier):
                    sites.append((a, b, True, False))
            if not incoming and a in frontier:
                if b == other:
                    sites.append((a, b, c == "possible", c != "possible" and confirmed[a]))
                if d == "virtual_slot" and b in closure(other, True):
                    sites.append((a, b, True, False))
        return sites

    for hop in range(1, depth + 1):
        level, rejected = [], set()
        for node in frontier:
            met = []
            if incoming:
                for slot in [node, *closure(node, True)]:
                    met += [a for (a, b, _), _ in sorted(relations.items(), key=lambda x: x[1]) if b == slot]
            else:
                for (a, b, c), _ in sorted(relations.items(), key=lambda x: x[1]):
                    if a == node:
                        met.append(b)
                        if any(x[:4] == (a, b, c, "virtual_slot") for x in seen):
                            met += closure(b, False)
            for other in met:
                if other in visited or other in rejected:
                    continue
                if len(records) >= budget:
                    return records, False
                sites = seal(other)
                if not sites:
                    rejected.add(other)
                    continue
                confirmed[other] = any(s[3] for s in sites)
                visited.add(other)
                level.append(other)
                records.append((hop, other, confirmed[other]))
        frontier = level
    return records, True


@pytest.mark.parametrize("seed,incoming", [(1, True), (2, False)])
def test_budgets(spark, seed, incoming):
    """Order, cut and completeness as of a plain traversal, with budgets inside and at the ends of levels."""
    names, calls, relations, overrides = graph(seed)
    evidence = spark.createDataFrame([(a, b, c, d, "f.h", i, "u1") for i, (a, b, c, d, v) in enumerate(calls) if v], "source string, target string, confidence string, dispatch string, path string, b_off long, unit string")
    rel = spark.createDataFrame([(*k, i) for k, i in relations.items()], "source string, target string, confidence string, rel long")
    over = spark.createDataFrame([(*o, i) for i, o in enumerate(overrides)], "source string, target string, rel long")
    t = discovery.Traversal(rel, evidence, over)
    start = spark.createDataFrame([("s0",)], "symbol string")
    whole, _ = plain(names, calls, relations, overrides, "s0", incoming, 3, 10**9)
    assert len(whole) > 4
    for budget in (None, 0, *range(2, len(whole) + 2, 3)):
        got = t.run(start, incoming, 3, budget)
        want, complete = plain(names, calls, relations, overrides, "s0", incoming, 3, 10**9 if budget is None else budget)
        rows = [] if got.records is None else sorted(got.records.collect(), key=lambda r: r.ordinal)
        assert [(r.hop, r.symbol, r.path_confirmed) for r in rows] == want == whole[: len(want)]
        assert [r.ordinal for r in rows] == list(range(1, len(rows) + 1)) and got.complete == complete


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = discovery.numbered(df, "k").collect()
    assert sorted(r.ordinal for r in got) == list(range(1, 5001)) and all(r.ordinal == r.k + 1 for r in got)
