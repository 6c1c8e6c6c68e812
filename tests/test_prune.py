import pytest
from factloom.operators import prune
from factloom.sources import lens

pytestmark = pytest.mark.usefixtures("small_plans")


def test_cascade_null_keys_and_loops(spark):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    owned = {"evidence": df([("u1", "a", "b", None, 1), ("u2", "c", "d", "f", 2), ("u1", "c", "d", None, 2)], "unit string, s string, t string, path string, v int")}
    shared = {
        "relation": (df([("a", "b"), ("c", "d")], "s string, t string"), ("s", "t")),
        "version": (df([(None, 1), ("f", 2), (None, 2)], "path string, v int"), ("path", "v")),
        "symbol": (df([("a", None), ("b", None), ("c", "o1"), ("o1", "o2"), ("o2", None), ("x1", "x2"), ("x2", "x1")], "symbol string, outer string"), ("symbol",)),
    }
    references = {"relation": [("evidence", ("s", "t"))], "version": [("evidence", ("path", "v"))], "symbol": [("relation", ("s",)), ("relation", ("t",)), ("symbol", ("outer",))]}
    left, kept = prune.remove_units(owned, shared, references, df([("u1",)], "unit string"), ("version",))
    assert left["evidence"].count() == 1 and [tuple(r) for r in kept["relation"].collect()] == [("c", "d")] and [tuple(r) for r in kept["version"].collect()] == [("f", 2)]
    # what a kept symbol is enclosed by stays; a ring that only refers to itself does too
    assert {r.symbol for r in kept["symbol"].collect()} == {"c", "o1", "o2", "x1", "x2"}
    chain = {"symbol": (df([(f"n{k}", f"n{k + 1}") for k in range(6)] + [("n6", None)], "symbol string, outer string"), ("symbol",))}
    _, kept = prune.remove_units({}, chain, {"symbol": [("symbol", ("outer",))]}, df([], "unit string"))
    assert kept["symbol"].count() == 0  # nothing refers to the first, so all go, one after the other


def test_calls_are_dealt_once(spark):
    """Lines go through one shuffle, by order, before calls are attached to symbols, whatever else is joined; and stay a set."""
    folder = "/root/testdata/sf0.001"
    loc = lens.locations(spark, folder)
    found = lens.call_numbers(spark, folder, lens.Numbers(loc))
    assert found.count() == found.distinct().count() == lens.calls(spark, folder, loc).distinct().count() == lens.calls(spark, folder, loc).count() > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if " Exchange " in x]
    assert len(dealt) <= 2 and all("REPARTITION_BY_COL" in x for x in dealt)
