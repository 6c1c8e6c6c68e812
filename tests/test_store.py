import json

import pytest
from oracle import shown
from pyspark.sql import functions as F

from factloom.operators import facts, projection, search, trace
from factloom.plans import response
from factloom.queries import Facts
from factloom.sources import compile_db, lens, store
from factloom.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def contributions(spark, *units):
    loc = lens.locations(spark, SMALL).filter(F.col("unit").isin(*units))
    s = loc.select("unit", "symbol", "key", "name", "qualified", "kind", "signature", F.lit(False).alias("placeholder")).distinct()
    pair = s.alias("a").join(s.alias("b"), (F.col("a.unit") == F.col("b.unit")) & (F.col("a.name") < F.col("b.name"))).filter(F.col("a.signature") == F.col("b.signature"))
    e = pair.select("a.unit", F.col("a.symbol").alias("source"), F.col("b.symbol").alias("target"), F.lit("calls").alias("kind"), F.lit("confirmed").alias("confidence"), F.lit("static_target").alias("dispatch"), F.lit("src/a.cpp").alias("path"), F.lit(1).cast("long").alias("b_off"))
    u = loc.select("unit").distinct().select("unit", F.concat(F.lit("fact-"), "unit").alias("fact_label"), F.lit("c").alias("command_id"), F.lit("r").alias("replay_id"), F.lit("ok").alias("status"))
    i = loc.select("unit", F.col("path").alias("path_key"), F.lit("header").alias("role"), F.lit("h").alias("hash"), F.col("path").alias("repo_path")).distinct()
    return {"unit": u, "symbol": s, "location": loc.select("unit", "symbol", "role", "path", "b_off", "e_off").distinct(), "evidence": e, "input": i}


def digests(tables):
    return {t: facts.distributed_digest(df).first().digest for t, df in tables.items() if t in store.SCHEMAS}


def test_replacement_equals_a_fresh_build(spark, tmp_path):
    root, other = str(tmp_path / "a"), str(tmp_path / "b")
    first = contributions(spark, "u1", "u2", "u3")
    assert store.publish(spark, root, first)[0] == 1
    before = digests(store.snapshot(spark, root, 1))
    changed = contributions(spark, "u2", "u4")
    changed["location"] = changed["location"].withColumn("b_off", F.col("b_off") + 1)
    gone = spark.createDataFrame([("u3",)], "unit string")
    assert store.publish(spark, root, changed, gone)[0] == 2
    alone = contributions(spark, "u1")
    assert store.publish(spark, other, {t: alone[t].unionByName(changed[t]) for t in alone})[0] == 1
    assert digests(store.snapshot(spark, root)) == digests(store.snapshot(spark, other))
    assert digests(store.snapshot(spark, root, 1)) == before


def test_bad_batches_change_nothing(spark, tmp_path):
    root = str(tmp_path)
    good = contributions(spark, "u1")
    store.publish(spark, root, good)
    for t, c, v, why in (
        ("unit", "status", "broken", "usable status"), ("symbol", "symbol", "cm1:x", "the id"), ("location", "path", "/abs", "location's path"), ("evidence", "target", "cm1:y", "end of a relation"),
        ("unit", "fact_label", "", "label is blank"), ("unit", "command_id", None, "command id"), ("input", "path_key", "same", "given twice"), ("input", "repo_path", "a//b", "input's path"),
    ):
        bad = good | {t: good[t].withColumn(c, F.lit(v).cast("string"))}
        n, found = store.publish(spark, root, bad)
        assert n == 1 and why in found.first().reason, (t, c, found.collect())
    assert store.current(spark, root) == 1 and store.log(spark, root).filter("state = 'failed'").count() == 8


def test_labels_and_slots_of_others(spark, tmp_path):
    root = str(tmp_path)
    store.publish(spark, root, contributions(spark, "u1", "u2"))
    taken = contributions(spark, "u3")
    taken["unit"] = taken["unit"].withColumn("fact_label", F.lit("fact-u1"))
    assert "owns the fact label" in store.publish(spark, root, taken)[1].first().reason
    assert "at once" in store.publish(spark, root, contributions(spark, "u3"), spark.createDataFrame([("u3",)], "unit string"))[1].first().reason
    assert store.publish(spark, root, taken, spark.createDataFrame([("u1",)], "unit string"))[0] == 2


def test_publication_rewrites_only_its_buckets(spark, tmp_path):
    root = str(tmp_path)
    units = [f"u{i}" for i in range(8)]
    store.publish(spark, root, contributions(spark, *units))
    store.publish(spark, root, contributions(spark, "u3"))
    first, second = ({(r.table, r.bucket): r.folder for r in store._folders(spark, root, n)} for n in (1, 2))
    own = spark.createDataFrame([("u3",)], "unit string").select(store.bucket_of().alias("b")).first().b
    assert {k[1] for k in second if second[k] != first.get(k)} == {own} and set(second) == set(first) and len({k[1] for k in first}) > 3
    assert digests(store.snapshot(spark, root)) == digests(contributions(spark, *units))
    assert store.interrupted(spark, root).count() == 0


def test_nothing_to_publish_is_not_recorded(spark, tmp_path):
    none = {t: spark.createDataFrame([], s) for t, s in store.SCHEMAS.items()}
    assert store.publish(spark, str(tmp_path), none)[0] == 0 and store.log(spark, str(tmp_path)).count() == 0


def test_stream_publishes_drops(spark, tmp_path):
    drop, root = str(tmp_path / "drop"), str(tmp_path / "root")
    ingest.as_drop(contributions(spark, "u1")).coalesce(1).write.parquet(drop)
    ingest.watch(spark, drop, root, str(tmp_path / "check")).awaitTermination(120)
    assert digests(store.snapshot(spark, root)) == digests(contributions(spark, "u1"))


def test_drops_hold_every_table_and_problems_are_told(spark, tmp_path):
    own = contributions(spark, "u1", "u2")
    some = own["symbol"].groupBy("unit").agg(F.min("symbol").alias("symbol"))
    own["unresolved"] = some.select("unit", "symbol", F.lit("f()").alias("expression"), F.lit("dependent").alias("reason"), F.lit(None).cast("string").alias("path"), F.lit(1).cast("long").alias("b_off"))
    text = lambda *names: [F.lit(n).alias(n) for n in names]
    own["include"] = some.select("unit", F.lit("i").alias("id"), *text("includer", "path"), F.lit(1).cast("long").alias("b_off"), *text("directive", "operand_kind", "operand", "expanded", "activity", "resolution"), F.lit("b.h").alias("target"))
    own["include_term"] = some.select("unit", F.lit("i").alias("id"), F.lit(0).alias("branch"), F.lit(-1).alias("term"), F.lit(False).alias("is_else"), *text("kind", "expression"))
    assert {t: df.count() for t, df in ingest.split(ingest.as_drop(own)).items()} == {t: df.count() for t, df in own.items()}
    drop, root, refused = (str(tmp_path / n) for n in ("drop", "root", "refused"))
    bad = own | {"unit": own["unit"].withColumn("status", F.when(F.col("unit") == "u2", "broken").otherwise(F.col("status")))}
    rows = spark.createDataFrame(ingest.as_drop(bad).collect(), ingest.DROP)
    with pytest.raises(ingest.Refused, match="1 units are refused: 'u2': the analysis"):
        ingest.publish(rows, root)
    assert store.current(spark, root) == 0
    rows.coalesce(1).write.parquet(drop)
    ingest.watch(spark, drop, root, str(tmp_path / "check"), refused=refused).awaitTermination(120)
    left = store.snapshot(spark, root)
    assert [r.unit for r in left["unit"].collect()] == ["u1"] and all(left[t].count() == 1 for t in ("unresolved", "include", "include_term"))
    told = spark.read.parquet(refused)
    assert {r.rule for r in told.collect()} == {6} and told.count() == sum(df.filter("unit = 'u2'").count() for df in own.values())


def test_pages_join_to_the_whole_result(spark):
    f = Facts(spark, SMALL)
    symbols, files = f.searchable.cache(), f.files.cache()
    state = response.Binding("", "db", "p", 1, 1, "", "w")
    whole = response.find_code(symbols, files, "plate", state, limit=1000)["result"]["results"]
    got, cursor = [], None
    while True:
        r = response.find_code(symbols, files, "plate", state, limit=7, cursor=cursor)
        got += r["result"]["results"]
        cursor = r["pagination"]["next_cursor"]
        if not cursor:
            break
    assert json.dumps(got) == json.dumps(whole) and len(whole) > 7
    codes = lambda **k: response.find_code(symbols, files, state=state, **k)["diagnostics"][0]["code"]
    assert [codes(query=" "), codes(query="a", limit=0), codes(query="a", cursor="x"), codes(query="a::")] == ["empty_query", "invalid_limit", "invalid_cursor", "invalid_query"]


def test_traversal_by_hand(spark):
    """run calls draw on the base by dispatch; circle overrides it; a cycle back to the start is not reported."""
    e = spark.createDataFrame(
        [("run", "shape", "confirmed", "virtual_slot", "a", 1, "u"), ("b", "circle", "confirmed", "qualified", "b", 1, "u"), ("b", "circle", "confirmed", "qualified", "b", 1, "v"), ("top", "run", "confirmed", "static_target", "a", 2, "u"),
         ("circle", "top", "confirmed", "static_target", "a", 3, "u"), ("p", "b", "possible", "static_target", "a", 4, "u")],
        "source string, target string, confidence string, dispatch string, path string, b_off long, unit string",
    )
    bases = trace.override_closure(spark.createDataFrame([("circle", "shape"), ("ring", "circle")], "source string, target string"))
    assert sorted((r.node, r.base, r.depth) for r in bases.collect()) == [("circle", "shape", 1), ("ring", "circle", 1), ("ring", "shape", 2)]
    start = spark.createDataFrame([("circle",)], "symbol string")
    got = {r.symbol: (r.hop, r.path_confirmed, r.confirmed_sites, r.possible_sites) for r in trace.trace(e, bases, start, depth=None).collect()}
    assert got == {"b": (1, True, 1, 0), "run": (1, False, 0, 1), "top": (2, False, 1, 0), "p": (2, False, 0, 1)}
    out = {r.symbol: (r.hop, r.confirmed_sites, r.possible_sites) for r in trace.trace(e, bases, spark.createDataFrame([("run",)], "symbol string"), incoming=False, depth=1).collect()}
    assert out == {"shape": (1, 1, 0), "circle": (1, 0, 1), "ring": (1, 0, 1)}


def test_withheld_closure_and_presence(spark):
    s = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "x")], "symbol string, enclosing string")
    assert {r.symbol for r in projection.withhold_locals(s, s.filter("symbol = 'a'")).collect()} == {"a", "b", "c"}
    loc = spark.createDataFrame([("s", "definition", "h", 1, 2, "u"), ("s", "declaration", None, 1, 2, "u"), ("i", "implicit_declaration", "p", 1, 2, "u"), ("g", "definition", "h", 1, 2, "u")], "symbol string, role string, path string, b_off long, e_off long, unit string")
    got = {r.symbol: r.presence for r in projection.presence(loc, spark.createDataFrame([("h",)], "path string")).collect()}
    assert got == {"s": "indexed", "i": "implicit_hidden", "g": None}


def test_compile_databases(spark, tmp_path):
    entries = [{"directory": "/w", "file": "a.cpp", "arguments": ["cc", "a.cpp"]}, {"directory": "/w", "file": "a.cpp", "arguments": ["cc", "-DX", "a.cpp"]}, {"directory": "/w", "file": "b.cpp", "command": "cc b.cpp"},
               {"directory": "/w", "file": "b.cpp", "arguments": ["cc", "b.cpp"]}, {"directory": "/w", "file": "x.cpp"}, {"directory": "/w", "command": "cc"}, {"directory": "/w", "file": "y", "arguments": [1]}, 5]
    (tmp_path / "ok.json").write_text("\ufeff" + json.dumps(entries))
    (tmp_path / "no.json").write_text("{}")
    rows = {(r.database.rpartition("/")[2], r["index"]): r for r in compile_db.read(spark, str(tmp_path)).collect()}
    assert rows["no.json", 0].problem == "the database is not an array"
    assert [rows["ok.json", i].problem is None for i in range(8)] == [True] * 4 + [False] * 4
    assert rows["ok.json", 2].command_id == rows["ok.json", 3].command_id != rows["ok.json", 0].command_id
    assert {r.file: r.selection for r in compile_db.select_commands(compile_db.read(spark, str(tmp_path / "ok.json"))).collect()} == {"a.cpp": "ambiguous", "b.cpp": "unique"}


def test_response_files(spark, tmp_path):
    files = {"a": b"-c x", "b": b"\xef\xbb\xbf-D\xc3\xa9", "c": b"\xff\xfe" + "-é 'y z'".encode("utf-16-le"), "d": b"\xc3\xa9", "e": b"a\0", "f": b"\xfe\xff\0a", "g": b"\xff\xfe\0\0", "h": b"\xef\xbb\xbf\xff"}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    got = {r.path.rpartition("/")[2]: (r.encoding, r.args if r.problem is None else None) for r in compile_db.read_responses(spark, str(tmp_path)).collect()}
    assert got["a"] == ("ascii", ["-c", "x"]) and got["b"] == ("utf8_bom", ["-Dé"]) and got["c"] == ("utf16le_bom", ["-é", "y z"])
    assert all(got[n][1] is None for n in "defgh")


def test_numbers_go_on(spark):
    old = spark.createDataFrame([(1, "a", None), (5, "b", "x")], "id long, k string, v string")
    new = spark.createDataFrame([("a", None), ("c", "y"), ("b", None), ("c", "y")], "k string, v string")
    got = sorted(((r.id, r.k, r.v) for r in facts.upsert(old, new, ["k", "v"]).collect()), key=str)
    assert got == [(1, "a", None), (5, "b", "x"), (6, "b", None), (7, "c", "y")]


def test_tiers(spark):
    s = spark.createDataFrame([("i1", "draw", "A::draw", "method", "()"), ("i2", "redraw_all", "A::redraw_all", "method", "()"), ("i3", "DrawAll", "B::DrawAll", "function", "()")], "symbol string, name string, qualified string, kind string, signature string")
    f = spark.createDataFrame([("src/draw.cpp",), ("src/x.cpp",)], "path string")
    got = [(r.tier, r.symbol or r.path) for r in search.page(search.find(s, f, "draw"), 0, 10).collect()]
    assert got == [(1, "i1"), (3, "i3"), (4, "src/draw.cpp")]
    assert [(r.tier, r.symbol) for r in search.find(s, f, "A::draw").filter("tier < 4").collect()] == [(2, "i1")]
    with pytest.raises(ValueError):
        search.find(s, f, " \t")
    assert shown(1.0) == "1"
