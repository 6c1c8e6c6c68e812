import json

from test_store import contributions

from factloom import cli
from factloom.sources import store


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path)
    batch = contributions(spark, "u1", "u2")
    store.publish(spark, root, batch)
    e = batch["evidence"].join(batch["symbol"].select("unit", "symbol", "name").withColumnRenamed("symbol", "target"), ["unit", "target"]).first()

    def said(*more):
        code = cli.main([root, *more])
        return code, json.loads(capsys.readouterr().out)

    code, found = said("find", e.name)
    assert code == 0 and found["result"]["results"][0]["tier"] == 1
    code, calls = said("callers", e.target)
    assert code == 0 and e.source in {r["symbol"]["id"] for r in calls["result"]["records"]}
    assert said("profiles")[1]["result"] == {"profiles": ["default"]} and found["profile"] == "default" and found["fact_generation"] == 1
    code = lambda *more: json.loads((cli.main(list(more)), capsys.readouterr().out)[1])["diagnostics"][0]["code"]
    assert code(str(tmp_path / "none"), "find", "x") == "db_missing" and code(root, "--profile", "other", "find", "x") == "unknown_profile"
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    assert code(str(tmp_path / "other"), "find", "x") == "db_foreign"
    store.exclude(spark, root, [r.path for r in batch["location"].select("path").distinct().collect()])
    assert said("find", e.name)[1]["result"]["results"] == []
    store.exclude(spark, root, [])
    assert said("find", e.name)[1]["result"]["results"]
    assert said("file", "none.h")[0] == 1 and said("find", " ")[1]["diagnostics"][0]["code"] == "empty_query"
