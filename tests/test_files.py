import hashlib

from factloom.sources import files


def test_probe_and_withheld(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for n, b in (("src/a.cpp", b"a"), ("src/b.cpp", b"b"), ("한글.h", b"")):
        (tmp_path / n).write_bytes(b)
    seen = files.scan(spark, str(tmp_path)).cache()
    assert {(r.path, r.size, r.hash) for r in seen.collect()} >= {("src/a.cpp", 1, hashlib.sha256(b"a").hexdigest()), ("src/b.cpp", 1, hashlib.sha256(b"b").hexdigest())}
    recorded = spark.createDataFrame([("src/a.cpp",), ("gone.h",), ("src/b.cpp",)], "path string")
    assert {r.path: bool(r.current) for r in files.probe(recorded, seen).collect()} == {"src/a.cpp": True, "gone.h": False, "src/b.cpp": True}
    excluded = spark.createDataFrame([("src/b.cpp",)], "path string")
    assert {r.path for r in files.withheld(excluded, recorded, seen).collect()} == {"gone.h", "src/b.cpp"}
