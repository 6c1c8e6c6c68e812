import pytest
from pyspark.sql import functions as F

from factloom.functions import argv, identifier, identity
from factloom.plans import response

SPLITS = {
    "ReadFrame": ["read", "frame"], "PNGImageLoader_decodeRow": ["png", "image", "loader", "decode", "row"], "Mat4x": ["mat", "4", "x"], "UTF8Reader": ["utf", "8", "reader"],
    "kebab-case_and::Own/File.cc": ["kebab", "case", "and", "own", "file", "cc"], "größe_лист": ["größe", "лист"], " :: . ": [], "": [], "ÜberX": ["Über", "x"],
}


def test_identifier_components(spark):
    df = spark.createDataFrame([(k,) for k in SPLITS], "c string")
    assert {r.c: r.p for r in df.select("c", identifier.identifier_components(F.col("c")).alias("p")).collect()} == {k: [x.lower() if x.isascii() else x for x in v] for k, v in SPLITS.items()}


def test_runs_and_qualified_names(spark):
    df = spark.createDataFrame([("audio::Track::mix",), ("Track::mix",), ("xTrack::mix",)], "q string")
    hit = lambda q: [r.q for r in df.filter(identifier.QualifiedQuery(q).matches(F.col("q"))).collect()]
    assert hit("Track::mix") == ["audio::Track::mix", "Track::mix"] and hit("::Track::mix") == ["Track::mix"]
    for bad in ("a::", "a:::b", "::::a"):
        with pytest.raises(ValueError):
            identifier.QualifiedQuery(bad)
    one = spark.range(1)
    run = lambda a, b: one.select(identifier.contains_run(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).first()[0]
    assert run(["a", "b", "c"], ["b", "c"]) and not run(["ab", "c"], ["b", "c"]) and not run(["a"], [])
    assert one.select(identifier.qualified_name(F.array(F.lit("a"), F.lit("")), F.lit(""))).first()[0] == "a::(anonymous)::(anonymous)"


def key(**more):
    base = {"member": "repo", "kind": "function", "name": "area", "signature": "(double,double)", "owners": [("namespace", "geo", "")], "link": ("external", None, None, None, None)} | more
    owner = lambda o: F.struct(F.lit(o[0]).alias("kind"), F.lit(o[1]).alias("name"), F.lit(o[2]).alias("signature"), F.lit("none").alias("template_role"), F.lit("").alias("template_parameters"), F.lit("").alias("template_arguments"))
    names, kinds = ("type", "file", "enclosing", "anchor", "ordinal"), ("string",) * 4 + ("long",)
    owners = F.array(*map(owner, base["owners"])) if base["owners"] else F.array().cast("array<struct<kind:string,name:string,signature:string,template_role:string,template_parameters:string,template_arguments:string>>")
    return F.struct(
        F.lit(base["member"]).alias("member"), F.lit("cpp").alias("language"), F.lit(base["kind"]).alias("kind"), owners.alias("owners"), F.lit(base["name"]).alias("name"), F.lit(base["signature"]).alias("signature"),
        F.lit(more.get("role", "none")).alias("template_role"), F.lit("").alias("template_parameters"), F.lit("").alias("template_arguments"), F.struct(*(F.lit(v).cast(k).alias(n) for n, v, k in zip(names, base["link"], kinds, strict=True))).alias("linkage"),
    )


def test_stable_id_golden(spark):
    # fixed values: a key and the id that any implementation gives it
    r = spark.range(1).select(identity.stable_id(identity.serialize(key())).alias("id"), identity.problem(key()).alias("p")).first()
    assert r.id == "cm1:6a0c8ba09dac947e8c869ab49174a9ee" and r.p is None


@pytest.mark.parametrize(
    "more",
    [
        {"member": ""}, {"member": "C:/x"}, {"signature": ""}, {"kind": "class"}, {"name": ""}, {"owners": [("variable", "x", "")]}, {"owners": [("class", "", "")]}, {"owners": [("function", "f", "")]},
        {"role": "primary"}, {"role": "explicit_specialization"}, {"owners": [("namespace", "", "")]}, {"kind": "lambda", "name": ""}, {"link": ("internal", "", None, None, None)},
        {"link": ("internal", "../a.cpp", None, None, None)}, {"link": ("local", None, "x", "a", 0)}, {"link": ("local", None, "cm1:" + "0" * 32, "", 0)}, {"owners": [], "link": ("local", None, "cm1:" + "0" * 32, "a", 0)},
        {"kind": "namespace", "signature": "", "name": "n", "link": ("internal", "a.cpp", None, None, None)},
    ],
)
def test_bad_keys(spark, more):
    assert spark.range(1).select(identity.problem(key(**more))).first()[0]


@pytest.mark.parametrize(
    ("line", "args", "open_quote"),
    [
        ("cc -c a.cpp", ["cc", "-c", "a.cpp"], False), (r'cc "a b" c\ d', ["cc", "a b", "c d"], False), (r"'it\'s' x", [r"it\s x"], True), ('"open', ["open"], True), ('a"b"c', ["abc"], False), ('"" x', ["", "x"], False),
        (r'"q\"q"', ['q"q'], False), ("", [], False), ("  \t ", [], False), ("a\\", ["a\\"], False),
    ],
)
def test_gnu_lines(line, args, open_quote):
    assert argv.gnu(line) == (args, open_quote)


@pytest.mark.parametrize(
    ("line", "args", "open_quote"),
    [
        (r"cl C:\x\y.cpp", ["cl", r"C:\x\y.cpp"], False), (r'"a b" c', ["a b", "c"], False), (r'a\\\"b', [r'a\"b'], False), (r'"a\\" b', ["a\\", "b"], False), ('"a""b"', ['a"b'], False), ('"open x', ["open x"], True),
        ('""', [""], False), (r"\\srv\x", [r"\\srv\x"], False),
    ],
)
def test_windows_lines(line, args, open_quote):
    assert argv.windows(line) == (args, open_quote)


def test_drivers(spark):
    want = {"/usr/bin/clang++-17": "gnu", "C:\\VS\\CL.EXE": "msvc", "gcc-12.2": "gnu", "clang-cl": "msvc", "icc": "unknown", "x/cc": "gnu"}
    df = spark.createDataFrame([(k,) for k in want], "a string")
    assert {r.a: r.d for r in df.select("a", argv.driver(F.col("a")).alias("d")).collect()} == want


def test_cursor_and_pagination():
    b = response.Binding("find_code", "db", "p", 3, 1, response.args_digest({"query": "é"}), "w")
    c = response.encode_cursor(b, {"returned": 5})
    assert response.decode_cursor(c) == (b, {"returned": 5})
    assert all(response.decode_cursor(x) is None for x in ("", "lcq1.a.b", c[:-1] + ("A" if c[-1] != "A" else "B"), c + "x", c.replace("lcq1", "lcq2")))
    assert b.mismatch(b) is None and response.Binding(*["other", "db", "p", 3, 1, b.args, "w"]).mismatch(b) == "invalid_cursor"
    assert response.Binding("find_code", "db", "p", 4, 1, b.args, "w").mismatch(b) == "cursor_expired"
    p = response.pagination(True, 7, 2, 5, "c")
    assert (p["total"], p["omitted"], p["next_cursor"]) == (7, 0, None)
    p = response.pagination(True, 9, 2, 5, "c")
    assert (p["omitted"], p["next_cursor"], p["limit_reason"]) == (2, "c", "page_limit")
    assert response.pagination(False, 3, 2, 5, "c")["total"] is None
