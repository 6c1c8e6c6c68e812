"""The pipeline's stages: what each has to drop goes, clean documents stay."""

import random

import corpus_pipeline as P

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    shared, base = prose(80), prose(400)
    rows = {i: prose(150) for i in range(20)}
    rows |= {100: "junk ### " * 80, 101: "too short", 102: None, 103: ""}
    rows |= {200: base, 201: base, 202: base.replace(base.split()[200], "changed", 1)}
    rows |= {300: f"{prose(100)} {shared} {prose(60)}", 301: f"{prose(90)} {shared} {prose(70)}"}
    rows |= {400: f"{prose(100)} {item} {prose(60)}"}
    made = [(i, t, "en", "a" if i % 2 else "b", None if t is None else len(t)) for i, t in rows.items()]
    return spark.createDataFrame(made + [(None, prose(120), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), shared


def test_stages(spark):
    docs, shared = corpus(spark)
    ids = lambda d: {r.doc_id for r in d.collect()}
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "suffix_dedup", "decontaminate", "mix_sources"]
    clean = set(range(20)) | {None}
    a = stages["quality_rules"](spark, docs, SMALL).cache()
    clean |= {101}  # a short text may be a clean one
    assert ids(a) == clean | {200, 201, 202, 300, 301, 400} and a.columns == COLUMNS
    b = stages["near_dedup"](spark, a, SMALL).cache()
    assert ids(b) == clean | {200, 300, 301, 400} and b.columns == COLUMNS
    c = stages["suffix_dedup"](spark, b, SMALL).cache()
    text = {r.doc_id: r for r in c.collect()}
    assert set(text) == ids(b) and c.columns == COLUMNS and all(shared[9:-9] not in text[i].text and len(text[i].text) == text[i].n_chars > 100 for i in (300, 301))
    assert all(text[i].text == r.text for i, r in ((r.doc_id, r) for r in b.collect()) if i in clean)
    d = stages["decontaminate"](spark, c, SMALL).cache()
    assert ids(d) == ids(c) - {400} and d.columns == COLUMNS
    e = stages["mix_sources"](spark, d, SMALL)
    assert ids(e) <= ids(d) and set(COLUMNS) < set(e.columns)
    none = docs.limit(0)
    assert all(f(spark, none, SMALL).collect() == [] for f in stages.values())


def test_run(spark):
    rows = P.run(spark, SMALL)
    assert set(COLUMNS) < set(rows.columns) and rows.count() > 0
