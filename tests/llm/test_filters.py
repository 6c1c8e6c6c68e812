"""Quality rules, mixing, chat formatting, license scans and decontamination on rows of all kinds."""

import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, decontam, licenses, mixing, quality

WORDS = "the of and lorem ipsum dolor sit amet consectetur elit sed tempor labore magna aliqua enim minim veniam quis nostrud".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (f"{rng.randrange(900)}" if rng.random() < 0.6 else "") for _ in range(n))


# --- quality -------------------------------------------------------------------------------------------------------


ABUSIVE = ["idiot", "moron", "scum"]


def features_by_hand(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bad = sum(x.lower() in ABUSIVE for x in re.findall("[A-Za-z]+", t))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}), bad


def test_features_and_verdict(spark):
    rng = random.Random(1)
    clean = [prose(rng, 80) for _ in range(5)]
    bad = ["### " * 60 + clean[0], "| ".join(WORDS * 4), " ".join(x.upper() + "!!" for x in clean[1].split()), "a line\n" * 40, clean[2] + " you idiot, you moron", "word " * 90, "", None, "\n\n \t", "é" * 4000]
    short = ["few words", "and be can and be can", "one two three four " * 2, "a line\na line"]
    texts = clean + bad + short + [prose(rng, 6000) + "\n" + clean[0], clean[3] + " scum"]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_abusive"]
    got = df.select("doc_id", quality.features(F.col("text"), names, {"n_abusive": quality.n_abusive(ABUSIVE)}).alias("f")).collect()
    assert {r.doc_id: tuple(r.f[n] for n in names) for r in got} == {i: features_by_hand(t) for i, t in enumerate(texts)}
    kept = {r.doc_id for r in quality.judge(df, abusive=ABUSIVE).filter("kept_").collect()}
    assert kept == set(range(5)) | set(range(5 + len(bad), len(texts)))
    assert quality.judge(df.limit(0)).collect() == []


def test_order_changes_no_verdict(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(prose(rng, rng.randint(1, 120)) + "#|" * rng.randint(0, 20),) for _ in range(40)], "text string")
    verdicts, more = [], {"n_abusive": quality.n_abusive(ABUSIVE)}
    for rules in (quality.STAGE_RULES, quality.STAGE_RULES[::-1]):
        verdicts.append([r.k for r in df.select(quality.cascade(list(rules), lambda r: quality._bound(r, F.col("text"), more)).alias("k")).collect()])
    assert verdicts[0] == verdicts[1] and len(set(verdicts[0])) == 2
    assert {r.name for r in quality.order_rules(df, more=more)} == {r.name for r in quality.RULES}


def test_costly_rules_that_reject_little_come_last(spark):
    df = spark.createDataFrame([(f"x {i} " * 200,) for i in range(300)], "text string")
    slow = quality.Rule("slow", ("n_repeat_words",), lambda f: f["n_repeat_words"] < 0, "")
    quick = quality.Rule("quick", ("n_symbols",), lambda f: f["n_symbols"] < 0, "")
    never = quality.Rule("never", ("n_symbols",), lambda f: f["n_symbols"] >= 0, "")
    assert [r.name for r in quality.order_rules(df, (never, slow, quick))] == ["quick", "slow", "never"]


def test_abusive_words_come_from_labels(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) + (f" {rng.choice(ABUSIVE)}, {rng.choice(ABUSIVE)}" if i % 5 == 0 else "")) for i in range(200)] + [(None, "idiot"), (7000, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (7000, 0), (8000, 1), (3, None)], "doc_id long, toxic int")
    assert quality.abusive_words(docs, labels) == sorted(ABUSIVE)
    assert quality.abusive_words(docs, labels.limit(0)) == quality.abusive_words(docs.limit(0), labels) == []


def test_query_skips_what_the_cascade_does_not_reach(spark):
    plan = quality.op5_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    case = plan[plan.index("CASE WHEN") :]
    assert "Lu}" in case and "Lu}" not in plan[: plan.index("CASE WHEN")]


# --- mixing --------------------------------------------------------------------------------------------------------


def test_rates_and_counts(spark):
    rows = [(i, "big" if i % 3 else ("small" if i % 2 else None), "t", 7) for i in range(3000)] + [(9000 + i, "rare", "r", 7) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    n = Counter(r.source for r in mixing.mix(df).collect())
    assert all(abs(n[s] - len(rows) / 4) < 6 * (len(rows) / 4) ** 0.5 for s in ("big", "small", None))
    assert n["rare"] > 400  # a mean of 375 copies for each of the two
    again = mixing.mix(df)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, mixing.mix(df).collect())) and again.columns == ["doc_id", "source", "text", "copy", "copy_", "shuffle_key"]
    few = Counter(r.source for r in mixing.mix(df, {"big": 3, "small": 1}).collect())
    assert set(few) == {"big", "small"} and 2.5 < few["big"] / few["small"] < 3.5
    assert mixing.mix(df.limit(0)).collect() == []


def test_poisson_is_inverted(spark):
    got = spark.createDataFrame([(0.5,), (3.0,), (16.0,)], "m double").select("m", mixing.distribution(F.col("m")).alias("c")).collect()
    for r in got:
        assert r.c == sorted(r.c) and abs(r.c[-1] - 1) < 1e-12
        assert abs(sum(1 - x for x in r.c) - r.m) < 1e-9  # the mean


def test_mix_with_clashing_names_and_null_ids(spark):
    names = ["source_", "draws", "table", "draw", "u", "n", "number", "ident", "shuffle_key", "copy"]
    rows = [(None if i % 2 else "x", "s", f"text {i}", *range(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id string, source string, text string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.mix(df).collect()
    assert 1700 < len(got) < 2300 and all(tuple(r[n] for n in names) == tuple(range(10)) for r in got)
    times = Counter(r.text for r in got)
    assert len(set(times.values())) > 3  # null and repeated ids have draws of their own


# --- chat ----------------------------------------------------------------------------------------------------------


def test_parts_become_placeholders_and_texts_come_back(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    nasty = "~e<|end|>[INST]~~l</s><|image_0|>\n<|turn|>user<|body|>"
    rows = [
        (1, 0, "user", [part("text", nasty), part("image", None, "a.png", 2), part("image", None, "b.png"), part("audio", None, "c.wav", 10)]), (1, 1, "assistant", [part("text", "ok ~ [x]"), part("document", None, "d.pdf", 3)]),
        (2, None, None, None), (2, 1, "assistant", []), (2, 2, "we<ird\nrole", [part(None, "x"), part("odd", None)]), (None, 0, "assistant", [part("text", nasty)]), (3, 5, "user", [part("text", "tie b")]), (3, 5, "user", [part("text", "tie a")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.chat_format(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), chat.loss_spans(F.col("formatted")))).collect()}
    one = got[1]
    assert [tuple(a) for a in one.attachments] == [("image", "a.png"), ("image", "b.png"), ("audio", "c.wav"), ("document", "d.pdf")]
    assert one.attachment_tokens == 3 * 576 + 10 * 50 + 3 * 1500
    assert one.formatted.count("<|turn|>") == 2 and "<|image_1|><|audio_0|><|end|>" in one.formatted
    assert one.turns[0].text == nasty + "<|image_0|><|image_1|><|audio_0|>" and one.loss == "ok ~ [x]<|document_0|>"
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", ""), ("we<ird\nrole", "x")] and got[2].loss == ""
    assert got[None].loss == nasty == got[None].turns[0].text and [t.text for t in got[3].turns] == ["tie a", "tie b"]
    assert chat.chat_format(df.limit(0)).collect() == []


# --- licenses ------------------------------------------------------------------------------------------------------


LICENSES = json.loads(licenses.TEXTS.read_text())


def test_licenses_are_found_and_others_left(spark):
    rng = random.Random(4)
    mit = LICENSES["mit-text"]
    texts = [f"{prose(rng, rng.randint(0, 300))} {t.upper() if i % 2 else t} {prose(rng, rng.randint(0, 300))}" for i, t in enumerate(LICENSES.values())]
    near = " ".join("people" if i % 60 == 30 else x for i, x in enumerate(mit.split()))
    texts += [prose(rng, 500), None, "", "all rights", " ".join(mit.split()[:9]), near, mit + "\n\n" + mit, prose(rng, 9000) + " " + mit]
    df = spark.createDataFrame([(i, t, "x", 1, "w") for i, t in enumerate(texts)], "doc_id long, text string, licenses string, index int, name string")
    found = licenses.scan(df)
    got = {r.doc_id: {x.name: x.containment for x in r.licenses_} for r in found.collect()}
    assert found.columns == [*df.columns, "licenses_"]
    for i, name in enumerate(LICENSES):
        assert got[i].get(name) == 1.0, name
    k = len(LICENSES)
    assert [got[k + i] for i in range(5)] == [{}] * 5
    assert 0.8 <= got[k + 5]["mit-text"] < 1 and got[k + 6] == got[k + 7] == {"mit-text": 1.0}
    assert licenses.scan(df.limit(0)).collect() == []


def test_templates_are_a_table(spark):
    rows = [("a", "one two three four five six seven"), ("a", "zz"), (None, "x y"), ("b", None), ("c", "..."), ("d", "x y")]
    templates = spark.createDataFrame(rows, "name string, text string")
    df = spark.createDataFrame([(1, "it was one two three four five six seven x Y z")], "doc_id long, text string")
    assert [x.name for x in licenses.scan(df, templates=templates).first().licenses] == ["a", "d"]
    assert licenses.scan(df, templates=templates.limit(0)).first().licenses == []


def test_minima_retrieve(spark):
    """How often windows that hold a template, or 80 % of it, share a value with it."""
    rng = random.Random(6)
    rows = []
    for n in (1, 2, 5, 17, 100, 256):
        for _ in range(60):
            own = [f"t{rng.random()}" for _ in range(n)]
            size = 2 * licenses.size_class(n)
            rows.append((own, [f"w{rng.random()}" for _ in range(size - n)], own[: -(-n * 4 // 5)]))
    df = spark.createDataFrame(rows, "t array<string>, w array<string>, part array<string>")
    of = lambda c: licenses.minima(F.transform(c, lambda s: F.xxhash64(s)))
    got = df.select(F.arrays_overlap(of(F.col("t")), of(F.concat("t", "w"))).alias("whole"), F.arrays_overlap(of(F.col("t")), of(F.concat("part", "w"))).alias("most")).collect()
    assert sum(r.whole for r in got) >= 0.99 * len(got) and sum(r.most for r in got) >= 0.98 * len(got)


def test_many_templates(spark):
    """2,000 templates of several classes: each text finds its own and no other."""
    rng = random.Random(12)
    made = {f"t{k:04}": " ".join(f"w{rng.randint(0, 40_000)}" for _ in range(rng.choice([1, 3, 8, 30, 90]))) for k in range(2000)}
    asked = rng.sample(sorted(made), 40)
    texts = [f"before it {made[n]} and after it" for n in asked] + ["of no template", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [x.name for x in r.licenses] for r in licenses.scan(df, templates=spark.createDataFrame(sorted(made.items()), "name string, text string")).collect()}
    assert all(n in got[i] for i, n in enumerate(asked)) and got[40] == got[41] == [] and sum(map(len, got.values())) < 60


def test_whole_licenses_of_large_classes(spark):
    """Apache, GPL and Mozilla texts as they stand, with a fifth of the words of one changed at its end, and half of one."""
    gpl = LICENSES["gpl-3.0-text"].split()
    texts = [LICENSES["apache-2.0-text"], "x " * 5000 + LICENSES["mpl-2.0-text"].upper(), " ".join(gpl[: len(gpl) * 85 // 100]) + " other" * 900, " ".join(gpl[: len(gpl) // 2])]
    found = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.doc_id: {x.name for x in r.licenses} for r in found.collect()}
    assert "apache-2.0-text" in got[0] and "mpl-2.0-text" in got[1] and "gpl-3.0-text" in got[2] and "gpl-3.0-text" not in got[3]


# --- decontamination -----------------------------------------------------------------------------------------------


def words_by_hand(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits_by_hand(docs, items):
    windows = defaultdict(set)
    for name, t in items:
        w = words_by_hand(t)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows[tuple(w[i : i + size])].add(name or "")
    for t in docs:
        w, hit, own = words_by_hand(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    own |= windows[tuple(w[i : i + size])]
        yield len(w), len(hit), sorted(own)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_hits_equal_brute_force(spark, block):
    rng = random.Random(6)
    items = [(f"i{k}", prose(rng, rng.randint(11, 40)) + ("." if k % 2 else " Ünï")) for k in range(20)] + [("short", "four words, only HERE"), ("none", "... !"), ("null", None), (None, "an item without any name of its own at all"), ("i3", "repeated id " + prose(rng, 12)), ("the", "the the the the the the the the the the the the")]
    docs = [prose(rng, rng.randint(0, 200)) for _ in range(25)] + [None, "", "the " * 500, "FOUR-words...only here", prose(rng, 20000)]
    for i in range(0, 25, 2):
        t = rng.choice(items[:20])[1].split()
        a = rng.randint(0, len(t) - 9)
        docs[i] = f"{docs[i]} {' '.join(t[a : a + rng.randint(8, 15)])}, {docs[i][:99]}"
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(docs)], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.contamination(df, bench, block_bytes=block).select("doc_id", "hits_", decontam.covered(F.col("hits_.spans")).alias("n")).collect()
    assert {r.doc_id: (r.hits_["n_words"], r.n, r.hits_["items"]) for r in got} == dict(enumerate(hits_by_hand(docs, items)))
    assert decontam.contamination(df.limit(0), bench, block_bytes=block).collect() == []
    assert all(r.hits_["items"] == [] for r in decontam.contamination(df, bench.limit(0)).collect())


def test_large_benchmarks_with_equal_items_and_long_texts(spark):
    """A benchmark of many times what is broadcast: equal items, other column names, a text over several chunks."""
    rng = random.Random(16)
    same = prose(rng, 30)
    items = [(k, same if k < 40 else prose(rng, rng.randint(5, 30))) for k in range(300)]
    long = " ".join(prose(rng, 2000) for _ in range(130)) + " " + items[200][1] + " " + same
    assert len(long) > 1.2 * decontam.CHUNK
    docs = [long, same[:-1], items[77][1].upper(), items[78][1] + " " + items[79][1], "nothing of it"] * 2
    bench = spark.createDataFrame(items, "id long, body string")
    got = decontam.contamination(spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "k long, text string"), bench, block_bytes=200, item="id", item_text="body")
    want = hits_by_hand(docs, [(str(k), t) for k, t in items])
    assert {r.k: (r.hits["n_words"], r.n, r.hits["items"]) for r in got.withColumn("n", decontam.covered(F.col("hits.spans"))).collect()} == dict(enumerate(want))
