import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import pst

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def words(t):
    return (t or "").encode().translate(pst.LOWER).split() + [pst.END]


def brute(rows, depth, gain, head):
    """The model by dictionaries over whole texts."""
    held = [zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in words(t))
    every = Counter(w for _, t in rows for w in words(t))
    n, v = sum(c.values()), len(c)
    tail = {w for w in every if w not in head}
    tag = lambda w: int(pst.word_hash([w])[0]) % pst.CLASSES
    class_c, class_n = Counter(), Counter()
    for w in tail:
        if c[w]:
            class_c[tag(w)] += c[w]
            class_n[tag(w)] += 1
    mass = n + 0.1 * (v + pst.CLASSES)

    def alone(w):
        return ((class_c[tag(w)] + 0.1 * (class_n[tag(w)] + 1)) / (class_n[tag(w)] + 1) if w in tail else c[w] + 0.1) / mass

    follow = defaultdict(Counter)
    for (_, t), h in zip(rows, held):
        s = [pst.END] * depth + words(t)
        for i in range(depth, len(s)):
            for d in range(1, depth + 1):
                if not h:
                    follow[tuple(s[i - d : i])][s[i]] += 1
    kept = set()
    for x, nxt in follow.items():
        total, up = sum(nxt.values()), follow.get(x[1:])
        q = {a: up[a] / sum(up.values()) if up else alone(a) for a in nxt}
        if sum(k * math.log(k / total / q[a]) for a, k in nxt.items()) >= gain - 1e-9:
            kept |= {x[i:] for i in range(len(x))}

    def p(before, a):
        out = alone(a)
        for d in range(1, depth + 1):
            x = tuple(before[-d:])
            if x not in kept:
                break
            out = (follow[x][a] + len(follow[x]) * out) / (sum(follow[x].values()) + len(follow[x]))
        return out

    for (i, t), h in zip(rows, held):
        s = words(t)
        wide = [pst.END] * depth + s
        lp = sum(math.log10(p(wide[:k], wide[k])) for k in range(depth, len(wide)))
        yield i, h, len(s), sum(w in c for w in s), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s), lp


def check(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and all(abs(x - y) < 1e-6 * (1 + abs(y)) for x, y in zip(a[5:], b[5:])), (a, b)


def head_words(rows, most, spark):
    every = spark.createDataFrame([(w, n) for w, n in Counter(w for _, t in rows for w in words(t)).items()], "word binary, n long")
    return {bytes(r.word) for r in pst.head_of(every, most)[0].collect()} | {pst.END}


def test_query_against_brute_force(spark):
    """The registered query over a whole table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(pst.op4_lm_score(spark, SMALL).collect(), list(brute(rows, pst.DEPTH, pst.GAIN, head_words(rows, pst.HEAD_WORDS, spark))))


@pytest.mark.parametrize(("depth", "gain", "head", "bucket", "hot"), [(2, 3.0, 50, 500, 10**9), (3, 1.0, 300, 2000, 60), (2, 0.0, 10, 10**6, 20), (2, 2.0, 40, 10**6, 10**9), (1, 4.0, 1000, 300, 5)])
def test_paths_against_brute_force(spark, monkeypatch, depth, gain, head, bucket, hot):
    monkeypatch.setattr(pst, "AT_ONCE", 700)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()][:60]
    rows += [(None, None), (None, ""), (5, "The the THE"), (5, "The the THE"), (7, "x" * 5000), (10**12, "é ß 日本"), *((900 + i, "spam spam spam eggs") for i in range(30))]
    df = spark.createDataFrame([(i, t, 1.0, b"", 2) for i, t in rows], "doc_id long, text string, score double, row binary, base int").repartition(3)
    got = pst.score(df, depth=depth, gain=gain, head=head, bucket=bucket, hot=hot).collect()
    check(got, list(brute(rows, depth, gain, head_words(rows, head, spark))))


def test_held_out_score_beats_base_and_knows_copies(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    rows = pst.op4_lm_score(spark, LARGER).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    trained = {t for i, t in text.items() if zlib.crc32(str(i).encode()) % 10}
    gain = lambda r: (r.score - r.base_score) / r.n_tokens
    long = [r for r in rows if r.n_tokens > 50]
    copies = [gain(r) for r in long if text[r.doc_id] in trained]
    others = [gain(r) for r in long if text[r.doc_id] not in trained]
    assert copies and np.median(copies) > np.median(others) + 0.5


def test_order_of_words_counts(spark):
    rng = random.Random(4)
    line = "the quick brown fox jumps over the lazy dog and runs into the dark wood".split()
    texts = [" ".join(line) for _ in range(40)] + [" ".join(rng.sample(line, len(line))), " ".join(line)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    a = {r.doc_id: r for r in pst.score(df).collect()}
    assert len(a) == len(texts) and a["40"].score < a["41"].score - 5 and abs(a["40"].base_score - a["41"].base_score) < 1e-9


def test_packed_rows_come_back():
    rng = np.random.default_rng(1)
    columns = [np.where(rng.random(500) < 0.2, rng.integers(2**63, 2**64, 500, np.uint64), rng.integers(0, pst.HEAD_WORDS + 1, 500).astype(np.uint64)) for _ in range(3)]
    text, train = np.sort(rng.integers(0, 70_000, 500)), rng.random(500) < 0.5
    base, got, t, own = pst.unpack(pst.pack(2**40, columns, text, train), 3)
    assert base == 2**40 and all((x == y).all() for x, y in zip(got, columns, strict=True)) and (t == text).all() and (own == train).all()


def test_empty_table(spark):
    got = pst.score(spark.createDataFrame([], "doc_id string, text string"))
    assert got.collect() == [] and dict(got.dtypes)["doc_id"] == "string"


def test_contexts_of_several_lengths_have_numbers_of_their_own():
    """Also those of the symbol 0 alone."""
    x = pst.contexts([np.zeros(1, np.uint64)] * 3)
    assert len({int(k[0]) for k in x}) == 3 and all(int(k[0]) for k in x)


@pytest.mark.parametrize(("depth", "bucket", "hot", "gain"), [(2, 100, 15, 60.0), (3, 100, 15, 20.0)])
def test_hot_contexts_are_dealt_over_buckets(spark, depth, bucket, hot, gain):
    """Positions after a hot word are packed as others are, in parts; hot words that are retained only for longer contexts are, too."""
    rows = [(i, f"a b{i % 2} c{i % 2} " * 3 + f"a x{i % 7} y{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pst.score(df, depth=depth, gain=gain, bucket=bucket, hot=hot).collect()
    check(got, list(brute(rows, depth, gain, head_words(rows, pst.HEAD_WORDS, spark))))


def shuffled(spark):
    """Bytes that all tasks so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    every = sc.statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


@pytest.mark.parametrize(("bucket", "hot", "most"), [(2000, 10**9, 12), (2000, 4000, 14)])
def test_disk_of_many_buckets_is_bounded(spark, bucket, hot, most):
    """Many small buckets, with and without hot contexts: bytes that a token takes in all shuffles, those of its words included."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    before = shuffled(spark)
    rows = pst.score(docs, bucket=bucket, hot=hot).collect()
    assert 0 < shuffled(spark) - before < most * sum(r.n_tokens for r in rows)


def test_first_column_is_packed_by_its_few_ids():
    rng = np.random.default_rng(3)
    few = rng.integers(0, pst.HEAD_WORDS, 60).astype(np.uint64)[rng.integers(0, 60, 20_000)]
    zeros = np.zeros(20_000, np.uint64)
    assert len(pst.pack(0, [few, zeros], zeros.astype(np.int64), zeros == 0)) < 20_000
