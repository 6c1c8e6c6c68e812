import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from factloom.llm import suffix


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), len(suffix.runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéfg") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    docs = [text(rng.randint(0, 120)) for _ in range(30)]
    for i in range(0, 30, 3):  # shared passages at other places, some cut short
        s = rng.choice(shared)
        docs[i] = docs[i][: rng.randint(0, 50)] + s[rng.randint(0, 40) :] + docs[i][50:]
    docs += [docs[0], docs[0], docs[5] + "x" + docs[5], None, "", "a", "the " * 900, "ab" * 400, "z" * 250, text(6000)]
    near = docs[1] + shared[0]
    return docs + [near[:150] + "QQ" + near[152:], near]


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_suffix_array(n):
    rng = random.Random(n)
    for k in (1, 2, 5, 4000):
        t = [rng.randint(1, k) for _ in range(n)] + [0]
        assert suffix.suffix_array(np.array(t), k + 1).tolist() == sorted(range(n + 1), key=lambda i: t[i:])


def test_sorts_recursively_at_every_size():
    """A shard of 1 MB of documents: the string of names is sorted in the same way, down to the end."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    raw = "\n".join(x or "" for x in texts).encode()[:1_000_000]
    t = np.r_[np.frombuffer(raw, np.uint8).astype(np.int64) + 2, 0]
    sizes, plain = [], suffix.suffix_array

    def counted(x, size):
        sizes.append(len(x))
        return plain(x, size)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix, "suffix_array", counted)
        sa = counted(t, 258)
    assert len(sizes) > 4 and sizes[1] > 100_000 and sizes[-1] < 1000
    assert np.bincount(sa).max() == 1 and not hasattr(suffix, "_by_doubling")
    at = np.random.default_rng(0).integers(1, len(sa), 20_000)
    body = raw + b"\0"
    assert all(body[a : a + 5000] <= body[b : b + 5000] for a, b in zip(sa[at - 1].tolist(), sa[at].tolist(), strict=True))


def test_runs_and_periods():
    for t in ([2] * 3000, [2, 3] * 1500, [3] * 2000 + [2] * 2000, list(range(900, 1, -1)) * 2, [5, *[2] * 1000, 7, *[2] * 1000, 3]):
        got = suffix.suffix_array(np.array([*t, 0]), 1000)
        assert got.tolist() == sorted(range(len(t) + 1), key=lambda i: [*t, 0][i:])


def test_query_against_brute_force(spark):
    """The registered query over a whole table."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows], 200), strict=True)}
    got = suffix.op2_suffix_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("hot", [suffix.HOT_BYTES, 600])
def test_against_brute_force(spark, hot):
    docs = fixture()
    df = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, kept string")
    got = suffix.without_repeats(df, hot_bytes=hot).collect()
    want = Counter(zip(docs, brute(docs, 200), strict=True))
    assert Counter((r.text, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_).hexdigest())) for r in got) == want
    assert all(r.kept == "x" for r in got)


def shared_gram(n):
    """n texts around one 32-byte gram of least hash; the first two share a passage of 220 bytes around it."""
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    grams = [word(32) for _ in range(30_000)]
    hashes = suffix.least_grams(np.frombuffer("".join(grams).encode(), np.uint8), 200, 32)[1][::32]
    gram = grams[int(np.argmin(hashes[: len(grams)] & ~suffix.PLACE))]
    passage = word(94) + gram + word(94)
    return [word(50) + (passage if i < 2 else word(94) + gram + word(94)) + word(50) for i in range(n)]


@pytest.mark.parametrize("hot,n", [(3000, 8), (3000, 9), (3000, 10), (3000, 11), (suffix.HOT_BYTES, 6500)])
def test_hot_and_cold_are_each_others_complement(spark, hot, n):
    """Also where a hash has just so many snippets that their mean size decides whether it is hot."""
    docs = shared_gram(n)
    got = suffix.remove_repeats(spark.createDataFrame([(t,) for t in docs], "text string"), hot_bytes=hot).agg({"n_removed": "sum"}).first()[0]
    assert got == 440


def test_empty_table(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_are_counted_where_texts_are(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(suffix, "stash", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or (_ for _ in ()).throw(StopIteration))
    df = spark.createDataFrame([("a " * 300,), ("a " * 300,)], "text string")
    try:
        suffix.remove_repeats(df)
    except StopIteration:
        pass
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1


def test_snippets_are_named_without_a_shuffle(spark, monkeypatch):
    """Texts are cut where they are; only those of chosen snippets and those that lose bytes are joined."""
    plans, plain = {}, suffix.stash
    monkeypatch.setattr(suffix, "stash", lambda df, what: plans.setdefault(what, []).append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, what))
    df = spark.createDataFrame([(t,) for t in fixture()[:12]], "text string")
    suffix.remove_repeats(df).collect()
    assert len(plans["placed"]) == 1 and "Exchange" not in plans["placed"][0]


def test_only_parts_that_another_snippet_shares_are_sorted():
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k)).encode()
    gram, left, right = word(32), word(168), word(168)
    whole = left + gram + right
    group = [(168, 1, whole), (168, 1, word(84) + whole[84:]), (168, 1, word(168) + gram + word(168))]
    ranges = suffix._pieces(group, 200, 32)
    starts = [[s for lo, hi in r for s in range(lo, hi)] for r in ranges]
    assert starts[0] == starts[1] and set(range(84, 169)) <= set(starts[0]) and min(starts[0]) > 84 - suffix.WIDTHS[0] and not starts[2]
