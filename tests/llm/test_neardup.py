import random

import corpus_pipeline as P

from factloom.llm import neardup as N
from factloom.llm.common import components

SMALL = "/root/testdata/sf0.001"


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts, least=0.8):
    """The least index of each text's component, from all pairs."""
    root, g = list(range(len(texts))), [grams(t) for t in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(g[i], g[j]) >= least:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def planted(rng):
    """Texts with copies just above 0.80, 0.85, 0.9 and 0.97, and just below 0.8."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for n in (60, 120, 400):
        for least in (0.8, 0.85, 0.9, 0.97, 0.75):
            for _ in range(4):
                base = [word() for _ in range(n)]
                # words replaced at the end: a copy's similarity falls in small steps
                k = next(k for k in range(n, -1, -1) if jaccard(grams(" ".join(base)), grams(" ".join(base[: n - k] + [f"y{i}" for i in range(k)]))) >= least)
                texts += [" ".join(base), " ".join(base[: n - k] + [word() for _ in range(k)])]
    return texts


def test_planted_pairs_against_brute_force(spark):
    texts = planted(random.Random(5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert sum(w != i for i, w in enumerate(want)) == 48
    assert sorted(r.doc_id for r in P.near_dedup(spark, df, SMALL).collect()) == sorted(set(want))


def test_chains_and_split_buckets(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):  # a chain whose ends are far apart, and copies that share buckets without being linked
        base[i * 5 : i * 5 + 5] = [f"z{i}_{j}" for j in range(5)]
        texts.append(" ".join(base))
    for _ in range(40):
        w = [f"v{i}" for i in range(200)]
        for _ in range(9):
            w[rng.randrange(200)] = f"u{rng.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (128, 8):
        assert sorted(r.doc_id for r in N.first_of_groups(df, block=block).collect()) == sorted(set(brute(texts)))
    at = {N.xxhash.xxh3_128_digest(t.encode()): i for i, t in enumerate(texts)}
    found = N.links(df, N.signed(df), block=8).collect()
    assert all(jaccard(grams(texts[at[bytes(r.a)]]), grams(texts[at[bytes(r.b)]])) >= 0.8 for r in found) and components(N.links(df, N.signed(df))).count() > 50


def test_rows_of_all_kinds(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text, 1), (2, text.replace("w7 ", "w8 "), 1), (2, text, 1), (None, None, 1), (None, "", 2), (9, "  ", 2), (None, "other words here", 3), (None, "Other words  here", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long")
    kept = N.first_of_groups(df).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 2, 9] and N.first_of_groups(df).columns == df.columns
    assert N.first_of_groups(df.limit(0)).collect() == []


def test_covering_tables():
    rng = N.np.random.default_rng(3)
    a = rng.integers(0, 2**16, (200, N.SKETCHES * N.PLACES)).astype(N.np.uint16)
    b = a.copy()
    for row in b.reshape(200, N.SKETCHES, N.PLACES):  # every sketch differs in RADIUS places
        for s in row:
            s[rng.choice(N.PLACES, N.RADIUS, replace=False)] ^= 1
    shared = (N.table_keys(a) == N.table_keys(b)).reshape(200, N.SKETCHES, N.PLACES)
    assert shared.any(axis=2).all() and not shared.all(axis=2).any()
    assert len(set(N.table_keys(a[:1] * 0)[0])) == N.SKETCHES * N.PLACES


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "SET_BYTES", 20_000)  # sets of a group in several blocks
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        w = base[:]
        for i in rng.sample(range(100), rng.choice((1, 2, 3))):
            w[i] = f"u{rng.random()}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(brute(texts)))
    assert 1 < len(want) < 150
    for block in (1024, 16):
        assert sorted(r.doc_id for r in N.first_of_groups(df, block=block).collect()) == want
