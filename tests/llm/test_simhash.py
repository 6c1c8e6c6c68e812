import random

import numpy as np
import xxhash

from factloom.llm import simhash as S


def near_pairs(rng, n):
    """Fingerprints of which many lie up to 4 bits apart, in chains."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for i in range(n // 2):
        x = out[rng.randrange(len(out))]
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        out.append(x)
    return out


def brute(fps, radius=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in set(fps):
        for b in set(fps):
            if a < b and bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_every_pair_within_the_radius_collides():
    masks, rng = S.masks(), random.Random(1)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(d & m == 0 for m in masks)
    assert len(masks) == 15 and all(30 <= bin(m).count("1") <= 38 for m in masks)


def test_components_equal_brute_force_in_small_and_split_buckets(spark):
    rng = random.Random(2)
    fps = near_pairs(rng, 150)
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << b) for b in range(64)] + [centre ^ 3 ^ (1 << b) for b in range(5, 30)]
    want = brute([signed(f) & (2**64 - 1) for f in fps])
    rows = [(i, signed(f)) for i, f in enumerate(fps)] + [(1000 + i, signed(f)) for i, f in enumerate(fps[:40])]
    for block in (1024, 16):
        links = S.links(spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long"), block=block)
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in links.collect())
    got = {r.fp: r.least for r in S.groups(spark.createDataFrame(rows, "id long, fp long")).collect()}
    least = {}
    for i, f in enumerate(fps):
        least[want[f]] = min(i, least.get(want[f], i))
    assert got == {signed(f): least[want[f]] for f in fps}


def test_split_buckets_lose_no_link(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)})
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    from factloom.llm.common import components

    got = components(S.links(df, block=16)).collect()
    assert len(got) == len(fps) and len({r.root for r in got}) == len(set(brute(fps).values()))


def test_fingerprint_by_hand():
    w = "The quick  Brown\tfox jumps".lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert S.simhash("The quick  Brown\tfox jumps", 3) == want
    assert S.simhash(None, 3) == S.simhash(" \n", 3) == 0 and S.simhash("A b", 3) == xxhash.xxh64_intdigest("a b", 42)


def test_rows_of_all_kinds(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text, 1), (2, text.replace("w7 ", "w8 "), 1), (2, text, 1), (None, None, 1), (None, "", 2), (9, "  ", 2), (None, "other words here", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint long")
    got = sorted(((r.doc_id, r.text, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert [x[2] for x in got if x[1] and x[1].startswith("w0")] == [2, 2, 2] and {x[2] for x in got if not (x[1] or "").strip()} == {9}
    kept = S.first_of_groups(df).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 2, 9] and kept[0].fingerprint in (1, 2, 3)
    assert S.near_duplicates(df.limit(0)).collect() == [] == S.first_of_groups(df.limit(0)).collect()
    assert np.all([c in df.columns for c in S.first_of_groups(df).columns])
