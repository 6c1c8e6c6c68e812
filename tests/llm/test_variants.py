import random
import re
import zlib
from collections import Counter

import pytest
from oracle import same

from factloom.llm import variants

SMALL = "/root/testdata/sf0.001"


def one_letter(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """n: count by word."""
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_letter(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, "-" if form[w] is None else form[w], root(w), n[w], len(near[w]), -1 if form[w] is None else n[form[w]]) for w in n)


def shown(df):
    return sorted((r.word, "-" if r.form is None else r.form, r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def fixture(seed):
    rng = random.Random(seed)
    letters = "abcdeé×Àÿ"
    out = {}
    for _ in range(120):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 8, 9, 46, 47, 48, 49, 50, 51, 120])))
        for _ in range(rng.randint(1, 6)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w[::-1]])
            out[w] = rng.choice([3, 4, 6, 8, 16, 16, 100, 10**12])
    for k in range(28, 40):  # counts beyond what the trie tells apart
        out |= {"a" * k: k, "a" * k + "b": 3, "b" + "a" * k: 6, "a" * 35 + "b" * k: 12, "a" * 36 + "b" * k: 24, "b" * k + "c" * (70 - k): 4}
    return out


@pytest.mark.parametrize("shard", [variants.SHARD, 40, 3])
def test_against_brute_force(spark, shard):
    """Also with shards made of many levels and with salts."""
    n = fixture(shard)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert shown(variants.variants(df, shard)) == brute(n)


def test_blocks_and_candidates(spark, monkeypatch):
    """One leaf with many anagrams, searched in small pieces."""
    monkeypatch.setattr(variants, "BLOCK", 7)
    monkeypatch.setattr(variants, "CANDIDATES", 11)
    rng = random.Random(0)
    words = {"".join(rng.sample("aabbccde", 8)) for _ in range(60)} | {"".join(rng.choices("bcdfgm", k=6)) for _ in range(200)}
    column = variants.pa.array(sorted(words))
    own = variants.Words(column)
    found = [(column[i].as_py(), column[j].as_py()) for x, y in variants.Trie(own, 0).search(own, variants.np.zeros(len(words), variants.np.int8)) for i, j in zip(x, y, strict=True)]
    assert len(found) == len(set(found)) and {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if a < b and one_letter(a, b)}


def test_equals_sql(spark):
    same(variants.op13_spelling_variants(spark, SMALL), variants.SQL["op13_spelling_variants"], SMALL)


TEXTS = [None, "", "Straße straße STRASSE", "ÀÉÎõü÷×ÿ xÀÉÎõü÷×ÿ", "日本abcde語ghijkl—mnopqĀrstuv", "ab cd efg", "Hello hello hellos HELLO! hell", "x" * 3_000_000, "hello " * 50_000, "naïve naive naïves café cafés"]


def test_words_against_a_plain_count(spark):
    rows = [(i if i % 4 else None, t, "w", 1) for i, t in enumerate(TEXTS * 3)]
    got = variants.words(spark.createDataFrame(rows, "doc_id long, text string, word string, n int"), times=1, slip=3)
    want = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            k = h % len(run)
            want[run if h % 3 else run[:k] + run[k + 1 :]] += 1
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 5}


def test_roots_of_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(40)] + [(f"v{k}", "w3") for k in range(5)]
    got = {r.word: r.root for r in variants.last_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w40" for w, _ in chain}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.words(df)).collect() == []
