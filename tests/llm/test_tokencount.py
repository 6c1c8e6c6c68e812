import random

import regex
import tiktoken

from factloom.llm import tokencount as T


def whole(text):
    count = T.counter(T.VOCABULARY)
    return [(len(p), count(p)) for p in regex.findall(T.PATTERN, text)]


def test_edits_equal_a_fresh_count():
    rng, count = random.Random(5), T.counter(T.VOCABULARY)
    bits = ["a", "word", " ", "  ", "\n", "\n\n ", "'", "'re", "l", "l'", "12", "é", "!?", "...", " x", "日本", "\t"]
    make = lambda n: "".join(rng.choice(bits) for _ in range(n))
    for _ in range(300):
        text = make(rng.randint(0, 60))
        tree = T.Tree.of(text, count)
        for _ in range(4):
            text, _ = tree.edit(text, rng.randint(-2, len(text) + 3), rng.randint(0, 12), make(rng.randint(0, 5)), count)
            assert [tuple(x) for x in tree.levels[0].tolist()] == whole(text)
            assert (tree.characters, tree.tokens) == (len(text), sum(n for _, n in whole(text)))
            for low, high in zip(tree.levels, tree.levels[1:], strict=False):
                assert len(high) == (len(low) + 1) // 2 and high.sum(axis=0).tolist() == low.sum(axis=0).tolist()


def test_a_local_edit_encodes_little():
    count = T.counter(T.VOCABULARY)
    text = "the quick brown fox " * 2000
    tree = T.Tree.of(text, count)
    assert tree.edit(text, 20000, 3, "dog", count)[1] < 8


def test_columns(spark):
    rows = [(1, "It's a test.", [(0, 2, "They")], 9), (2, None, None, 9), (None, "", [(0, 0, "new words"), (3, 99, None)], 9), (2, "x" * 3000, [None, (None, None, None)], 9)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {T.EDITS}, n_after int")
    got = T.apply_edits(T.build(df)).collect()
    enc = tiktoken.Encoding("x", pat_str=T.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    for r, (_, before, _, _) in zip(got, rows, strict=True):
        assert r.n_before == len(enc.encode_ordinary(before or "")) and r.n_after_ == len(enc.encode_ordinary(r.text)) and r.n_after == 9
    assert [r.text for r in got] == ["They's a test.", "", "new", "x" * 3000]
    empty = df.limit(0)
    assert T.apply_edits(T.build(empty)).collect() == []


def _ranks():
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb").read().splitlines())}
