import random

import numpy as np
import pyarrow as pa

from factloom.llm import common


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 500 + i) for i in range(30)] + [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_stay_whole():
    rows = [(k, i) for k in range(9) for i in range((k * 7) % 5 + 1)]
    batches = [pa.RecordBatch.from_pydict({"k": [r[0] for r in rows[i : i + 3]], "i": [r[1] for r in rows[i : i + 3]]}) for i in range(0, len(rows), 3)]
    for limit in (1, 4, 100):
        got = list(common.sorted_groups(iter(batches), ["k"], limit))
        assert [tuple(x.values()) for t in got for x in t.to_pylist()] == rows
        keys = [set(t.column("k").to_pylist()) for t in got]
        assert sum(map(len, keys)) == 9


def test_text_bytes():
    a = pa.array(["x", None, "", "é"]).slice(1)
    body, at = common.text_bytes(a)
    assert body.tobytes() == "é".encode() and at.tolist() == [0, 0, 0, 2]
    assert list(common.slices(np.array([0, 5, 6, 7, 30]), 6)) == [(0, 2), (2, 3), (3, 4)]
