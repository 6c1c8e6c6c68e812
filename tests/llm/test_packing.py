import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import packing


def check(rows, capacity):
    """Pieces of a sequence follow each other without gaps from 0 and fit."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def counts_of(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_and_are_short(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1024])
    lengths = [min(capacity, max(1, int(rng.paretovariate(0.7) * capacity / 20))) for _ in range(rng.choice([5, 300, 5000]))]
    counts = counts_of(lengths, capacity)
    found = packing.plan(counts, capacity)
    held = [0] * (capacity + 1)
    for pattern, n in found:
        assert sum(pattern) <= capacity and n > 0
        for x in pattern:
            held[x] += n
    assert held == counts
    assert packing.lower_bound(counts, capacity) <= sum(n for _, n in found) <= 1.02 * packing.lower_bound(counts, capacity) + 1


def test_many_pieces_cost_no_more():
    """A plan takes alike pieces at once: 10 to the 12th as few."""
    small = [0, *(random.Random(1).randint(0, 9) for _ in range(100))]
    found = packing.plan([10**11 * n for n in small], 100)
    assert len(found) < 1000 and sum(len(p) * n for p, n in found) == 10**11 * sum(small)


def test_exact_complements():
    """Pairs and triples that fill gaps: best fit alone would leave 3 in gaps of 4."""
    p = packing.Plan(counts_of([6, 6, 3, 3, 2, 2, 1, 1], 10), 10)
    p.best_fit(5, 10)
    p.fill_exactly(4)
    assert sorted(p.patterns()) == [((6, 2, 2), 1), ((6, 3, 1), 1)] or sorted(p.patterns()) == [((6, 3, 1), 2)]
    assert p.complement(9, 4) is None


def brute(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = t.encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_query_against_the_tokenizer_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = packing.op11_pack_sequences(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((d.doc_id, *p) for d in docs for p in brute(d.text))
    n = check(got, 1024)
    assert n <= packing.lower_bound(counts_of([r.length for r in got], 1024), 1024) + 1


ODD = [None, "", "a", "<|endoftext|>x<|endoftext|>", "é   　日本語 𝒳 '  s're\r\n\n  x\t", "tok " * 1022, "tok " * 1023, "tok " * 1024, " " * 300_000, "ab" * 200_000, "word " * 400_000, "\0\x01\x7f﻿"]


def test_odd_texts_ties_and_clashing_names(spark):
    rows = [(i if i % 3 else None, t, 1, 2, "x") for i, t in enumerate(ODD + ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int, salt int, rank string")
    got = packing.pack(packing.pieces(df))
    want = sorted(((i if i % 3 else -1, *p) for i, t in enumerate(ODD + ODD) for p in brute(t)))
    out = got.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check(out, 1024)
    clash = packing.pack(spark.createDataFrame([(3, 1, 2, 5), (3, 1, 2, 5), (7, 0, 0, 0)], "length int, offset int, sequence_id int, rank int"), 10).collect()
    assert len(clash) == 3 and {r.offset for r in clash} <= {0, 1} and len({(r.sequence_id_, r.offset_) for r in clash}) == 3 and len({r.sequence_id_ for r in clash}) == 2


def test_hot_lengths_are_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 10)
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE 1 + id % 10 END AS length")
    got = packing.pack(df, 10)
    rows = got.collect()
    assert len(rows) == 5000 and check(rows, 10) == packing.lower_bound(counts_of([r.length for r in rows], 10), 10)


def test_sequences_and_empty_table(spark):
    df = spark.createDataFrame([(i, "some text " * (37 * i)) for i in range(40)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(df, ids=True))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack(packing.pieces(df.filter("doc_id < 0"))).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(11,)], "length int"), 10)
