"""Queries without SQL, over whole tables, against brute force."""

from collections import Counter, defaultdict

import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from factloom.llm import simhash, tokencount

SMALL = "/root/testdata/sf0.001"


def rows_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def fingerprint(text):
    """Bit by bit."""
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_op6_equals_all_pairs(spark):
    rows = [(i, fingerprint(t)) for i, t in rows_of(spark)]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op6_simhash_dedup(spark, SMALL).collect()}
    assert got == {(i, f"{f:016x}", find(i)) for i, f in rows} and len({find(i) for i, _ in rows}) < len(rows)


def test_op3_equals_a_fresh_count(spark):
    ranks = tokencount.counter(tokencount.VOCABULARY)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    edits = {r.doc_id: r.e for r in docs.select("doc_id", tokencount.sample_edits(F.col("doc_id"), F.col("text")).alias("e")).collect()}
    count = lambda t: sum(ranks(p) for p in regex.findall(tokencount.PATTERN, t))
    got = {r.doc_id: r for r in tokencount.op3_token_counts(spark, SMALL).select("doc_id", "n_before", "n_after", "n_pretokens", "n_encoded").collect()}
    rows = rows_of(spark)
    assert len(got) == len(rows)
    for i, text in rows:
        new = text or ""
        for e in edits[i]:
            at = min(e.start, len(new))
            new = new[:at] + e.put + new[at + e.length :]
        r = got[i]
        assert (r.n_before, r.n_after, r.n_pretokens) == (count(text or ""), count(new), len(regex.findall(tokencount.PATTERN, new)))
        assert 0 < r.n_encoded <= max(60, r.n_pretokens)


def test_op3_vocabulary_is_that_of_a_whole_encoder():
    """Counts of pieces add up to what an encoder of whole texts gives."""
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokencount.VOCABULARY, "rb").read().splitlines())}
    e = tiktoken.Encoding("x", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ranks_of = tokencount.counter(tokencount.VOCABULARY)
    for t in ("It's a test, isn't it?", "déjà vu 2024\n\n  x", "日本語 text", ""):
        assert len(e.encode_ordinary(t)) == sum(ranks_of(p) for p in regex.findall(tokencount.PATTERN, t))


def test_pipeline_equals_its_stages_by_hand(spark):
    """run() over a whole table against plain Python, stage by stage."""
    import hashlib
    import math

    import corpus_pipeline as P
    import test_filters as by_filter
    import test_neardup as by_pair
    import test_suffix as by_suffix

    from factloom.llm import mixing, quality

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    bad = set(quality.abusive_words(docs, labels))
    rows = [r.asDict() for r in docs.collect()]

    def good(t):
        w, chars, symbols, dup, again, _ = by_filter.features_by_hand(t)
        lines = sum(bool(regex.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
        upper = len(regex.findall(r"\p{Lu}", t or ""))
        said = sum(x.lower() in bad for x in regex.findall("[A-Za-z]+", t or ""))
        return w >= 1 and (w < 50 or 2 * again <= w) and 2 * w <= chars <= 15 * w and 10 * symbols <= w and (dup < 3 or 10 * dup <= 3 * lines) and 10 * upper <= 4 * chars and said < 2

    rows = [r for r in rows if good(r["text"])]
    rows.sort(key=lambda r: r["doc_id"])
    first = by_pair.brute([r["text"] for r in rows])
    rows = [r for k, r in enumerate(rows) if first[k] == k]
    raw = [r["text"].encode() for r in rows]
    seen = Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
    for r, x in zip(rows, raw, strict=True):
        gone = set()
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        if gone:
            r["text"] = bytes(c for i, c in enumerate(x) if i not in gone).decode("utf-8", "ignore")
            r["n_chars"] = len(r["text"])
    assert by_suffix.brute([], 200) == []
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r for r, h in zip(rows, by_filter.hits_by_hand([r["text"] for r in rows], items), strict=True) if not h[1]]
    n = Counter(r["source"] for r in rows)
    want = defaultdict(int)
    for r in rows:
        rate = 1 / len(n) * len(rows) / n[r["source"]]
        draws = math.ceil(rate / mixing.STEP)
        who = f"{r['doc_id']}|{hashlib.md5(r['text'].encode()).hexdigest()}"
        for d in range(draws):
            u = int(hashlib.md5(f"42|{who}|{d}".encode()).hexdigest()[:13], 16) / 2**52
            m = rate / draws
            p = total = math.exp(-m)
            k = 0
            while total <= u:
                k += 1
                p *= m / k
                total += p
            if k:
                want[r["doc_id"], r["text"], r["n_chars"]] += k
    got = Counter((r.doc_id, r.text, r.n_chars) for r in P.run(spark, SMALL).collect())
    assert got == Counter(want) and sum(got.values()) > 50
