"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of `window` words (one, of all its words, if it has fewer). A document contains a window
if the window's shingles stand in it one after the other. Shingles are ordered by rarity: the number of documents that
have them, counted over the corpus in a first pass. As containment has to be whole, the prefix of a window is its
rarest shingle alone; a document is a candidate for a window just where it has that shingle. The shingle's place in
the window bounds the match: it must start and end inside the document. Candidates are then verified byte by byte over
the item-sized window.

Documents are read once for the counts and once for the join. A benchmark of at most BLOCK_BYTES of item text is
broadcast whole and no document text is shuffled. A larger one stays in tables: equal texts are cut once, bits of its
shingles (their number has a bound) tell which places of a document can matter, and those meet the windows' rarest
shingles in a shuffle, with as many words around as a window may have; the corpus is read twice all the same.

Defined cases: null and wordless texts have no hits; wordless items have no windows; repeated item ids count once;
ids may be null (such an item counts under the empty id) or repeated; empty tables give no hits or an empty result;
added columns get a trailing underscore where a name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, fresh, slices, stash, table, text_bytes

WINDOW, SHINGLE = 10, 5
#: Item text that is broadcast at most; it takes about 15 times as much memory as it has bytes.
BLOCK_BYTES = 8 << 20
#: Bits that are broadcast of a larger benchmark's shingles, as a power of two: 64 MB.
MOST_BITS = 29
#: Document bytes that a task looks at together.
CHUNK = 1 << 20
#: By byte: lower-cased letter, digit or part of a non-ASCII character; 0 for what separates words.
WORD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
MULT = np.uint64(0x9E3779B97F4A7C15)
RESULT = "n_words long, spans array<struct<b:long,e:long>>, items array<string>"


class Words:
    """The words of some texts: where they begin and end, which text they are of, and a hash of each."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> None:
        """table: what each byte is read as; 0 separates words."""
        self.low = table[body]
        self.offsets = offsets
        n = len(body)
        inside = self.low != 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = inside & (edge[:-1] | np.r_[True, ~inside[:-1]][:n])
        ends = inside & (edge[1:] | np.r_[~inside[1:], True][:n])
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: The first word of each text, and one more for the end.
        self.first = np.searchsorted(self.begin, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Of the word's bytes, 8 at a time."""
        padded = np.r_[self.low, np.zeros(16, np.uint8)]
        length = self.end - self.begin
        h = length.astype(np.uint64) * MULT
        live = np.arange(len(length))
        at = 0
        while len(live):
            word = np.zeros(len(live), np.uint64)
            left = length[live] - at
            for k in range(8):
                byte = padded[self.begin[live] + at + k].astype(np.uint64)
                byte[left <= k] = 0
                word |= byte << np.uint64(8 * k)
            x = (h[live] ^ word) * MULT
            h[live] = x ^ (x >> np.uint64(29))
            at += 8
            live = live[length[live] > at]
        return h

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each place with so many words from there, and whether those are all of one text."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            x = (h ^ self.hash[k : n - size + 1 + k]) * MULT
            h = x ^ (x >> np.uint64(31))
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return h, text[: n - size + 1] == text[size - 1 :]

    def bytes_of(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by a space each."""
        return b" ".join(self.low[x:y].tobytes() for x, y in zip(self.begin[a:b], self.end[a:b], strict=True))


class Windows:
    """A benchmark, as it is broadcast. Windows with the same words are one, of several items."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int) -> None:
        raw = [(t or "").encode() for _, t in items]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
        self.shingle = shingle
        found: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.items: list[set[str]] = []
        self.sizes: list[int] = []
        self.shingles: list[np.ndarray] = []
        hashes = {s: w.shingles(s)[0] for s in range(1, shingle + 1)}
        for i, (name, _) in enumerate(items):
            a, b = int(w.first[i]), int(w.first[i + 1])
            size = min(window, b - a)
            for at in range(a, b - size + 1) if size else ():
                text = w.bytes_of(at, at + size)
                k = found.setdefault(text, len(found))
                if k == len(self.texts):
                    s = min(size, shingle)
                    self.texts.append(text)
                    self.items.append(set())
                    self.sizes.append(size)
                    self.shingles.append(hashes[s][at : at + size - s + 1])
                self.items[k].add(name)
        #: By number of words in a shingle (fewer than `shingle` in short items): all shingles, sorted.
        self.lengths = [min(s, shingle) for s in self.sizes]
        self.known = {s: np.unique(np.concatenate([x for x, n in zip(self.shingles, self.lengths, strict=True) if n == s])) for s in sorted(set(self.lengths))}

    def order(self, seen: dict[int, int]) -> None:
        """Chooses each window's prefix, its rarest shingle (of equally rare ones the least hash), given documents by shingle."""
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {s: {} for s in self.known}
        for k, (x, s) in enumerate(zip(self.shingles, self.lengths, strict=True)):
            at = min(range(len(x)), key=lambda i: (seen.get(int(x[i]), 0), int(x[i])))
            self.prefix[s].setdefault(int(x[at]), []).append((k, at))
        self.rare = {s: np.array(sorted(p), np.uint64) for s, p in self.prefix.items()}


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the hashes that are known; a table of 2**20 bits drops nearly all others first."""
    if not len(known):
        return np.zeros(0, np.int64)
    bits = np.zeros(1 << 20, bool)
    bits[known >> np.uint64(44)] = True
    maybe = np.flatnonzero(bits[h >> np.uint64(44)])
    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    return maybe[known[at] == h[maybe]]


def _count(block: Windows, column: pa.Array) -> dict[int, int]:
    """Texts that have each of the block's shingles."""
    seen: dict[int, int] = {}
    body, offsets = text_bytes(column)
    for i, j in slices(offsets, CHUNK):
        w = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for s, known in block.known.items():
            h, whole = w.shingles(s)
            at = _among(h, known)
            at = at[whole[at]]
            text = np.searchsorted(w.first, at, "right") - 1
            pairs = np.unique(np.stack([h[at], text.astype(np.uint64)]), axis=1)[0] if len(at) else at
            for x, n in zip(*np.unique(pairs, return_counts=True), strict=True):
                seen[int(x)] = seen.get(int(x), 0) + int(n)
    return seen


def _join(block: Windows, column: pa.Array) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its number of words, the word ranges that are hit, and the items with windows in it."""
    out = []
    body, offsets = text_bytes(column)
    for i, j in slices(offsets, CHUNK):
        w = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for s, rare in block.rare.items():
            h, whole = w.shingles(s)
            at = _among(h, rare)
            for p in at[whole[at]].tolist():
                text = int(np.searchsorted(w.first, p, "right")) - 1
                first, last = int(w.first[text]), int(w.first[text + 1])
                for k, place in block.prefix[s][int(h[p])]:
                    a, b = p - place, p - place + block.sizes[k]
                    if first <= a and b <= last and w.bytes_of(a, b) == block.texts[k]:
                        own = spans.setdefault(text, [])
                        if own and own[-1][0] <= a - first <= own[-1][1]:
                            own[-1] = (own[-1][0], max(own[-1][1], b - first))
                        else:
                            own.append((a - first, b - first))
                        items.setdefault(text, set()).update(block.items[k])
        for k in range(j - i):
            out.append((int(w.first[k + 1] - w.first[k]), spans.get(k, []), sorted(items.get(k, ()))))
    return out


def covered(spans: Column) -> Column:
    """How many places the ranges cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(s["to"], x["b"]))).alias("n"), F.greatest(s["to"], x["e"]).alias("to"))
    return F.aggregate(F.sort_array(spans), start, step, lambda s: s["n"])


def _own(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def _scan(docs: DataFrame, text: str, block: Windows) -> Column:
    """The join of docs' texts with windows that are broadcast, as a column of RESULT."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            for k, n in _count(sent.value, b.column(0)).items():
                total[k] = total.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array(list(total.values()), pa.int64())], names=["h", "n"])

    seen = docs.select(text).mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    block.order({int(np.int64(r.h).view(np.uint64)): r.n for r in seen.toLocalIterator()})  # at most the block's shingles
    ready = spark.sparkContext.broadcast(block)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))])

    @F.arrow_udf(f"struct<{RESULT.replace(' long', ':long').replace(' array', ':array')}>")
    def joined(column: pa.Array) -> pa.Array:
        return pa.array([{"n_words": n, "spans": [{"b": a, "e": b} for a, b in s], "items": i} for n, s, i in _join(ready.value, column)], kind)

    return joined(F.col(text))


class Bits:
    """Which hashes may be in a table: a bit for each of their first `width` bits."""

    def __init__(self, hashes: DataFrame, n: int) -> None:
        """hashes: a column h (long) of n distinct ones. Sixteen bits for each, up to 2 to the MOST_BITS."""
        self.width = min(MOST_BITS, max(20, (16 * n).bit_length()))
        place = F.shiftrightunsigned("h", 64 - self.width)
        words = hashes.groupBy(F.shiftright(place, 3).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))).alias("b"))
        self.bytes = np.zeros(1 << (self.width - 3), np.uint8)
        for r in words.toLocalIterator():
            self.bytes[r.w] = r.b

    def places(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.width)
        return np.flatnonzero(self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def _partitioned(docs: DataFrame, text: str, own: DataFrame, window: int, shingle: int) -> DataFrame:
    """(k, spans, items) of texts with hits, k being the text's MD5: windows and texts meet by the windows' rarest shingles in a shuffle.

    Only bits of the benchmark's shingles are broadcast (2 to the MOST_BITS at most), so the corpus is read twice
    whatever the benchmark's size. What passes them travels: a hash and its count at first, then the words around.
    """
    spark = docs.sparkSession
    items = stash(own.select(F.md5("t").alias("t"), "i").distinct(), "items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, offsets = text_bytes(b.column("text"))
            for i, j in slices(offsets, CHUNK):
                w = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes = {s: w.shingles(s)[0].view(np.int64) for s in range(1, shingle + 1)}
                rows: list[tuple] = []
                for k in range(j - i):
                    first, last = int(w.first[k]), int(w.first[k + 1])
                    size = min(window, last - first)
                    s = min(size, shingle)
                    rows += [(i + k, w.bytes_of(at, at + size).decode("utf-8", "replace"), size, s, hashes[s][at : at + size - s + 1].tolist()) for at in range(first, last - size + 1) if size]
                t, win, size, s, h = zip(*rows, strict=True) if rows else ((),) * 5
                columns = [b.column("t").take(pa.array(t, pa.int64())), pa.array(win, pa.string()), pa.array(size, pa.int32()), pa.array(s, pa.int32()), pa.array(h, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "win", "size", "s", "h"])

    texts = own.select("t").distinct().select(F.md5("t").alias("t"), F.col("t").alias("text"))
    cuts = stash(texts.mapInArrow(cut, "t string, win string, size int, s int, h array<long>"), "cuts")
    windows = stash(cuts.groupBy("win").agg(F.first("size").alias("size"), F.first("s").alias("s"), F.first("h").alias("h")), "windows")
    lengths = sorted(r.s for r in windows.select("s").distinct().collect())  # no more than a shingle has words
    shingles = windows.select("win", "s", F.posexplode("h").alias("place", "h"))
    known = stash(shingles.select("h").distinct(), "shingles")
    bits = spark.sparkContext.broadcast(Bits(known, known.count()))

    def chunks(b: pa.RecordBatch) -> Iterator[tuple[int, Words]]:
        body, offsets = text_bytes(b.column("text"))
        for i, j in slices(offsets, CHUNK):
            yield i, Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def passing(w: Words, which: Bits) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for s in lengths:
            h, whole = w.shingles(s)
            at = which.places(h)
            at = at[whole[at]]
            yield s, at, h[at].view(np.int64), np.searchsorted(w.first, at, "right") - 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, w in chunks(b):
                found = [np.stack([h, text]) for _, _, h, text in passing(w, bits.value)]
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)[0] if found else np.zeros(0, np.int64)
                h, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    own_text = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    seen = own_text.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place")).alias("x")
    prefix = shingles.join(seen, "h", "left").groupBy("win", "s").agg(rarest).join(windows.select("win", "size"), "win")
    prefix = stash(prefix.select("win", "s", "size", "x.h", "x.place"), "prefix")
    rare = prefix.select("h").distinct()
    chosen = spark.sparkContext.broadcast(Bits(rare, rare.count()))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in chunks(b):
                for s, at, h, text_of in passing(w, chosen.value):
                    first, last = w.first[text_of], w.first[text_of + 1]
                    a, e = np.maximum(first, at - (window - s)), np.minimum(last, at + window)
                    around = [w.bytes_of(x, y).decode("utf-8", "replace") for x, y in zip(a.tolist(), e.tolist(), strict=True)]
                    columns = [b.column("k").take(pa.array(i + text_of)), pa.array(np.full(len(at), s, np.int32)), pa.array(h), pa.array(at - first), pa.array((at - a).astype(np.int32)), pa.array(around, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "s", "h", "p", "lead", "around"])

    keyed = own_text.select(F.md5("text").alias("k"), "text")
    near = keyed.mapInArrow(candidates, "k string, s int, h long, p long, lead int, around string").distinct()
    begin = F.col("lead") - F.col("place")
    held = F.array_join(F.slice(F.split("around", " "), F.greatest(begin, F.lit(0)) + 1, F.col("size")), " ")
    hits = near.join(prefix, ["s", "h"]).filter((begin >= 0) & (held == F.col("win")))
    hits = stash(hits.select("k", "win", (F.col("p") - F.col("place")).alias("b"), (F.col("p") - F.col("place") + F.col("size")).alias("e")).distinct(), "hits")
    spans = hits.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("spans"))
    of = hits.select("k", "win").distinct().join(cuts.select("win", "t").distinct(), "win").select("k", "t").distinct().join(items, "t").groupBy("k").agg(F.array_sort(F.collect_set("i")).alias("items"))
    return stash(spans.join(of, "k"), "hits")


def _n_words(column: pa.Array) -> pa.Array:
    body, offsets = text_bytes(column)
    return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.diff(Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).first) for i, j in slices(offsets, CHUNK))]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, name: str = "hits", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """docs with a struct column: n_words, spans (word ranges that are hit) and items (whose windows occur).

    A benchmark of up to block_bytes of text is broadcast; a larger one meets the documents in a shuffle.
    """
    name = fresh(docs.columns, name)
    own = _own(benchmark, item, item_text)
    if (own.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0) <= block_bytes:
        return docs.withColumn(name, _scan(docs, text, Windows([(r.i, r.t) for r in own.toLocalIterator()], window, shingle)))
    key, k = fresh([*docs.columns, name], "k"), fresh([*docs.columns, name], "found")
    hits = _partitioned(docs, text, own, window, shingle).select(F.col("k").alias(k), F.struct("spans", "items").alias(name))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spans, names = (F.coalesce(F.col(name)[c], F.array().cast(t)).alias(c) for c, t in (("spans", "array<struct<b:long,e:long>>"), ("items", "array<string>")))
    out = docs.withColumn(key, F.md5(whole)).join(hits, F.col(key) == F.col(k), "left")
    return out.select(*docs.columns, F.struct(arrow_column(_n_words, "long")(whole).alias("n_words"), spans, names).alias(name))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits")
    hit = covered(F.col("hits.spans"))
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_WORDS = "string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"
SQL = {
    "op9_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter({_WORDS}, lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS size, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM m) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN k ON d.rid = k.rid"""
}
