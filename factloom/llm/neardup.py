"""Near-duplicate documents by the Jaccard similarity of their word shingles, retrieved by covering LSH.

A text has SKETCHES sketches of PLACES minima of its shingles' hashes (16 bits of each), so at a similarity of 0.8 a
fifth of the places differ. Each sketch has the covering tables of simhash.masks: place j has a vector m(j) of
RADIUS + 1 bits, table v keeps the places with an odd number of ones in m(j) & v, and sketches that differ in at most
RADIUS places agree in what some table keeps, without exception. All sketches of a pair of similarity 0.8 differ in
more places, and in such that no table covers, with a chance of 6e-8. Pairs of which less than AGREE of all minima are
equal aren't verified (a pair of similarity 0.8 is one of them with a chance of 6e-9); every link is verified on the
exact sets of shingles.

Texts of the same words are one node from the start; nodes go by numbers. In each bucket all nodes are first held
against the least one, pairs that meet in several buckets once; what that links is contracted. Buckets of more than
BLOCK nodes in which more than one component is left are held against others of their nodes, ROUNDS times, and
contracted each time. In what is then left open the nodes are found whose sketches agree with one of another
component, a large bucket block by block; only those are compared on their sets, SET_BYTES of them at a time. So links
are enough to connect all that is connected, and a large group of near copies costs a row for each copy and table.

Texts don't travel whole: those whose sets are wanted, and in the end those that have copies of any kind, are sorted
out where they are by a bitmap of hashes, of MAP_BITS at most; joins then decide.

Defined cases: texts without words have no shingles and are one node; fewer words than a shingle make one shingle;
ids may be null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, components, fresh, slices, sorted_groups, stash, text_bytes
from .decontam import MULT, Words
from .simhash import masks

#: Words of a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Places of a sketch in which the tables cover a difference, places and sketches, equal minima of a pair from which it is verified.
RADIUS, PLACES, SKETCHES, AGREE = 2, 7, 8, 26
#: How often large buckets with several components are held against another one of their nodes.
ROUNDS = 4
#: Nodes whose sketches are compared at once, against as many others; bytes of sets compared at once, and bits of a bitmap.
BLOCK, SET_BYTES, MAP_BITS = 1024, 4 << 20, 1 << 28
_rng = np.random.default_rng(42)
_FLIP, _TIMES = _rng.integers(0, 2**64, (2, SKETCHES * PLACES), np.uint64)
_TIMES |= np.uint64(1)


#: By byte: lower-cased; 0 for white space. NUL is a part of words; it is read as a byte that UTF-8 doesn't have.
SPACED = np.array([0 if c == 32 or 9 <= c <= 13 else 0xC0 if c == 0 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Text bytes that a task looks at together.
CHUNK = 1 << 20


def _texts(column: pa.Array) -> Iterator[tuple[Words, int]]:
    """The words of some texts at a time, and how many texts those are."""
    body, offsets = text_bytes(column)
    for i, j in slices(offsets, CHUNK):
        yield Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED), j - i


def nodes(w: Words) -> list[bytes]:
    """128 bits of each text's words."""
    low, keep = w.low.copy(), w.low != 0
    gap = w.begin[np.setdiff1d(np.arange(len(w.begin)), w.first[:-1], assume_unique=False)] - 1  # before words that aren't first
    low[gap], keep[gap] = 32, True
    at = np.r_[0, np.cumsum(keep)][w.offsets].tolist()
    raw = low[keep].tobytes()
    return [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]


def shingle_sets(w: Words, words: int = WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's shingles, each once; fewer words than a shingle make one."""
    by_size = {words: w.shingles(words)[0]}
    out = []
    for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        size = min(words, y - x)
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        if size not in by_size:
            by_size[size] = w.shingles(size)[0]
        out.append(np.unique(by_size[size][x : y - size + 1]))
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return next(shingle_sets(w, words)[0] for w, _ in _texts(pa.array([text or ""])))


def sketch(h: np.ndarray) -> np.ndarray:
    """16 bits of each minimum of a set of shingles, sketch after sketch; all ones for an empty one."""
    if not len(h):
        return np.full(SKETCHES * PLACES, 2**16 - 1, np.uint16)
    least = np.full(SKETCHES * PLACES, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 512):
        least = np.minimum(least, ((h[i : i + 512, None] ^ _FLIP) * _TIMES).min(axis=0))
    return ((least ^ (least >> np.uint64(32))) * MULT >> np.uint64(48)).astype(np.uint16)


def table_keys(sketches: np.ndarray) -> np.ndarray:
    """For each row of minima, what each sketch's tables keep of it, as a number that tables don't share."""
    x = sketches.reshape(len(sketches), SKETCHES, PLACES).astype(np.uint64)
    out = np.empty(x.shape, np.uint64)
    for t, m in enumerate(masks(RADIUS, PLACES)):
        k = np.broadcast_to(np.arange(t + 1, PLACES * SKETCHES + t + 1, PLACES, dtype=np.uint64), x.shape[:2])
        for j in (j for j in range(PLACES) if m >> j & 1):
            k = (k ^ (k >> np.uint64(31))) * MULT + x[:, :, j]
        out[:, :, t] = k ^ (k >> np.uint64(32))
    return out.reshape(len(x), -1).view(np.int64)


def _minima(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _key(text: Column) -> Column:
    """128 bits of a text as it is."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _signed(text: Column, words: int) -> Column:
    """struct(node, s): a text's node and its sketches."""

    def signed(a: pa.Array) -> pa.Array:
        node, s = [], []
        for w, _ in _texts(a):
            node += nodes(w)
            s += [sketch(h).tobytes() for h in shingle_sets(w, words)]
        return pa.StructArray.from_arrays([pa.array(node, pa.binary()), pa.array(s, pa.binary())], names=["node", "s"])

    return arrow_column(signed, "struct<node:binary,s:binary>")(text)


def _sets(text: Column, words: int) -> Column:
    return arrow_column(lambda a: pa.array([h.tobytes() for w, _ in _texts(a) for h in shingle_sets(w, words)], pa.binary()), "binary")(text)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _forest(sets: list[np.ndarray], roots: list[int], side: list[bool] | None, least: float) -> list[tuple[int, int]]:
    """Links between nodes of different components; with two sides only pairs across them."""
    parent = {r: r for r in roots}

    def root(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    size = np.array([len(h) for h in sets])
    first, at_side = np.cumsum(size) - size, None if side is None else np.array(side)
    of = np.repeat(np.arange(len(sets)), size)
    # where each shingle stands: all nodes that share one with a node are counted at once
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    held, start = of[order], np.r_[0, np.cumsum(np.bincount(number))]
    for i in range(len(sets)):
        own = number[first[i] : first[i] + size[i]]
        both = np.bincount(np.concatenate([held[start[x] : start[x + 1]] for x in own.tolist()] or [held[:0]]), minlength=len(sets))
        near = both >= least * (size[i] + size - both)
        near[: i + 1] = False
        if side is not None:
            near &= at_side != at_side[i]
        for j in np.flatnonzero(near).tolist():
            if (a := root(roots[i])) != (b := root(roots[j])):
                parent[b] = a
                out.append((i, j))
    return out


def _bitmap(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that values of a column pass, and few others: a bit for each hash."""
    n = keys.count()
    bits = min(MAP_BITS, 1 << max(10, (64 * n).bit_length()))
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.groupBy(F.floor(slot / 64).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), 64L) as int))")).alias("b")).toArrow()  # MAP_BITS / 64 rows at most
    own = np.zeros(bits // 64, np.int64)
    own[words.column("w").to_numpy()] = words.column("b").to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(own)

    def held(a: pa.Array) -> pa.Array:
        x = a.to_numpy().view(np.uint64) & np.uint64(bits - 1)
        return pa.array((sent.value.view(np.uint64)[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1)

    return lambda c: arrow_column(held, "boolean")(F.xxhash64(c))


def _to_centres(members: DataFrame, of: DataFrame, turn: int) -> DataFrame:
    """(a, b): in each bucket that holds several components, one node (another one each turn) and those of other components."""
    named = members.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    centre = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "root"))
    each = named.groupBy("k").agg(centre.alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    open_ = stash(each.select("k", F.col("c.node").alias("a"), F.col("c.root").alias("ra")), "centres")
    return named.join(open_, "k").filter("root <> ra").select("a", F.col("node").alias("b")).distinct()


def _agreeing(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of which AGREE minima are equal."""

    @F.arrow_udf("boolean")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_minima(a) == _minima(b)).sum(axis=1) >= AGREE)

    s = known.select("node", "s")
    return pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").filter(agree("sa", "sb")).select("a", "b")


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows of (k, node, ...) with the pairs of blocks they are compared in; sizes: (k, parts)."""
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("mine")).cast("long") * F.col("parts") + F.greatest(j, F.col("mine")))
    dealt = rows.join(sizes, "k").withColumn("mine", mine).withColumn("pair", F.explode(meet))
    return dealt.withColumn("two", F.floor(F.col("pair") / F.col("parts")) != F.col("pair") % F.col("parts")).drop("parts")


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    for g in sorted_groups(batches, ["k", "pair"], limit):
        key = np.stack([g.column(c).to_numpy() for c in ("k", "pair")])
        at = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
        yield from (g.slice(i, j - i) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _rest(keyed: DataFrame, known: DataFrame, sets_of: Callable, of: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b): verified links between components that share a bucket."""
    named = stash(keyed.join(of, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    each = named.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    # buckets of the same nodes are one
    open_ = stash(each.filter("lo <> hi").groupBy("n", "of").agg(F.min("k").alias("k")).select("k", F.ceil(F.col("n") / block).cast("int").alias("parts")), "open")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _blocks(batches, 4096):
            root, s = g.column("root").to_numpy(), _minima(g.column("s"))
            found = np.zeros(len(g), bool)
            for lo in range(0, len(g), 64):
                near = (s[lo : lo + 64, None] == s[None, :]).sum(axis=2, dtype=np.uint8) >= AGREE
                near &= root[lo : lo + 64, None] != root[None, :]
                found[lo : lo + 64] |= near.any(axis=1)
            yield from g.filter(pa.array(found)).select(["k", "node", "root"]).to_batches()

    wide = _dealt(named, open_).join(known.select("node", "s"), "node").select("k", "pair", "node", "root", "s")
    near = stash(wide.repartition("k", "pair").sortWithinPartitions("k", "pair").mapInArrow(agreeing, "k long, node long, root long").distinct(), "agreeing")
    sets = sets_of(near.select("node"))
    sized = near.join(sets.select("node", F.length("s").alias("n")), "node").groupBy("k").agg(F.ceil(F.sum("n") / SET_BYTES).cast("int").alias("parts"))
    full = _dealt(near, stash(sized.withColumn("parts", F.greatest("parts", F.lit(1))), "sized")).join(sets, "node").select("k", "pair", "node", "root", "mine", "two", "s")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _blocks(batches, 256):
            rows = g.to_pydict()
            sides = [m == rows["mine"][0] for m in rows["mine"]] if rows["two"][0] else None
            found = _forest([np.frombuffer(s, np.uint64) for s in rows["s"]], rows["root"], sides, least)
            if found:
                yield pa.RecordBatch.from_pydict({c: pa.array([rows["node"][p[x]] for p in found], pa.int64()) for x, c in enumerate("ab")})

    return full.repartition("k", "pair").sortWithinPartitions("k", "pair").mapInArrow(compared, "a long, b long")


def signed(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """A table (id, x, node, s) of each row's id, its text's key, its words' 128 bits and its sketches."""
    each = df.select(F.col(key).alias("id"), _key(F.col(text)).alias("x"), _signed(F.col(text), words).alias("s"))
    return stash(each.select("id", "x", "s.node", "s.s"), "signed")


def numbered(known: DataFrame) -> DataFrame:
    """A table (node, words, s, n, first): a number for each node, its 128 bits, sketches, rows, and its first row (none, id, x)."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x")).alias("first")  # a null id comes last
    once = known.groupBy(F.col("node").alias("words")).agg(F.first("s").alias("s"), F.count("*").alias("n"), first)
    return stash(once.select(F.monotonically_increasing_id().alias("node"), "words", "s", "n", "first"), "nodes")


def links(df: DataFrame, known: DataFrame, text: str = "text", words: int = WORDS, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): 128 bits of nodes of that similarity, enough of them to connect all that are connected. known: signed() of df."""
    once = numbered(known)
    found, name = _links(df, once, text, words, least, block), once.select("node", "words")
    return found.join(name.toDF("a", "wa"), "a").join(name.toDF("b", "wb"), "b").select(F.col("wa").alias("a"), F.col("wb").alias("b"))


def _links(df: DataFrame, known: DataFrame, text: str, words: int, least: float, block: int) -> DataFrame:
    """(a, b): as links, nodes by number. known: numbered()."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = table_keys(_minima(b.column("s")))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(b.column("node").to_numpy(), k.shape[1]))], names=["k", "node"])

    every = known.select("node", "s").mapInArrow(keys, "k long, node long")
    buckets = stash(every.groupBy("k").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    keyed = stash(every.join(buckets, "k"), "keyed")
    star = stash(_agreeing(keyed.filter("a <> node").select("a", F.col("node").alias("b")).distinct(), known), "pairs")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The set of shingles of each of these nodes."""
        at = stash(wanted.distinct().join(known.select("node", F.col("first.x").alias("x")), "node"), "wanted")
        texts = df.select(_key(F.col(text)).alias("x"), F.col(text).alias("t"))
        texts = texts.filter(_bitmap(at, "x")(F.col("x"))).join(at, "x")
        return stash(texts.groupBy("node").agg(F.first("t").alias("t")).select("node", _sets(F.col("t"), words).alias("s")), "sets")

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in zip(a, b, strict=True)], pa.bool_())

    found, of, large = None, None, keyed.filter(F.col("n") > block).select("k", "node")
    for turn in range(ROUNDS + 1):
        pairs = star if not turn else stash(_agreeing(_to_centres(large, of, turn), known), "pairs")
        if turn and pairs.isEmpty():
            break
        sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        new = stash(both.filter(alike("sa", "sb")).select("a", "b"), "links")
        found = new if found is None else found.unionByName(new)
        of = components(found).toDF("node", "root")
    return found.unionByName(stash(_rest(keyed.select("k", "node"), known, sets_of, of, least, block), "links"))


def first_of_groups(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """df's rows, one of each near-duplicate group: that with the least id; of rows that share it, any one. A group of null ids keeps one row."""
    rows = signed(df, text, key, words)
    known = numbered(rows)
    of = components(_links(df, known, text, words, least, block)).toDF("node", "root")
    # nodes of one row that are linked to none stay as they are
    grouped = stash(known.join(of, "node", "left").filter("n > 1 OR root IS NOT NULL").select("words", F.coalesce("root", "node").alias("root"), "first"), "grouped")
    # a group's row: the least id (a null id comes last), then the least key of a text
    chosen = grouped.groupBy("root").agg(F.min("first").alias("c")).select("c.x", F.col("c.id").alias("id"), F.lit(True).alias("chosen"))
    touched = rows.join(grouped.select(F.col("words").alias("node")), "node").select("x").distinct()
    x, ident, mark, hit = (fresh(df.columns, n) for n in ("x", "least", "chosen", "hit"))
    told = stash(touched.join(chosen, "x", "left").select(F.col("x").alias(x), F.col("id").alias(ident), F.coalesce("chosen", F.lit(False)).alias(mark)), "chosen")
    keyed = df.withColumn(x, _key(F.col(text))).withColumn(hit, _bitmap(told, x)(F.col(x)))
    parted = keyed.filter(F.col(hit)).join(told, x, "left")
    one = parted.filter(F.col(mark) & F.col(key).eqNullSafe(F.col(ident)))
    repeated = rows.select("id", F.col("x").alias("__own")).join(told.filter(F.col(mark)), F.col("__own") == F.col(x)).filter(F.col("id").eqNullSafe(F.col(ident))).groupBy(x).count().filter("count > 1")
    if not repeated.isEmpty():  # rows that repeat an id
        one = one.dropDuplicates([x])
        return keyed.filter(~F.col(hit)).select(df.columns).unionByName(parted.filter(F.col(mark).isNull()).select(df.columns)).unionByName(one.select(df.columns))
    kept = parted.filter(F.col(mark).isNull() | (F.col(mark) & F.col(key).eqNullSafe(F.col(ident))))
    return keyed.filter(~F.col(hit)).select(df.columns).unionByName(kept.select(df.columns))
