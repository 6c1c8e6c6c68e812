"""Suffix-array dedup: every byte that lies in a string of `length` bytes which starts more than once is removed.

Sharding. Each start of a `length`-byte window is given the GRAM-byte string in the window whose hash is least.
Equal windows have equal least hashes, so sending windows by that hash brings all their occurrences to one shard,
however many documents share them. Neighbouring starts mostly have the same string; a run of them is one snippet, about
length / 2 starts long. Snippets whose hash occurs once in the corpus cannot repeat and stay where they are. Equal ones
of the others are counted as one (by 128 bits of their own beside the hash's 64), and that one travels to its shard
once; a hash all of whose snippets have copies needs no array, since all its windows occur again. Texts are cut where
they are: a bitmap of the repeated hashes (MAP_BITS at most) keeps the others' snippets out before any shuffle, and
only texts of which shards need a snippet, and those that lose bytes, are shuffled, once each.

Shards. Of a snippet, starts by WIDTHS[0] at a time are left out if no other snippet of its hash has the bytes that all
their windows share. A shard joins what is left of its snippets into one string and sorts its suffixes by induced sorting: suffixes are classified
S or L, the leftmost S ones (LMS) sort their substrings by one round of induction, named substrings make a shorter
string that is sorted recursively, whatever its length, and a last round induces the shard's array from the sorted LMS
suffixes. Induction goes bucket by bucket in whole numpy vectors; neighbouring buckets that don't induce into each other
go together, which keeps steps few where names are many. Each start's predecessor in the array is written in text order
(the permuted form), and so are their common prefixes, compared in 8-byte words up to `length`. A start repeats if it
shares `length` bytes with a neighbour in the array, or if its snippet was counted more than once.

A hash whose different snippets fill more than HOT_BYTES (boilerplate between texts that differ) isn't sent to a single
task: its snippets are parted by how far their starts are from the least gram, WIDTHS starts at a time, each part under
a hash of the bytes that all its windows share. Equal windows have equal parts, so parts are decided like snippets.

Defined cases: null is empty; texts shorter than `length` have no windows; snippets of all rows are counted and texts go
by their digests, so repeated rows, null and repeated ids are fine; ties in hashes only merge runs; an empty table gives an
empty result; input columns keep their names, added ones get a trailing underscore where a name is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, fresh, slices, stash, table, text_bytes

LENGTH, GRAM = 200, 32
#: Bytes of text cut at once and hashed at once, bytes of snippets in a shard's array, and snippet bytes from which a hash is hot.
CHUNK, HASHED, SHARD_BYTES, HOT_BYTES = 512 << 10, 64 << 10, 1 << 20, 2 << 20


# --- suffix arrays -------------------------------------------------------------------------------------------------


def _batches(least: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of buckets that one step may take together: none of them induces into another one, or there is just one.

    least: for each bucket the first bucket that a suffix in it induces into (its own number, if a run stays inside).
    """
    out, a, wide = [], 0, 64
    while a < len(least):
        low = np.minimum.accumulate(least[a : a + wide])
        inside = low < np.arange(a + 1, a + len(low) + 1)
        k = int(inside.argmax())
        if not inside[k]:
            if a + wide < len(least):
                wide *= 4  # no end in sight
                continue
            k = len(low)
        out.append((a, a + max(k, 1)))
        a, wide = a + max(k, 1), max(64, 2 * k)
    return out


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in order (or the order of their substrings, if lms is unsorted).

    Buckets are taken in order, those side by side together as long as none of them induces into another one.
    """
    n = len(t)
    small = t.astype(np.uint16) if size <= 1 << 16 else t
    count = np.bincount(t, minlength=size)
    start = np.cumsum(count) - count
    sa = np.full(n, -1, np.int64)
    lms = lms[np.argsort(small[lms], kind="stable")]
    at_lms = np.searchsorted(t[lms], np.arange(size + 1))

    def deal(suffixes: np.ndarray, at: np.ndarray, back: bool) -> None:
        """Puts suffixes at the fronts (or, from the back, the ends) of their buckets, in order."""
        if not len(suffixes):
            return
        c = small[suffixes]
        o = np.argsort(c, kind="stable")  # by radix, as long as names are of 16 bits
        c, suffixes = c[o].astype(np.int64), suffixes[o]
        edge = np.flatnonzero(c[1:] != c[:-1])
        first, n_of = np.zeros(len(edge) + 1, np.int64), np.empty(len(edge) + 1, np.int64)
        first[1:] = edge + 1
        np.subtract(first[1:], first[:-1], out=n_of[:-1])
        n_of[-1] = len(c) - first[-1]
        rank = np.arange(len(c)) - np.repeat(first, n_of)
        if back:
            sa[at[c] - 1 - rank] = suffixes
            at[c[first]] -= n_of
        else:
            sa[at[c] + rank] = suffixes
            at[c[first]] += n_of

    before, here = t[:-1], t[1:]
    to_l = np.full(size, size)
    np.minimum.at(to_l, here[~s_type[:-1]], before[~s_type[:-1]])
    head = start.copy()
    for a, b in _batches(to_l):
        if b - a == 1 and to_l[a] == a:  # runs of one symbol
            done = int(start[a])
            while done < head[a]:
                seg = sa[done : head[a]]
                done = int(head[a])
                pred = seg[seg > 0] - 1
                deal(pred[~s_type[pred]], head, False)
            own = lms[at_lms[a] : at_lms[b]]
        else:
            own = sa[start[a] : start[b - 1] + count[b - 1]]
            own, more = own[own >= 0], lms[at_lms[a] : at_lms[b]]
            if len(more) and len(own):
                own = np.r_[own, more]
                own = own[np.argsort(2 * t[own] + s_type[own], kind="stable")]
            elif len(more):
                own = more
        pred = own[own > 0] - 1
        deal(pred[~s_type[pred]], head, False)
    tail = start + count
    to_s = np.full(size, size)  # counted from the end
    np.minimum.at(to_s, size - 1 - here[s_type[:-1]], size - 1 - before[s_type[:-1]])
    for x, y in _batches(to_s):
        a, b = size - y, size - x
        if b - a == 1 and to_s[x] == x:
            done = int(start[a] + count[a])
            while done > tail[a]:
                seg = sa[tail[a] : done][::-1]
                done = int(tail[a])
                pred = seg[seg > 0] - 1
                deal(pred[s_type[pred]], tail, True)
            own = sa[start[a] : head[a]][::-1]
        else:
            own = sa[start[a] : start[b - 1] + count[b - 1]][::-1]
        pred = own[own > 0] - 1
        deal(pred[s_type[pred]], tail, True)
    sa[0] = n - 1
    return sa


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffixes in order, by induced sorting. t: numbers below size, the last one 0 and smaller than all others."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    differs = np.flatnonzero(t[:-1] != t[1:])
    nxt = np.searchsorted(differs, np.arange(n - 1))
    s_type = np.ones(n, bool)
    s_type[:-1] = t[differs[nxt]] < t[differs[nxt] + 1]  # the last differs from the one before
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    rough = _induce(t, s_type, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    names = _name_substrings(t, s_type, lms, ordered)
    short = names[lms]
    k = int(short.max()) + 1
    if k == len(lms):
        rank = np.empty(len(lms), np.int64)
        rank[short] = np.arange(len(lms))
    else:
        rank = suffix_array(short, k)
    return _induce(t, s_type, lms[rank], size)


#: Symbols of a pair of LMS substrings that are compared in one step, once few pairs are left.
STRIDE = 32


def _name_substrings(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names, in order, of the LMS substrings (up to and with the next LMS place); equal substrings share one."""
    n = len(t)
    end = np.full(n, n, np.int64)
    end[lms[:-1]] = lms[1:]
    a, b = ordered[:-1], ordered[1:]
    size = end[b] - b
    same = (end[a] - a == size) & (end[a] < n) & (end[b] < n)
    coded = 2 * t + s_type
    live, at = np.flatnonzero(same), 0
    while len(live):
        wide = STRIDE if at >= 8 else 1
        step = np.minimum(at + np.arange(wide), size[live][:, None])
        equal = (coded[a[live][:, None] + step] == coded[b[live][:, None] + step]).all(axis=1)
        same[live[~equal]] = False
        at += wide
        live = live[equal & (size[live] >= at)]
    names = np.zeros(n, np.int64)
    names[b] = np.cumsum(~same)
    return names


def common_prefixes(body: np.ndarray, at: np.ndarray, before: np.ndarray, limit: int) -> np.ndarray:
    """Of the suffixes at `at` and `before`, whole words of 8 bytes, as far as limit (a multiple of 8)."""
    wide = np.r_[body, np.zeros(8, np.uint8)].astype(np.uint64)
    w = wide[: len(body)].copy()
    for k in range(1, 8):
        w |= wide[k : len(body) + k] << np.uint64(8 * k)
    out, live = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in range(0, limit, 8):
        live = live[(at[live] + k < len(body)) & (before[live] + k < len(body))]
        live = live[w[at[live] + k] == w[before[live] + k]]
        out[live] = k + 8
    return out


def repeated_starts(snippets: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each snippet, which of its window starts occur again, in it, in another one or in a copy of it."""
    size = np.array([len(s) for s in snippets])
    first = np.cumsum(size + 1) - size - 1
    body = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    text = body.astype(np.int64) + 2
    text[first + size] = 1
    sa = suffix_array(np.r_[text, 0], 258)[1:]
    inside = np.zeros(len(text) + 1, np.int64)
    inside[first] += 1
    inside[first + size - length + 1] -= 1
    starts = np.cumsum(inside[:-1]) > 0
    sa = sa[starts[sa]]
    plcp = np.zeros(len(text), np.int64)
    plcp[sa[1:]] = common_prefixes(body, sa[1:], sa[:-1], length)
    again = np.zeros(len(text), bool)
    pair = plcp[sa[1:]] >= length
    again[sa[1:][pair]] = True
    again[sa[:-1][pair]] = True
    return [again[f : f + n - length + 1] | (c > 1) for f, n, c in zip(first, size, copies, strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of the true ones."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


# --- sharding ------------------------------------------------------------------------------------------------------


#: Low bits of a hash that give way to its place, so that a least value tells where it stands.
PLACE = np.uint64((1 << 20) - 1)


def least_grams(body: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window, the place of the gram with the least hash in it (the first of equal ones); the hashes. At most 2**20 bytes."""
    v = body.astype(np.uint64)
    for k in (1, 2, 4):
        v = v[:-k] | (v[k:] << np.uint64(8 * k))
    h = v[: len(v) - gram + 8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    for k in range(8, gram, 8):
        h = (h ^ v[k : k + len(h)]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    m = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    m = np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m
    return (m & PLACE).astype(np.int64), h


def _anchors(body: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with the same least gram: the row, the first start, one past the last (both in the row), the gram's place from the first start, its hash.

    Two equal windows have their least grams at the same place in them, so a run holds no two: a text that repeats
    within itself gives several runs with the same hash.
    """
    out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for base in range(0, len(body) - length + 1, HASHED):
        m, h = least_grams(body[base : base + HASHED + length - 1], length, gram)
        row = row_of[base : base + len(m)]
        ok = np.arange(base, base + len(m)) + length <= offsets[row + 1]
        change = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])])
        stop = np.r_[change[1:], len(m)]
        keep = ok[change]
        change, stop = change[keep], stop[keep]
        r = row[change]
        out.append((r, base + change - offsets[r], base + stop - offsets[r], m[change] - change, h[m[change]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def name(snippet: bytes) -> tuple[int, int]:
    """What a snippet goes by, together with its hash: 128 bits of its own."""
    x = xxhash.xxh3_128_intdigest(snippet)
    return (x >> 64) - 2**63, (x & (2**64 - 1)) - 2**63


def _names(snippets: list[bytes]) -> list[pa.Array]:
    x = np.array([name(s) for s in snippets], np.int64).reshape(-1, 2)
    return [pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())]


#: The name of a snippet, and the key of a text, in a table.
NAME, KEY = ["h", "s1", "s2"], ["k1", "k2"]
#: Bits of a bitmap at the most, and bits for each hash that it holds.
MAP_BITS, BITS_EACH = 1 << 28, 8


def _minimal(length: int, gram: int) -> Callable:
    def anchors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        body, offsets = text_bytes(b.column("text"))
        for i, j in slices(offsets, CHUNK):
            r, lo, hi, at, h = _anchors(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
            yield r + i, lo, hi, at, h.view(np.int64)

    return anchors


def _split(length: int, gram: int, width: int) -> Callable:
    """Parts of snippets: starts whose distance to the least gram is in the same `width`, under a hash of the bytes that all windows of such starts share."""

    def anchors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        out: list[tuple[int, int, int, int, int]] = []
        for row, text in enumerate(b.column("text").to_pylist()):
            m = int(least_grams(np.frombuffer(text, np.uint8), length, gram)[0][0])
            out += [(row, lo, hi, m - lo, h) for lo, hi, h in _parts(text, m, length, gram, width)]
        if out:
            yield tuple(np.array(x, np.int64) for x in zip(*out, strict=True))

    return anchors


def _parts(text: bytes, m: int, length: int, gram: int, width: int) -> list[tuple[int, int, int]]:
    """(lo, hi, h) of the parts of a snippet whose least gram is at m, the last starts first."""
    out = []
    starts = len(text) - length + 1
    for near in range(max(0, m - starts + 1) // width * width, m + 1, width):
        far = min(near + width - 1, length - gram)
        lo, hi = max(0, m - far), min(starts, m - near + 1)
        if lo < hi:
            out.append((lo, hi, xxhash.xxh3_64_intdigest(text[m - near : m - far + length], near) - 2**63))
    return out


#: Starts of a part of a hot snippet, step by step; windows of one start are equal or have different hashes.
WIDTHS = (24, 1)


def _often(texts: DataFrame, cut: Callable) -> DataFrame:
    """(h, n): the hashes that snippets of these texts have more than once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, *_, h in cut(b):
                yield pa.RecordBatch.from_arrays([pa.array(h), b.column("copies").take(pa.array(row))], names=["h", "copies"])

    return texts.select("text", "copies").mapInArrow(hashes, "h long, copies long").groupBy("h").agg(F.sum("copies").alias("n")).filter("n > 1")


def _bitmap(keys: DataFrame, column: str, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test that the n hashes in a column of longs pass, and few others: a bit for each."""
    bits = min(MAP_BITS, 1 << max(10, (BITS_EACH * n).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1).cast("long"))
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("b")).toArrow()  # MAP_BITS / 64 rows at most
    own = np.zeros(bits // 64, np.uint64)
    own[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(own)

    def held(x: np.ndarray) -> np.ndarray:
        x = x.view(np.uint64) & np.uint64(bits - 1)
        return (sent.value[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1

    return held


def _column(held: Callable[[np.ndarray], np.ndarray]) -> Callable:
    return arrow_column(lambda a: pa.array(held(a.to_numpy())), "boolean")


def _found(texts: DataFrame, keys: list[str], length: int, gram: int, hot_bytes: int, widths: tuple[int, ...], cut: Callable) -> DataFrame:
    """(*keys, b, e): ranges of bytes to remove. texts: keys (longs, the last a hash), text, copies; equal texts may be rows of their own."""
    often = stash(_often(texts, cut), "often")
    told = often.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    held = _bitmap(often, "h", told.n)
    place = [*keys, "lo", "hi", "at"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, offsets = text_bytes(b.column("text"))
            for cuts in cut(b):
                row, lo, hi, at, h = (x[held(cuts[-1])] for x in cuts)
                begin, end, rows = offsets[row] + lo, offsets[row] + hi + length - 1, pa.array(row)
                names = _names([body[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
                numbers = (pa.array(x.astype(np.int32)) for x in (lo, hi, at))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in keys), *numbers, b.column("copies").take(rows), pa.array(h), *names], names=[*place, "copies", *NAME])

    kind = ", ".join(f"{c} {'int' if c in ('lo', 'hi', 'at') else 'long'}" for c in [*place, "copies", *NAME])
    placed = stash(texts.select(*keys, "text", "copies").mapInArrow(named, kind), "placed")
    # snippets go by their names; texts are cut again just for those that shards have to see, once each
    distinct = placed.groupBy(*NAME).agg(F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in place))
    whole = distinct.filter("copies > 1").select(*NAME, F.lit(0).alias("b"), (F.col("hi") - F.col("lo")).alias("e"))
    size = F.sum((F.col("hi") - F.col("lo") + (length - 1)).cast("long"))
    # one flag parts snippets: where no hash can be hot (a snippet has at most as many bytes as two windows), none is
    parted = bool(widths) and (told.most or 0) * (2 * length) > hot_bytes
    hot = (size > hot_bytes) & F.lit(parted)
    unsure = distinct.groupBy("h").agg(F.min("copies").alias("least"), F.count("*").alias("n"), hot.alias("hot")).filter("least = 1 AND n > 1").select("h", "hot")
    of = ["lo", "hi", "at", *NAME, "hot", "copies"]
    chosen = stash(distinct.join(unsure, "h").groupBy(*keys).agg(F.collect_list(F.struct(*of)).alias("cut")), "chosen")

    def texted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, ...]] = set()  # copies of a text meet in one task, unless Spark splits it
        for b in batches:
            own = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            new = [i for i, k in enumerate(own) if k not in seen and not seen.add(k)]
            for flat, snip in _cut(b.take(pa.array(new, pa.int64())), length):
                yield pa.RecordBatch.from_arrays([*flat[2:], pa.array(snip, pa.binary())], names=[*of[2:], "snip"])

    wanted = texts.select(*keys, "text").filter(_column(_bitmap(chosen, keys[-1], chosen.count()))(F.col(keys[-1]))).join(chosen.hint("shuffle_hash"), keys)
    snippets = wanted.mapInArrow(texted, "at int, h long, s1 long, s2 long, hot boolean, copies long, snip binary")
    if parted:
        snippets = stash(snippets, "snippets")
    cold = snippets.filter("NOT hot").drop("hot").repartition("h").sortWithinPartitions(*NAME).mapInArrow(_shards(length, gram), "h long, s1 long, s2 long, b int, e int")
    again = whole.unionByName(cold)
    if parted:
        own = ["a", *(f"a{i}" for i in NAME[1:])]
        each = snippets.filter("hot").dropDuplicates(NAME).select(*(F.col(n).alias(a) for n, a in zip(NAME, own, strict=True)), F.col("snip").alias("text"), "copies")
        parts = _found(stash(each, "hot"), own, length, gram, hot_bytes, widths[1:], _split(length, gram, widths[0]))
        again = again.unionByName(parts.select(*(F.col(a).alias(n) for n, a in zip(NAME, own, strict=True)), "b", (F.col("e") - (length - 1)).alias("e")))
    return placed.select(*keys, "lo", *NAME).join(again, NAME).select(*keys, (F.col("lo") + F.col("b")).alias("b"), (F.col("lo") + F.col("e") + (length - 1)).alias("e"))


def _pieces(group: list[tuple[int, int, bytes]], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """Of (at, copies, snippet) of one hash: ranges of starts in each that may occur again, parts of WIDTHS[0] starts whose shared bytes another one has."""
    parts = [_parts(s, at, length, gram, WIDTHS[0]) for at, _, s in group]
    met = Counter(h for p in parts for *_, h in p)
    out = []
    for p in parts:
        ranges: list[tuple[int, int]] = []
        for lo, hi, h in p:
            if met[h] > 1:
                if ranges and ranges[-1][0] == hi:
                    ranges[-1] = (lo, ranges[-1][1])
                else:
                    ranges.append((lo, hi))
        out.append(ranges)
    return out


def _shards(length: int, gram: int) -> Callable:
    """Suffix arrays over snippets whose hashes stand together: for those that were counted once, the starts that occur again."""

    def sort(held: list[tuple[tuple[int, int, int], int, int, bytes]]) -> pa.RecordBatch:
        flags = repeated_starts([s for *_, s in held], np.array([c for _, c, _, _ in held]), length)
        out = [(*n, lo + x, lo + y) for (n, c, lo, _), f in zip(held, flags, strict=True) if c == 1 and f.any() for x, y in runs(f)]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[*NAME, "b", "e"])

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[int, int, int], int, int, bytes]] = []
        group: list[tuple[tuple[int, int, int], int, int, bytes]] = []
        size = 0

        def close() -> int:
            before = len(held)
            for (n, c, _, s), ranges in zip(group, _pieces([g[2:0:-1] + g[3:] for g in group], length, gram), strict=True):
                held.extend((n, c, lo, s[lo : hi + length - 1]) for lo, hi in ranges)
            group.clear()
            return sum(len(s) for *_, s in held[before:])

        for b in batches:
            for *n, c, at, s in zip(*(b.column(x).to_pylist() for x in (*NAME, "copies", "at", "snip")), strict=True):
                if group and n[0] != group[-1][0][0]:
                    size += close()
                    if size >= SHARD_BYTES:
                        yield sort(held)
                        held, size = [], 0
                if not group or tuple(n) != group[-1][0]:
                    group.append((tuple(n), c, at, s))
        close()
        if held:
            yield sort(held)

    return sorted_


def _cut(b: pa.RecordBatch, length: int) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """Of a batch with text and cut (array of structs from lo and hi on): the structs' fields, the snippets."""
    body, offsets = text_bytes(b.column("text"))
    flat = b.column("cut").flatten()
    row = np.repeat(np.arange(len(b)), np.asarray(pc.list_value_length(b.column("cut"))))
    for i in range(0, len(row), 4096):
        part = [flat.field(x)[i : i + 4096] for x in range(flat.type.num_fields)]
        begin, end = (offsets[row[i : i + 4096]] + part[x].to_numpy() + (length - 1) * x for x in (0, 1))
        yield part, [body[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]


def spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """A table (k1, k2, spans): the byte ranges to remove of each text that has any. texts: k1, k2 (a digest of the text), text, copies."""
    if length % 8:
        raise ValueError("length must be a multiple of 8")
    found = _found(texts, KEY, length, gram, hot_bytes, WIDTHS, _minimal(length, gram))
    return stash(found.groupBy(*KEY).agg(F.collect_set(F.struct("b", "e")).alias("spans")), "spans")


def _removed(text: pa.Array, spans: pa.Array) -> pa.Array:
    body, offsets = text_bytes(text)
    at, b, e = spans.offsets.to_numpy(), spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
    told = np.asarray(spans.is_valid())
    gone_n, spans_n, kept = [], [], []
    for k in range(len(text)):
        own = body[offsets[k] : offsets[k + 1]]
        gone = np.zeros(len(own), bool)
        if told[k]:
            ends = np.zeros(len(own) + 1, np.int32)
            np.add.at(ends, b[at[k] : at[k + 1]], 1)
            np.add.at(ends, e[at[k] : at[k + 1]], -1)
            gone = np.cumsum(ends[:-1]) > 0
        gone_n.append(int(gone.sum()))
        spans_n.append(len(runs(gone)))
        kept.append(own[~gone].tobytes())
    columns = [pa.array(np.diff(offsets)), pa.array(gone_n, pa.int64()), pa.array(spans_n, pa.int64()), pa.array(kept, pa.binary())]
    return pa.StructArray.from_arrays(columns, names=RESULT)


#: What is found of a text.
RESULT = ["n_bytes", "n_removed", "n_spans", "kept"]


def remove_repeats(texts: DataFrame, length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(text) -> n_bytes, n_removed, n_spans and kept (the bytes that remain) of each row."""
    one = texts.select(F.col(texts.columns[0]).alias("text"))
    return without_repeats(one, length=length, hot_bytes=hot_bytes).select(RESULT)


def without_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """df with n_bytes, n_removed, n_spans and kept (binary: cuts can fall inside a character) of each row's text. df is read five times."""
    put = {n: fresh(df.columns, n) for n in RESULT}
    own, digest, one, two, cuts, result = (fresh(df.columns, f"__{n}") for n in ("own", "digest", "k1", "k2", "spans", "result"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    keyed = df.withColumn(own, body).withColumn(digest, F.md5(own)).withColumn(one, half(1)).withColumn(two, half(16)).drop(digest)
    found = spans(keyed.select(F.col(one).alias("k1"), F.col(two).alias("k2"), F.col(own).alias("text"), F.lit(1).cast("long").alias("copies")), length, hot_bytes=hot_bytes)
    hit = _column(_bitmap(found, "k2", found.count()))(F.col(two))
    removed = arrow_column(_removed, "struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")
    # texts without repeats stay where they are
    cut = keyed.filter(hit).join(found.toDF(one, two, cuts).hint("shuffle_hash"), [one, two], "left").withColumn(result, removed(F.col(own), F.col(cuts)))
    same = keyed.filter(~hit).withColumn(result, F.struct(F.octet_length(own).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col(own).cast("binary")).cast("struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>"))
    columns = [*df.columns, *(F.col(result)[a].alias(b) for a, b in put.items())]
    return cut.select(columns).unionByName(same.select(columns))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
