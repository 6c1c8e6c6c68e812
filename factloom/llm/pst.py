"""Language-model scoring with a probabilistic suffix tree over the words of whole texts.

Symbols are words and the end of a text. A context is up to `depth` symbols that stand before a symbol, the nearest
first (before a text stands an end), so contexts run across spaces and lines. A context is retained if what follows
it in training diverges from what follows its parent (the context less its oldest symbol): its count times the
Kullback-Leibler divergence is at least `gain` nats; the ancestors of retained contexts are retained too. Next-symbol
distributions are smoothed from the empty context down: p(a | c) = (n(c, a) + t(c) * p(a | parent)) / (n(c) + t(c)), t
the number of different symbols seen after c. A symbol is scored in the longest retained suffix of what precedes it.
The empty context has a probability for each of the HEAD_WORDS most frequent words; words beyond those share the count
of their hash class (CLASSES of them) and have their own counts in every longer context.

The tree is never gathered: a context's subtree is that of its nearest symbol, so all positions after a symbol meet in
one bucket, where their counts, divergence tests and scores are made together. What crosses the network is one packed
row for each bucket and chunk of text, 6 to 7 bytes a token for 14 to 4,000 buckets (ids are ranks by frequency,
the nearest symbol is a place in the row's own list), and back comes a packed row of a number for each text and bucket.

Hot contexts. Positions after a context that stands more than `hot` times don't meet in one bucket: they are dealt to
several of its own by the next older symbol, whose contexts then meet whole. What those buckets can't see are the counts
of what follows the hot context itself; they are added up in a pass of their own (combined by context and next symbol)
and sent, sorted and packed once, to each of the context's buckets. A context that is hot after the next
older symbol as well is dealt by the one after it, and one of `depth` symbols by texts. The result is the same.

Broadcast: the frequent words and the hash classes, a fixed number of each, the hot words' flags with them, and the hot
contexts, at most N / hot of each length; hot grows with N above 10^5 times its size, so their number is bounded too.

Defined cases: null and empty texts are one end; a null id counts as the text 'null' for the fold and stays null; ids
keep their type; repeated rows and ids are rows of their own; texts of any length are taken whole; a corpus without
training rows gives N = 0, the base its smoothed values and a uniform model; an empty table gives an empty result;
columns other than id and text are not carried along, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, slices, sorted_groups, stash, table, text_bytes

#: Longest context in words, least gain of a retained one in nats.
DEPTH, GAIN = 2, 3.0
END = b"\n"
HEAD_WORDS, CLASSES = 300_000, 4096
#: Positions of a bucket, and occurrences from which a word is hot.
BUCKET, HOT = 2_000_000, 4_000_000
#: Positions whose subtrees are made at a time, or those after one symbol.
AT_ONCE = 400_000
#: Partitions that buckets are dealt to, one each as long as there are no more of them.
PARTITIONS = 20_000
#: Text bytes whose words a task counts together, that it makes into words at once, and whose positions it deals together.
CHUNK, SPLIT, DEALT = 8 << 20, 4 << 20, 16 << 20
#: Scores are added up as whole numbers of 2^-32.
UNIT = 2.0**32
#: Ids from here on are hashes of words beyond the head, ids below are places in it.
TAIL = np.uint64(1 << 63)


def tokens(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def word_counts(docs: DataFrame, text: str, train: str) -> DataFrame:
    """(word, n, c): distinct words of all texts (the end as a line feed), how often all and how often training texts have them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        held = 0

        def out() -> pa.RecordBatch:
            every = [*seen[1], *(w for w in seen[0] if w not in seen[1])]
            c = [seen[1][w] for w in every]
            n = [k + seen[0].get(w, 0) for w, k in zip(every, c, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["word", "n", "c"])

        for b in batches:
            body, offsets = text_bytes(b.column(0))
            fold = b.column(1).to_pylist()
            for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                seen[bool(fold[i])].update(tokens(body[x:y].tobytes()))
                held += y - x
                if held > CHUNK:
                    yield out()
                    seen, held = (Counter(), Counter()), 0
        yield out()

    return docs.select(text, train).mapInArrow(counted, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)) | TAIL


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two columns of numbers."""
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.atleast_1d(b) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Level:
    """The hot contexts of one length, by number: which of the level before is their parent, how many positions they have, over how many buckets from which on these are dealt, what follows them, and whether they are retained."""

    number: np.ndarray
    words: np.ndarray
    up: np.ndarray
    every: np.ndarray
    parts: np.ndarray
    start: np.ndarray
    n: np.ndarray
    t: np.ndarray
    kept: np.ndarray

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of contexts, -1 for others."""
        at = np.minimum(np.searchsorted(self.number, x), len(self.number) - 1)
        return np.where(self.number[at] == x, at, -1)


@dataclass
class Root:
    """What is broadcast: the head's words with their places, the empty context, base scores, and what is hot."""

    place: dict[bytes, int]
    p: np.ndarray
    base: np.ndarray
    known: np.ndarray
    hot: np.ndarray
    classes: np.ndarray
    levels: list[Level]

    def ids(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        out = at.astype(np.uint64)
        rare = np.flatnonzero(at < 0)
        out[rare] = word_hash([words[i] for i in rare.tolist()])
        return out

    def alone(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities in the empty context."""
        out = self.classes[(ids & np.uint64(CLASSES - 1)).astype(np.int64)]
        head = ids < TAIL
        out[head] = self.p[ids[head].astype(np.int64)]
        return out

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        head = ids < TAIL
        out[head] = self.hot[ids[head].astype(np.int64)]
        return out

    def owner(self, bucket: int) -> tuple[int, int]:
        """Which hot context has a bucket of its own: its length (0: none) and its place in its level."""
        for d, level in enumerate(self.levels, 1):
            i = int(np.searchsorted(level.start, bucket, "right")) - 1
            if i >= 0 and bucket < level.start[i] + level.parts[i]:
                return d, i
        return 0, 0

    def deepest(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """How long the longest hot context of each position is, and its place in its level. x: numbers of contexts."""
        long, at = np.zeros(len(x[0]), np.int64), np.zeros(len(x[0]), np.int64)
        for d, level in enumerate(self.levels):
            i = level.find(x[d])
            more = (long == d) & (i >= 0)
            long[more], at[more] = d + 1, i[more]
        return long, at


def encoded(body: np.ndarray, offsets: np.ndarray, root: Root) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts' symbols, end to end, and how many each text has."""
    cut = offsets.tolist()
    own = [tokens(body[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return root.ids(list(chain.from_iterable(own))), np.array([len(t) for t in own], np.int64)


class Positions:
    """The symbols of some texts and those before each: ids, before[0] the nearest; the text of each position."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, root: Root, depth: int) -> None:
        self.ids, self.size = ids, size
        self.text = np.repeat(np.arange(len(size), dtype=np.int32), size)
        at = np.arange(len(ids), dtype=np.int32)
        place = at - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        end = np.uint64(root.place[END])
        self.before = [np.where(place >= d, self.ids[np.maximum(at - d, 0)], end) for d in range(1, depth + 1)]


def contexts(before: list[np.ndarray]) -> list[np.ndarray]:
    """A number for each position's context of 1, 2, ... symbols."""
    out, x = [], np.ones(len(before[0]), np.uint64)  # not 0: mix(0, 0) is 0, and contexts of several lengths would be one
    for w in before:
        x = mix(x, w)
        out.append(x)
    return out


def combination(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(~context, symbol)


def _planes(x: np.ndarray, wide: int = 4) -> bytes:
    """Numbers of 4 or 8 bytes, all their first bytes first: the high ones are mostly zero and pack well on the wire."""
    return np.ascontiguousarray(x.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T).tobytes()


def _numbers(raw: bytes, n: int, wide: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide).reshape(wide, n).T).view(f"<u{wide}").ravel()


def _small(*parts: bytes) -> bytes:
    return zstandard.compress(b"".join(parts), 1)


def pack(base: int, columns: list[np.ndarray], text: np.ndarray, train: np.ndarray) -> bytes:
    """Columns of ids with each position's text (its number from base on, not falling) and fold. The first column has few different ids."""
    every = np.concatenate(columns)
    rare = np.flatnonzero(every >= TAIL)
    tail, of = np.unique(every[rare], return_inverse=True)
    coded = every.astype(np.uint32)
    coded[rare] = HEAD_WORDS + 1 + of
    first, *others = coded.reshape(len(columns), -1)
    few, first = np.unique(first, return_inverse=True)
    head = np.array([base, len(text), len(tail), len(few)], "<i8").tobytes()
    return _small(head, tail.tobytes(), _planes(few), *map(_planes, (first, *others, np.diff(text, prepend=0))), np.packbits(train).tobytes())


def _codes(raw: bytes, width: int) -> tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """A packed row: base, rare ids, columns in which ids beyond the head are places among these, texts, fold."""
    raw = memoryview(zstandard.decompress(raw))
    base, n, k, few = np.frombuffer(raw, "<i8", 4).tolist()
    tail, at = np.frombuffer(raw, "<u8", k, 32), 32 + 8 * k
    of_first, at = _numbers(raw[at:], few), at + 4 * few
    first, *columns, text = (_numbers(raw[at + 4 * n * i :], n) for i in range(width + 1))
    train = np.unpackbits(np.frombuffer(raw, np.uint8, -1, at + 4 * n * (width + 1)), count=n).astype(bool)
    return base, tail, [of_first[first], *columns], np.cumsum(text.astype(np.int32), dtype=np.int32), train


def _ids(codes: np.ndarray, tail: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64)
    rare = np.flatnonzero(codes > HEAD_WORDS)
    x[rare] = tail[codes[rare] - np.uint32(HEAD_WORDS + 1)]
    return x


def unpack(raw: bytes, width: int) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray]:
    base, tail, columns, text, train = _codes(raw, width)
    return base, [_ids(c, tail) for c in columns], text, train


class Gathered:
    """The packed rows of a bucket, columns end to end in 4 bytes an id."""

    def __init__(self, blobs: list[bytes], width: int) -> None:
        self.rows: list[tuple[int, np.ndarray]] = []
        tails, columns, trains = [], [], []
        while blobs:
            base, tail, own, text, train = _codes(blobs.pop(), width)
            self.rows.append((base, text))
            tails.append(tail)
            columns.append(own)
            trains.append(train)
        self.tail, of = np.unique(np.concatenate(tails), return_inverse=True)
        of, at = (of + HEAD_WORDS + 1).astype(np.uint32), 0
        for tail, own in zip(tails, columns, strict=True):
            for c in own:
                rare = np.flatnonzero(c > HEAD_WORDS)
                c[rare] = of[at + c[rare] - np.uint32(HEAD_WORDS + 1)]
            at += len(tail)
        self.columns = [np.concatenate([c.pop(0) for c in columns]) for _ in range(width)]
        self.train = np.concatenate(trains)

    def turns(self, column: int) -> Iterator[np.ndarray]:
        """Positions by AT_ONCE, those with one id of a column at once."""
        c = self.columns[column]
        turns = 1 + len(c) // AT_ONCE
        turn = (mix(c.astype(np.uint64), np.uint64(1)) % np.uint64(turns)).astype(np.int16)
        for k in range(turns):
            own = np.flatnonzero(turn == k)
            if len(own):
                yield own

    def take(self, column: int, own: np.ndarray) -> np.ndarray:
        return _ids(self.columns[column][own], self.tail)

    def by_row(self, value: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at = 0
        for base, text in self.rows:
            yield base, text, value[at : at + len(text)]
            at += len(text)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value first stands, and which of the values, in order, stands where."""
    _, first, of = np.unique(x, return_index=True, return_inverse=True)
    return first.astype(np.int32), of.astype(np.int32)


def subtree(before: list[np.ndarray], symbol: np.ndarray, train: np.ndarray, alone: np.ndarray, gain: float, x: np.ndarray | None = None, q: np.ndarray | None = None, tell: bool = False) -> np.ndarray:
    """The probability of each position's symbol; all positions after each nearest symbol are here. Takes the columns of before away.

    x, q: the number of a context that stands before, and the share of the symbol in what follows it; alone is then its
    probability there. tell: whether the context with the nearest symbol is retained, in place of the probability.
    """
    levels = []
    x = np.zeros(len(symbol), np.uint64) if x is None else x
    q = alone if q is None else q
    while before:
        x = mix(x, before.pop(0))
        first, of = _numbered(x)
        s_first, s_of = _numbered(combination(x, symbol))
        n = np.bincount(of, weights=train, minlength=len(first))
        c = np.bincount(s_of, weights=train, minlength=len(s_first))
        up = of[s_first]
        t = np.bincount(up, weights=c > 0, minlength=len(first))
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.where(c > 0, c * np.log(c / n[up] / q[s_first]), 0.0)
            kept = (np.bincount(up, weights=each, minlength=len(first)) >= gain) & (n > 0)
            c = c.astype(np.float32 if len(symbol) < 1 << 24 else np.float64)[s_of]
            q = c / n[of]
        levels.append((first, of, n, t, kept, c))
    for (_, up, _, _, above, _), (first, _, _, _, kept, _) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        above[up[first[kept]]] = True
    if tell:
        return levels[0][4][levels[0][1]]
    p = alone
    for _, of, n, t, kept, c in levels:
        here = kept[of]
        up = of[here]
        p[here] = (c[here] + t[up] * p[here]) / (n + t)[up]
    return p


def _of(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def followers(docs: DataFrame, root: Root, level: Level, d: int, depth: int) -> DataFrame:
    """(up, x, w, c, n): of each hot context of d symbols with each symbol that follows it, how often in training and in all."""
    sent = docs.sparkSession.sparkContext.broadcast((root, level))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, own = sent.value
        for b in batches:
            body, offsets = text_bytes(b.column("text"))
            held = np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), bool)
            for i, j in slices(offsets, SPLIT):
                p = Positions(*encoded(body, offsets[i : j + 1], r), r, depth)
                here = np.flatnonzero(r.is_hot(p.before[0]))
                x = contexts([w[here] for w in p.before[:d]])
                known = own.find(x[-1]) >= 0
                here, x = here[known], [np.zeros(int(known.sum()), np.uint64), *(k[known] for k in x)]
                first, of = _numbered(combination(x[-1], p.ids[here]))
                c = np.bincount(of, weights=~held[i:j][p.text[here]], minlength=len(first)).astype(np.int64)
                n = np.bincount(of, minlength=len(first))
                yield pa.RecordBatch.from_arrays([_of(x[-2][first]), _of(x[-1][first]), _of(p.ids[here][first]), pa.array(c), pa.array(n)], names=["up", "x", "w", "c", "n"])

    return docs.mapInArrow(counted, "up long, x long, w long, c long, n long").groupBy("up", "x", "w").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def hot_levels(docs: DataFrame, root: Root, depth: int, gain: float, hot: int, alone) -> list[DataFrame]:
    """Fills root.levels; of each level a table (up, x, w, c1, c2, ..., n): the training counts of w after the context and its ancestors."""
    tables: list[DataFrame] = []
    end = root.place[END]
    found = np.flatnonzero(root.hot).astype(np.uint64).reshape(-1, 1)
    for d in range(1, depth + 1):
        x = contexts(list(found.T))
        order = np.argsort(x[-1])
        found, x = found[order], [k[order] for k in x]
        up = root.levels[-1].find(x[-2]) if d > 1 else np.zeros(len(found), np.int64)
        none = np.zeros(len(found))
        level = Level(x[-1], found, up, *(none.astype(np.int64) for _ in range(3)), none.copy(), none.copy(), none.astype(bool))
        each = followers(docs, root, level, d, depth).withColumnRenamed("c", f"c{d}")
        if d > 1:
            above = root.levels[-1].number[np.unique(up)].view(np.int64).tolist()  # at most N / hot
            each = each.join(tables[-1].filter(F.col("x").isin(above)).drop("up", "n").withColumnRenamed("x", "up"), ["up", "w"])
        each = stash(each.withColumn("q", alone(F.col("w")) if d == 1 else F.col(f"c{d - 1}").cast("double")), "level")
        c = F.col(f"c{d}")
        told = each.groupBy("x").agg(F.sum(c).alias("c"), F.sum((c > 0).cast("long")).alias("t"), F.sum("n").alias("n"), F.sum(F.when(c > 0, c * F.log(c / F.col("q")))).alias("s")).toArrow()  # at most N / hot rows
        at = level.find(told.column("x").to_numpy().view(np.uint64))
        n = told.column("c").to_numpy().astype(np.float64)
        level.every[at], level.n[at], level.t[at] = told.column("n").to_numpy(), n, told.column("t").to_numpy()
        above = root.levels[-1].n[up[at]] if d > 1 else np.ones(len(at))
        with np.errstate(divide="ignore", invalid="ignore"):
            level.kept[at] = (n > 0) & (told.column("s").fill_null(0.0).to_numpy() + n * np.log(above / n) >= gain - 1e-9)
        root.levels.append(level)
        tables.append(each.drop("q"))
        if d == depth:
            break
        # a symbol that often follows a hot context is itself one, before which the context stands
        often = each.filter(F.col("n") > hot).select("x", "w").toArrow()  # at most N / hot rows
        w, i = often.column("w").to_numpy().view(np.uint64), level.find(often.column("x").to_numpy().view(np.uint64))
        longer = np.concatenate([np.c_[w, found[i]][w != end], np.full((1, d + 1), end, np.uint64)])
        found = longer[level.find(contexts(list(longer[:, :d].T))[-1]) >= 0]
        if not len(found):
            break
    _close(root.levels)
    return tables


def _close(levels: list[Level]) -> None:
    """Ancestors of retained contexts are retained."""
    for above, level in zip(levels[-2::-1], levels[:0:-1], strict=True):
        above.kept[level.up[level.kept]] = True


def number_buckets(levels: list[Level], bucket: int, first: int) -> int:
    """Gives each hot context buckets of its own, from first on, for the positions that no longer hot context has. The number behind the last."""
    for d, level in enumerate(levels):
        own = level.every.copy()
        if d + 1 < len(levels):
            np.subtract.at(own, levels[d + 1].up, levels[d + 1].every)
        level.parts = 1 + own // bucket
        level.start = first + np.cumsum(level.parts) - level.parts
        first += int(level.parts.sum())
    return first


def hot_sides(table: DataFrame, sent, d: int) -> DataFrame:
    """What buckets have to know of a level: how often each symbol follows each context and its ancestors, in order of symbols."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value.levels[d - 1]
        for b in batches:
            x, w = (b.column(k).to_numpy().view(np.uint64) for k in ("x", "w"))
            counts = [b.column(f"c{k}").to_numpy() for k in range(1, d + 1)]
            for i, o in _dealt(level.find(x)):
                o = o[np.argsort(w[o])]
                blob = _small(np.array([d, i, len(o)], "<i8").tobytes(), _planes(np.diff(w[o], prepend=np.uint64(0)), 8), *(_planes(c[o], 8) for c in counts))
                yield _packed([(k, LEVEL, blob) for k in range(int(level.start[i]), int(level.start[i] + level.parts[i]))])

    return table.sortWithinPartitions("x", "w").mapInArrow(sides, SENT_KIND)


def _sides_of(r: Root, parts: dict[int, pa.Table]) -> tuple[np.ndarray, ...]:
    """Of contexts with the symbols after them, in order of their numbers: the symbol's probability, and its share of what follows."""
    found = [np.zeros((3, 0), np.uint64)]
    for raw in parts[LEVEL].column("blob").to_pylist() if LEVEL in parts else ():
        raw = memoryview(zstandard.decompress(raw))
        d, i, n = np.frombuffer(raw, "<i8", 3).tolist()
        w, *counts = (_numbers(raw[24 + 8 * n * k :], n, 8) for k in range(d + 1))
        w = np.cumsum(w, dtype=np.uint64)
        place = [i]
        for level in r.levels[d - 1 : 0 : -1]:
            place.insert(0, int(level.up[place[0]]))
        p = r.alone(w)
        for level, k, c in zip(r.levels, place, counts, strict=False):
            if level.kept[k]:
                p = (c + level.t[k] * p) / max(level.n[k] + level.t[k], 1)
        q = counts[-1] / max(r.levels[d - 1].n[i], 1)
        found.append(np.stack([combination(np.full(n, r.levels[d - 1].number[i]), w), p.view(np.uint64), q.view(np.uint64)]))
    return _in_order(found)


DOC, WORD, LEVEL, COLD, WARM, RARE, OPEN = range(7)
#: Rows that buckets are made of: texts with their own columns, counts of words, counts after hot contexts, and packed positions.
SENT = [("bucket", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("value", pa.float64()), ("blob", pa.binary()), ("base", pa.int64()), ("known", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("id", pa.string())]
SENT_KIND = "bucket int, kind byte, key long, value double, blob binary, base long, known long, held_out boolean, n_tokens long, id string"
#: What a bucket adds to the texts from base on: packed numbers for a column (0: base score, 1: known words, 2: score), or a text itself (TEXT).
ADDED_KIND = "base long, what byte, blob binary, key long, value double, known long, held_out boolean, n_tokens long, id string"
TEXT = 3


def _batch(**columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in SENT], names=[c for c, _ in SENT])


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return _batch(**dict(zip(("bucket", "kind", "blob"), map(list, zip(*rows, strict=True)), strict=True)))


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by digits
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), part


def head_of(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent words, `most` of them at the most and the end of texts, and the others. Found from a histogram of logarithms."""
    level = F.floor(F.log2(F.col("n")) * 16)
    left, at = most, None
    # about 16 rows for each doubling of the top count
    for r in sorted(words.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.l):
        if r.n > left:
            break
        left, at = left - r.n, r.l
    inside = (level >= at) | (F.col("word") == END) if at is not None else F.col("word") == END
    return words.filter(inside), words.filter(~inside)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, gain: float = GAIN, head: int = HEAD_WORDS, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs; key keeps its name and type."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), F.lit(10)) == 0
    own = docs.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), fold.alias("held_out"))
    words = stash(word_counts(own.select("text", (~F.col("held_out")).alias("train")), "text", "train"), "words")
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(a) for a, c in (("n", F.col("c")), ("every", F.col("n")), ("v", (F.col("c") > 0).cast("long"))))).first()
    hot = max(hot, int(total.every) // 100_000)

    top, rest = head_of(words, min(head, HEAD_WORDS))
    known = top.toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # at most head + 1 words; ranks pack well
    c = np.r_[known.column("c").to_numpy(), 0].astype(np.float64)
    place = {w: i for i, w in enumerate(known.column("word").to_pylist())}
    place.setdefault(END, len(place))
    hashed = F.arrow_udf(lambda a: _of(word_hash(a.to_pylist())), "long")
    rare = rest.filter("c > 0").select(hashed("word").alias("key"), "c")
    by = rare.groupBy(F.col("key").bitwiseAND(F.lit(CLASSES - 1).cast("long")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()  # CLASSES rows at most
    class_c, class_n = np.zeros(CLASSES), np.zeros(CLASSES)
    class_c[by.column("k").to_numpy()], class_n[by.column("k").to_numpy()] = by.column("c").to_numpy(), by.column("n").to_numpy()
    mass = total.n + 0.1 * (total.v + CLASSES)
    root = Root(
        place, (c + 0.1) / mass, np.log10((c + 0.1) / (total.n + 0.1 * (total.v + 1))), c > 0, np.r_[known.column("n").to_numpy() > hot, False],
        (class_c + 0.1 * (class_n + 1)) / (class_n + 1) / mass, [],
    )
    unseen = np.log10(0.1 / (total.n + 0.1 * (total.v + 1)))

    tables: list[DataFrame] = []
    if root.hot.any():
        at_root = spark.sparkContext.broadcast(root)
        alone = F.arrow_udf(lambda a: pa.array(at_root.value.alone(a.to_numpy().view(np.uint64))), "double")
        tables = hot_levels(own.select("text", "held_out"), root, depth, gain, hot, alone)
    buckets = 1 + (int(total.every) - (int(root.levels[0].every.sum()) if root.levels else 0)) // bucket
    last = number_buckets(root.levels, bucket, buckets)
    if any((~level.kept).any() for level in root.levels[: depth - 1]):
        _settle(own, root, tables, depth, gain, last)
    side = rest.filter("c > 0").select("word", "c").mapInArrow(lambda batches: _sides(batches, buckets, WORD), SENT_KIND)
    sent = spark.sparkContext.broadcast(root)
    for d, each in enumerate(tables, 1):
        side = side.unionByName(hot_sides(each, sent, d))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        held: list[tuple] = []
        size = 0
        for b in batches:
            body, offsets = text_bytes(b.column("text"))
            for i, j in slices(offsets, SPLIT):
                if held and size + offsets[j] - offsets[i] > DEALT:
                    yield from _deal(r, held)
                    held, size = [], 0
                held.append((*encoded(body, offsets[i : j + 1], r), *(b.column(k).slice(i, j - i) for k in ("row", "held_out", "id"))))
                size += int(offsets[j] - offsets[i])
        if held:
            yield from _deal(r, held)

    def _deal(r: Root, texts: list[tuple]) -> list[pa.RecordBatch]:
        """What some texts send: a row each with the head's share of the base score, and their positions by bucket."""
        ids, size, number, held, names = zip(*texts, strict=True)
        p = Positions(np.concatenate(ids), np.concatenate(size), r, depth)
        number, held, names = (pa.concat_arrays(x) for x in (number, held, names))
        number, held = number.to_numpy(), np.asarray(held.to_numpy(zero_copy_only=False), bool)
        n, base, train = len(number), int(number[0]), ~held[p.text]
        ranked = p.ids < TAIL
        at = p.ids[ranked].astype(np.int64)
        add = lambda v: np.bincount(p.text[ranked], weights=v, minlength=n)
        own = _batch(
            bucket=np.full(n, base % buckets, np.int32), kind=np.full(n, DOC, np.int8), key=number, value=add(r.base[at]), base=np.full(n, base), known=add(r.known[at]).astype(np.int64),
            held_out=held, n_tokens=p.size, id=names,
        )
        rows: list[tuple[int, int, bytes]] = []
        cold = np.flatnonzero(~r.is_hot(p.before[0]))
        for k, part in _dealt((mix(p.before[0][cold], np.uint64(COLD)) % np.uint64(buckets)).astype(np.int64)):
            w = cold[part]
            rows.append((k, COLD, pack(base, [*(x[w] for x in p.before), p.ids[w]], p.text[w], train[w])))
        rows += _deal_hot(r, p, base, train, depth)
        tail = np.flatnonzero(~ranked)
        for k, part in _dealt((mix(p.ids[tail], np.uint64(0)) % np.uint64(buckets)).astype(np.int64)):
            rows.append((k, RARE, _keyed(base, p.ids[tail[part]], p.text[tail[part]])))
        return [own, _packed(rows)] if rows else [own]

    # texts are numbered in one scan and only there
    packed = own.withColumn("row", F.monotonically_increasing_id()).mapInArrow(dealt, SENT_KIND).unionByName(side)
    smooth = total.n + 0.1 * (total.v + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["bucket"], 1):
            of = g.column("bucket").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                t = g.slice(x, y - x)
                kind = t.column("kind").to_numpy()
                yield from _bucket(int(of[x]), {k: t.filter(pa.array(kind == k)) for k in np.unique(kind).tolist()})

    def _bucket(number: int, parts: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        if DOC in parts:
            t = parts[DOC].combine_chunks()
            yield _sum_rows(len(t), what=[TEXT] * len(t), **{k: t.column(k).combine_chunks() for k in ADDED if k not in ("what", "blob")})
        if COLD in parts:
            g = Gathered(parts.pop(COLD).column("blob").to_pylist(), depth + 1)
            lp = np.zeros(len(g.train))
            for own in g.turns(0):  # what stands after one symbol is done at once
                symbol = g.take(depth, own)
                lp[own] = np.log10(subtree([g.take(k, own) for k in range(depth)], symbol, g.train[own], r.alone(symbol), gain))
            for base, text, value in g.by_row(lp):
                yield _added(base, 2, text, value)
        if OPEN in parts or WARM in parts:
            known = _sides_of(r, parts)
            for base, text, p in _opened(r, number, parts, known, depth, gain):
                yield _added(base, 2, text, np.log10(p))
            for raw in parts[WARM].column("blob").to_pylist() if WARM in parts else ():
                base, wanted, text = _unkeyed(raw)
                yield _added(base, 2, text, np.log10(_look(known, wanted)[0]))
        counts = _known(parts, WORD, 2)
        for raw in parts[RARE].column("blob").to_pylist() if RARE in parts else ():
            base, wanted, text = _unkeyed(raw)
            value = _look(counts, wanted)[0]
            yield _added(base, 0, text, np.where(value > 0, np.log10((value + 0.1) / smooth), unseen))
            yield _added(base, 1, text, value > 0)

    done = packed.repartition(min(last, PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(scored, ADDED_KIND)
    sums = done.repartition("base").sortWithinPartitions("base").mapInArrow(_summed, "id string, held_out boolean, n_tokens long, what0 double, what1 long, what2 double")
    return sums.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), "held_out", "n_tokens", F.col("what1").alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"),
        F.col("what0").alias("base_score"), F.col("what2").alias("score"),
    )


def _deal_hot(r: Root, p: Positions, base: int, train: np.ndarray, depth: int, only: list[np.ndarray] | None = None) -> list[tuple[int, int, bytes]]:
    """Positions after hot contexts by bucket: by the symbol before the longest hot one, or by texts. only: by level, which contexts are meant."""
    warm = np.flatnonzero(r.is_hot(p.before[0]))
    rows: list[tuple[int, int, bytes]] = []
    if not len(warm):
        return rows
    x = contexts([w[warm] for w in p.before])
    long, at = r.deepest(x)
    for d, level in enumerate(r.levels, 1):
        here = np.flatnonzero(long == d)
        if only is not None:
            here = here[only[d - 1][at[here]]]
        if not len(here):
            continue
        w = warm[here]
        by = x[d][here] if d < depth else (base + p.text[w].astype(np.int64)).astype(np.uint64)
        salt = mix(by, np.uint64(2)) % level.parts[at[here]].astype(np.uint64)
        for k, part in _dealt(level.start[at[here]] + salt.astype(np.int64)):
            o = w[part]
            if d < depth:
                rows.append((k, OPEN, pack(base, [*(v[o] for v in p.before), p.ids[o]], p.text[o], train[o])))
            else:
                rows.append((k, WARM, _keyed(base, combination(x[-1][here[part]], p.ids[o]), p.text[o])))
    return rows


def _known(parts: dict[int, pa.Table], side: int, width: int) -> tuple[np.ndarray, ...]:
    """Keys in order and what is known of them."""
    rows = [np.frombuffer(zstandard.decompress(x), "<u8").reshape(width, -1) for x in parts[side].column("blob").to_pylist()] if side in parts else [np.zeros((width, 0), np.uint64)]
    return _in_order(rows)


def _in_order(rows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    keys, *values = np.concatenate(rows, axis=1)
    order = np.argsort(keys)
    return keys[order], *(v[order].view(np.float64) for v in values)


def _look(known: tuple[np.ndarray, ...], wanted: np.ndarray) -> list[np.ndarray]:
    """What is known of keys, 0 of others."""
    keys, *values = known
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    x = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[x] == wanted
    return [np.where(there, v[x], 0.0) for v in values]


def _opened(r: Root, bucket: int, parts: dict[int, pa.Table], known: tuple[np.ndarray, ...], depth: int, gain: float, tell: bool = False) -> Iterator[tuple]:
    """Of each row of positions after the bucket's hot context: its base, texts and probabilities. tell: (length, context) if a context after it is retained."""
    if OPEN not in parts:
        return
    d, i = r.owner(bucket)
    number = r.levels[d - 1].number[i]
    g = Gathered(parts.pop(OPEN).column("blob").to_pylist(), depth + 1)
    out, told = np.zeros(len(g.train)), False
    for own in g.turns(d):
        x, symbol = np.full(len(own), number), g.take(depth, own)
        p, q = _look(known, combination(x, symbol))
        found = subtree([g.take(k, own) for k in range(d, depth)], symbol, g.train[own], p, gain, x, q, tell)
        if tell:
            told |= bool(found.any())
        else:
            out[own] = found
    if tell:
        if told:
            yield d, number
        return
    yield from g.by_row(out)


def _settle(docs: DataFrame, root: Root, tables: list[DataFrame], depth: int, gain: float, buckets: int) -> None:
    """Retains hot contexts that diverge too little themselves, but have retained ones after longer contexts: a pass over their positions only."""
    only = [~level.kept for level in root.levels]
    sent = docs.sparkSession.sparkContext.broadcast((root, only))
    of_levels = docs.sparkSession.sparkContext.broadcast(root)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, meant = sent.value
        for b in batches:
            body, offsets = text_bytes(b.column("text"))
            held = np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), bool)
            for i, j in slices(offsets, SPLIT):
                p = Positions(*encoded(body, offsets[i : j + 1], r), r, depth)
                rows = [x for x in _deal_hot(r, p, 0, ~held[i:j][p.text], depth, meant) if x[1] == OPEN]
                if rows:
                    yield _packed(rows)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["bucket"], 1):
            kind, of = g.column("kind").to_numpy(), g.column("bucket").to_numpy()
            for k in np.unique(of).tolist():
                parts = {x: g.filter(pa.array((kind == x) & (of == k))) for x in (LEVEL, OPEN)}
                parts = {x: t for x, t in parts.items() if len(t)}
                r = of_levels.value
                for d, x in _opened(r, k, parts, _sides_of(r, parts), depth, gain, tell=True):
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), _of(np.array([x], np.uint64))], names=["d", "x"])

    packed = docs.select("text", "held_out").mapInArrow(dealt, SENT_KIND)
    for d, each in enumerate(tables[: depth - 1], 1):
        open_ = pa.array(root.levels[d - 1].number[only[d - 1]].view(np.int64)).to_pylist()  # at most N / hot
        if open_:
            packed = packed.unionByName(hot_sides(each.filter(F.col("x").isin(open_)), of_levels, d))
    found = packed.repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(told, "d int, x long").distinct().toArrow()
    for d, level in enumerate(root.levels, 1):
        x = found.column("x").to_numpy().view(np.uint64)[found.column("d").to_numpy() == d]
        level.kept[level.find(x)] = True
    _close(root.levels)


ADDED = ["base", "what", "blob", "key", "value", "known", "held_out", "n_tokens", "id"]


def _keyed(base: int, key: np.ndarray, text: np.ndarray) -> bytes:
    return _small(np.array([base, len(key)], "<i8").tobytes(), key.tobytes(), _planes(np.diff(text, prepend=0)))


def _unkeyed(raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    base, n = np.frombuffer(raw, "<i8", 2).tolist()
    return base, np.frombuffer(raw, "<u8", n, 16), np.cumsum(_numbers(raw[16 + 8 * n :], n).astype(np.int64))


def _sum_rows(n: int, **columns) -> pa.RecordBatch:
    kinds = dict(SENT) | {"what": pa.int8()}
    cast = lambda c: c if isinstance(c, pa.Array) else pa.array(c)
    return pa.RecordBatch.from_arrays([cast(columns[c]).cast(kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in ADDED], names=ADDED)


def _added(base: int, what: int, text: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """The sums of a packed row by text; logarithms are not above 0 and go without their sign."""
    sums = np.bincount(text, weights=value if what == 1 else np.rint(-UNIT * value))
    here = np.flatnonzero(np.bincount(text))
    blob = _small(np.array([len(here)], "<i8").tobytes(), _planes(np.diff(here, prepend=0)), _planes(np.maximum(sums[here], 0), 8))
    return _sum_rows(1, base=[base], what=[what], blob=[blob])


def _sides(batches: Iterator[pa.RecordBatch], buckets: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows of (word, c), packed for the buckets of their words."""
    for b in batches:
        k = word_hash(b.column("word").to_pylist())
        c = b.column("c").to_numpy().astype(np.float64).view(np.uint64)
        rows = [(x, kind, _small(np.stack([k[part], c[part]]).tobytes())) for x, part in _dealt((mix(k, np.uint64(0)) % np.uint64(buckets)).astype(np.int64))]
        if rows:
            yield _packed(rows)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the sums of what was added to them, by the chunk that they were dealt with."""
    for g in sorted_groups(batches, ["base"], 1):
        of = g.column("base").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            t = g.slice(x, y - x)
            what = t.column("what").to_numpy()
            docs = t.filter(pa.array(what == TEXT)).sort_by("key")
            sums = np.zeros((3, len(docs)))
            for raw, k in zip(t.column("blob").to_pylist(), what.tolist(), strict=True):
                if k != TEXT:
                    raw = memoryview(zstandard.decompress(raw))
                    n = int(np.frombuffer(raw, "<i8", 1)[0])
                    text = np.cumsum(_numbers(raw[8:], n).astype(np.int64))
                    sums[k, text] += _numbers(raw[8 + 4 * n :], n, 8)
            base, known = docs.column("value").to_numpy() - sums[0] / UNIT, docs.column("known").to_numpy() + sums[1].astype(np.int64)
            own = [docs.column(c).combine_chunks() for c in ("id", "held_out", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(base), pa.array(known), pa.array(-sums[2] / UNIT)], names=["id", "held_out", "n_tokens", "what0", "what1", "what2"])


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
