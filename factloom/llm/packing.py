"""Best-fit packing of token pieces into sequences, with gaps filled by exact complements.

A document's ids and an end id are cut into pieces of a sequence's length; what is left over is the first piece. The
plan is made from the number of pieces of each length alone, a table of as many rows as a sequence has tokens, so it is
the same work for any corpus. Pieces longer than a threshold are placed best fit first. Then an index of the lengths
that are still there, one by one, in pairs and in triples, is asked for each gap, and combinations that fill it exactly
are taken as often as their lengths are available. Residuals are placed best fit. Thresholds are tried until a plan
needs no more than the lower bound says or all were tried; the shortest plan holds. Pieces of one length are
alike, so a step takes any number of them at once.

A piece finds its place by its rank among the pieces of its length. Ranks come from counts by length and salt: a length
has as many salts as its count asks for (GROUP rows each), so that no length goes to one task whole.

Defined cases: a null text is empty and has the end id alone; null and repeated ids are documents of their own; texts of
any length; an empty table gives an empty result; extra columns are ignored by pieces() and kept by pack(), which gives
its own columns a trailing underscore where a name is taken.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, slices, stash, table, text_bytes
from .tokencount import PATTERN

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, END = 1024, 2
#: Rows of a length that are ranked together.
GROUP = 5000
#: Thresholds that are tried: pieces up to so many tokens wait for gaps that they fill exactly.
THRESHOLDS = (0, *range(64, 257, 16))
#: Bytes of text whose pieces a task holds at a time.
CHUNK = 1 << 22


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file; ids are those that the file's own library gives (tested)."""
    told = json.loads(Path(vocabulary).read_text())
    # printable characters stand for themselves, the other bytes for characters from 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = (b for b in range(256) if b not in plain)
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document; with their ids if asked for."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        for b in batches:
            for i, j in slices(text_bytes(b.column("text"))[1], CHUNK):
                rows, told, held = [], [], []
                for k, x in enumerate(b.column("text")[i:j].to_pylist(), i):
                    own = np.append(encode(x or "", allowed_special="all"), end).astype("<u4")
                    at = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    rows += [k] * (len(at) - 1)
                    for n, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                        told.append((n, lo, hi - lo, zlib.crc32(own[lo:hi])))
                        if ids:
                            held.append(own[lo:hi].astype(np.int32))
                n, lo, size, crc = np.array(told, np.int64).reshape(-1, 4).T
                columns = [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in (lo, size, crc))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.list_(pa.int32()))] if ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    return own.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and by pieces that can't share one."""
    best = -(-sum(n * k for n, k in enumerate(counts)) // capacity)
    half = capacity // 2
    for small in range(half + 1):
        alone, most = sum(counts[capacity - small + 1 :]), range(half + 1, capacity - small + 1)
        large = sum(counts[n] for n in most)
        room = large * capacity - sum(n * counts[n] for n in most)
        rest = sum(n * counts[n] for n in range(max(small, 1), half + 1))
        best = max(best, alone + large + max(0, -(-(rest - room) // capacity)))
    return best


class Plan:
    """Sequences by what they hold: space left -> [lengths, how many sequences]."""

    def __init__(self, counts: list[int], capacity: int) -> None:
        self.counts, self.capacity = list(counts), capacity
        self.open: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def _put(self, held: tuple[int, ...], n: int) -> None:
        self.open.setdefault(self.capacity - sum(held), []).append((held, n))

    def best_fit(self, least: int, most: int) -> None:
        """Places the pieces of these lengths, longest first, each where it leaves the least space."""
        for size in range(most, least - 1, -1):
            n, self.counts[size] = self.counts[size], 0
            while n:
                space = next((s for s in range(size, self.capacity + 1) if self.open.get(s)), None)
                held, there = self.open[space].pop() if space is not None else ((), n)
                each = min((space or self.capacity) // size, n)  # the rest of the space is where the next one fits best
                used = min(there, n // each)
                if held and there > used:
                    self.open[space].append((held, there - used))
                self._put(held + (size,) * each, used)
                n -= used * each

    def complement(self, gap: int, most: int) -> tuple[int, ...] | None:
        """One, two or three available lengths of that sum, the longest first."""
        have = self.counts
        if gap <= most and have[gap]:
            return (gap,)
        for a in range(min(gap - 1, most), (gap + 1) // 2 - 1, -1):
            if have[a] and have[gap - a] > (a == gap - a):
                return (a, gap - a)
        for a in range(min(gap - 2, most), (gap + 2) // 3 - 1, -1):
            for b in range(min(a, gap - a - 1), (gap - a + 1) // 2 - 1, -1) if have[a] else ():
                found = (a, b, gap - a - b)
                if all(have[x] >= k for x, k in Counter(found).items()):
                    return found
        return None

    def fill_exactly(self, most: int) -> None:
        """Fills gaps, the smallest first, with combinations of pieces of up to that length."""
        for gap in sorted(g for g in self.open if 0 < g < self.capacity):
            groups, self.open[gap] = self.open[gap], []
            while groups and (found := self.complement(gap, most)):
                held, there = groups.pop()
                need = Counter(found)
                n = min(there, *(self.counts[x] // k for x, k in need.items()))
                for x, k in need.items():
                    self.counts[x] -= k * n
                self._put(held + found, n)
                if there > n:
                    groups.append((held, there - n))
            self.open[gap] += groups

    def patterns(self) -> list[tuple[tuple[int, ...], int]]:
        return [(held, n) for groups in self.open.values() for held, n in groups]


def plan(counts: list[int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """What sequences hold (lengths in order), and how many are alike. counts[n]: pieces of length n."""
    enough, best = lower_bound(counts, capacity), None
    for t in THRESHOLDS:
        if t >= capacity:
            break
        tried = Plan(counts, capacity)
        tried.best_fit(t + 1, capacity)
        tried.fill_exactly(t)
        tried.best_fit(1, t)
        found = tried.patterns()
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) <= enough:
            break
    return best


def places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> list[np.ndarray]:
    """For each length, rows (first rank, its sequence, offset): ranks from there to the next row's go to sequences one after the other."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    used, base = [0] * (capacity + 1), 0
    for held, n in patterns:
        offset = 0
        for size in held:
            rows[size].append((used[size], base, offset))
            used[size] += n
            offset += size
        base += n
    return [np.array(r, np.int64).reshape(-1, 3) for r in rows]


def pack(df: DataFrame, capacity: int = CAPACITY, length: str = "length", sequence: str = "sequence_id", offset: str = "offset") -> DataFrame:
    """df with each row's sequence and the place there. Lengths are from 1 to capacity; rows are told apart by all their columns that sort."""
    rows = stash(df, "pieces")
    counts = [0] * (capacity + 1)
    for r in rows.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n")).collect():
        if r.length is None or not 0 < r.length <= capacity:
            raise ValueError(f"a length of {r.length} doesn't fit a sequence of {capacity}")
        counts[r.length] = r.n
    where = places(plan(counts, capacity), capacity)
    own = rows.columns
    names = list(own)
    for n in (sequence, offset, "salt", "rank", "before"):
        names.append(fresh(names, n))
    sequence, offset, salt, rank, before = names[len(own) :]
    by = [n for n, k in rows.dtypes if not k.startswith(("map", "variant"))]
    salts = F.element_at(F.lit([max(1, -(-n // GROUP)) for n in counts[1:]]), F.col(length).cast("int"))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*by), salts.cast("long")))
    first = salted.groupBy(F.col(length).alias("l"), F.col(salt).alias("s")).agg(F.count("*").alias("n"))
    first = first.select("l", "s", (F.sum("n").over(Window.partitionBy("l").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias(before))
    within = Window.partitionBy(length, salt).orderBy(*by)
    ranked = salted.withColumn(rank, F.row_number().over(within)).join(first, (F.col(length) == F.col("l")) & (F.col(salt) == F.col("s")))
    ranked = ranked.select(*own, (F.col(rank) - 1 + F.col(before)).alias(rank))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, r = b.column(length).to_numpy(), b.column(rank).to_numpy()
            seq, off = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(b) else ():
                told = where[size[part[0]]]
                at = np.searchsorted(told[:, 0], r[part], "right") - 1
                seq[part], off[part] = told[at, 1] + r[part] - told[at, 0], told[at, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], names=[*own, sequence, offset])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(placed, f"{kinds}, `{sequence}` long, `{offset}` long")


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from packed pieces with their ids; a group has at most capacity ids."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.flatten(F.col("held.ids")).alias("ids"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 1024 tokens; odd rows as in the module's docstring."""
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
