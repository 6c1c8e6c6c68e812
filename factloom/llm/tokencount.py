"""Edit-aware token counts: a segment tree over each document's pre-tokens, of which edits renew only what they touch.

A document's leaves are its pre-tokens: length in characters and number of tokens. Leaves are kept in the document's row;
the levels above, each an array of sums of pairs of the one below, are summed up when a row is read. An edit (start, length, replacement) goes down the tree to the
first leaf that it can touch: a pre-token is decided by its own characters and up to CONTEXT characters after its
start or one after its end, so re-encoding begins at the first leaf whose decision can see the edit. It goes on until a
pre-token of the new text ends where one of the old text ended, beyond the edit; leaves from there on are kept as they
are. If as many leaves come as go, sums are renewed on the paths above them alone, else also to the right of them, where
pairs shift. Edits apply one after the other, each to the text
that the one before it left.

Tokens are counted with a byte-level BPE vocabulary that is given as a file of ranks; its path is a parameter.

Defined cases: a null text is empty and has no leaves; an edit's start and length are cut to the text; a null edit list
or replacement is none or empty; repeated rows and null ids are rows of their own; texts of any length; an empty table
gives an empty result; input columns keep their names and added ones get a trailing underscore where a name is taken.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, slices, table, text_bytes

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters from a pre-token's start that its pattern may look at before it has matched any more ("'re" and the like).
CONTEXT = 3
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 200_000


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Callable[[str], int]:
    """The number of tokens of a pre-token."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    known: dict[str, int] = {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            n = len(encode(piece.encode()))
            if len(known) >= REMEMBERED:
                known.clear()
            known[piece] = n
        return n

    return count


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


class Tree:
    """A document's pre-tokens: levels of (characters, tokens) sums, leaves first. Leaves stand in `levels[0]`."""

    def __init__(self, leaves: np.ndarray) -> None:
        self.levels = [leaves]
        self._above(0)

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> Tree:
        pieces = pattern().findall(text)
        return cls(np.array([(len(p), count(p)) for p in pieces], np.int64).reshape(-1, 2))

    def _above(self, level: int, first: int = 0) -> None:
        """Renews the sums over places from `first` of a level."""
        while len(self.levels[level]) > 1:
            low, first = self.levels[level], first // 2
            part = low[2 * first :]
            sums = part[0::2].copy()
            sums[: len(part) // 2] += part[1::2]
            level += 1
            kept = self.levels[level][:first] if level < len(self.levels) else np.zeros((0, 2), np.int64)
            new = np.concatenate([kept, sums])
            if level < len(self.levels):
                self.levels[level] = new
            else:
                self.levels.append(new)
        del self.levels[level + 1 :]

    @property
    def characters(self) -> int:
        return int(self.levels[-1][:, 0].sum())

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][:, 1].sum())

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The first leaf that ends after that character, and where it starts; the number of leaves and the end if none does."""
        if place >= self.characters:
            return len(self.levels[0]), self.characters
        i, at = 0, 0
        for low in reversed(self.levels):
            i *= 2 if low is not self.levels[-1] else 1
            while at + low[i, 0] <= place:
                at += int(low[i, 0])
                i += 1
        return i, at

    def replace(self, first: int, last: int, leaves: np.ndarray) -> None:
        """Puts leaves in place of those from first to last - 1; as many leaves renew just the paths above them."""
        low = self.levels[0]
        if len(leaves) == last - first:
            low[first:last] = leaves
            a, b = first, last
            for level in range(1, len(self.levels)):
                a, b = a // 2, (b + 1) // 2
                below = self.levels[level - 1]
                part = below[2 * a : 2 * b]
                sums = part[0::2].copy()
                sums[: len(part) // 2] += part[1::2]
                self.levels[level][a:b] = sums
            return
        self.levels[0] = np.concatenate([low[:first], leaves, low[last:]])
        self._above(0, max(0, first - 1))

    def edit(self, text: str, start: int, length: int, put: str, count: Callable[[str], int]) -> tuple[str, int]:
        """The text after the edit, and how many pre-tokens were encoded anew; the tree is that of the new text then."""
        start = min(max(start, 0), len(text))
        stop = min(start + max(length, 0), len(text))
        new = text[:start] + put + text[stop:]
        shift = len(new) - len(text)
        first, at = self.leaf_at(max(0, start - CONTEXT))
        leaves: list[tuple[int, int]] = []
        last, end = first, at  # old leaves before `last` are gone; they end at `end`
        place = at
        while place < len(new):
            piece = pattern().match(new, place).group()
            leaves.append((len(piece), count(piece)))
            place += len(piece)
            while last < len(self.levels[0]) and end < place - shift:
                end += int(self.levels[0][last, 0])
                last += 1
            if place >= start + len(put) and end >= stop and end == place - shift:
                break
        else:
            last = len(self.levels[0])
        self.replace(first, last, np.array(leaves, np.int64).reshape(-1, 2))
        return new, len(leaves)


LEAVES = "array<struct<chars:int,tokens:int>>"
EDITS = "array<struct<start:int,length:int,put:string>>"
_LEAF = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
#: Bytes of text whose trees and results a task holds at a time.
CHUNK = 1 << 20


def _pack(trees: list[np.ndarray]) -> pa.Array:
    """Leaves of some texts as one column."""
    flat = np.concatenate([np.zeros((0, 2), np.int64), *trees]).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], fields=list(_LEAF.value_type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(t) for t in trees])].astype(np.int32)), inner).cast(_LEAF)


def _unpack(leaves: pa.Scalar) -> np.ndarray:
    own = leaves.values
    return np.stack([own.field(0).to_numpy(), own.field(1).to_numpy()], axis=1).astype(np.int64) if own is not None and len(own) else np.zeros((0, 2), np.int64)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of CHUNK bytes of text, or of one row."""
    for b in batches:
        for i, j in slices(text_bytes(b.column(text))[1], CHUNK):
            yield b.slice(i, j - i)


def build(df: DataFrame, text: str = "text", leaves: str = "leaves", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the leaves of each text's tree."""
    name = fresh(df.columns, leaves)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in _parts(batches, text):
            own = _pack([Tree.of(x or "", count).levels[0] for x in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, own], names=[*b.schema.names, name])

    return df.mapInArrow(built, _schema(df, f"`{name}` {LEAVES}"))


def apply_edits(df: DataFrame, text: str = "text", leaves: str = "leaves", edits: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with text and leaves as the edits leave them, and n_before, n_after (tokens), n_pretokens and n_encoded (pre-tokens)."""
    put = {n: fresh(df.columns, n) for n in ("n_before", "n_after", "n_pretokens", "n_encoded")}

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in _parts(batches, text):
            out: dict[str, list] = {n: [] for n in ("text", "trees", *put)}
            for new, x, e in zip(b.column(text).to_pylist(), b.column(leaves), b.column(edits).to_pylist(), strict=True):
                new = new or ""
                tree = Tree(_unpack(x))
                out["n_before"].append(tree.tokens)
                encoded = 0
                for c in e or ():
                    if c is not None:
                        new, n = tree.edit(new, c["start"] or 0, c["length"] or 0, c["put"] or "", count)
                        encoded += n
                for n, v in (("text", new), ("trees", tree.levels[0]), ("n_after", tree.tokens), ("n_pretokens", len(tree.levels[0])), ("n_encoded", encoded)):
                    out[n].append(v)
            own = {text: pa.array(out["text"], pa.string()), leaves: _pack(out["trees"])}
            yield pa.RecordBatch.from_arrays([own.get(n, c) for n, c in zip(b.schema.names, b.columns, strict=True)] + [pa.array(out[n], pa.int64()) for n in put], names=[*b.schema.names, *put.values()])

    return df.mapInArrow(edited, _schema(df, ", ".join(f"`{n}` long" for n in put.values())))


def sample_edits(key: Column, text: Column) -> Column:
    """Three edits of each document that its id decides: a cut near the start, a word put into the middle, a passage swapped near the end."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    h = F.pmod(F.xxhash64(key), F.lit(1000)).cast("int")
    edit = lambda start, length, put: F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), put.alias("put"))
    return F.array(
        edit(F.floor(n * h / 4000), 7, F.lit("")),
        edit(F.floor(n * (h + 1000) / 4000), 0, F.concat(F.lit(" edit"), h.cast("string"), F.lit("'s\n"))),
        edit(F.floor(n * (h + 3000) / 4000), 20, F.lit("déjà vu, 2024")),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = build(docs).withColumn("edits", sample_edits(F.col("doc_id"), F.col("text")))
    return apply_edits(kept).select("doc_id", "n_before", "n_after", "n_pretokens", "n_encoded", F.sha2("text", 256).alias("text_sha256"))
