"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has the majority bits of the XXH64 hashes of its word shingles. Two fingerprints link if they
differ in at most RADIUS bits. Bit j of a fingerprint is given a vector m(j) of RADIUS + 1 bits, none of them zero;
table v, for each non-zero v of RADIUS + 1 bits, keeps the bits j with an odd number of ones in m(j) & v. RADIUS
differing bits give RADIUS vectors, and some non-zero v is orthogonal to all of them: there the two fingerprints'
kept bits are equal, so every pair within the radius meets in some table, without exception.

Equal fingerprints are one node from the start. A bucket is compared as a whole inside one task up to BLOCK nodes;
a larger one is dealt into blocks and each pair of blocks is compared by itself, so no task holds more than two
blocks. Comparisons give a spanning forest, not all pairs. Components come from contraction (common.components).

Defined cases: null and empty texts, and those without words, have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; ids may be null or repeated (a component of null ids only has a null id);
an empty table gives an empty result; added columns get a trailing underscore where a name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_column, components, fresh, sorted_groups, stash, table

RADIUS, BITS = 3, 64
#: Nodes compared at once: a block against a block is a matrix of BLOCK x BLOCK numbers of 8 bytes.
BLOCK = 1024


def simhash(text: str | None, words: int, seed: int = 42) -> int:
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), seed) for i in range(n)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 5) -> Column:
    """The fingerprint as a long (its 64 bits, signed)."""

    def hashed(a: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((simhash(x.as_py(), words) for x in a), np.uint64, len(a)).view(np.int64))

    return arrow_column(hashed, "long")(text)


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The kept bits of each table. The vectors 1, 2, ... go round the bits, so that tables keep about as many each."""
    size = 2 ** (radius + 1)
    vector = [1 + j % (size - 1) for j in range(bits)]
    return [sum(1 << j for j in range(bits) if bin(vector[j] & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the nodes within the radius of each other."""
    n, parent = len(fp), np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    bits = fp.view(np.uint64)
    for lo in range(0, n, 256):
        near = np.bitwise_count(bits[lo : lo + 256, None] ^ bits[None, :]) <= radius
        near &= np.arange(n)[None, :] > np.arange(lo, min(n, lo + 256))[:, None]
        for i, j in zip(*np.nonzero(near), strict=True):
            if (a := root(i + lo)) != (b := root(j)):
                parent[max(a, b)] = min(a, b)
                out.append((int(fp[i + lo]), int(fp[j])))
    return out


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): fingerprints within the radius of each other, enough of them to connect all that are connected.

    nodes: a column fp without repeats.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for t, m in enumerate(masks(radius))))
    keyed = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    sizes = stash(keyed.groupBy("t", "k").count().filter("count > 1").withColumn("parts", F.ceil(F.col("count") / block).cast("int")).drop("count"), "buckets")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meet = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("mine")).cast("long") * F.col("parts") + F.greatest(j, F.col("mine")))
    )
    dealt = keyed.join(sizes, ["t", "k"]).withColumn("mine", mine).select("t", "k", "fp", F.explode(meet).alias("pair"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["t", "k", "pair"], 50_000):
            key = np.stack([g.column(c).to_numpy() for c in ("t", "k", "pair")])
            at = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
            fp = g.column("fp").to_numpy()
            pairs = [x for i, j in zip(at[:-1], at[1:], strict=True) if j - i > 1 for x in _forest(np.ascontiguousarray(fp[i:j]), radius)]
            if pairs:
                a = np.array(pairs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    ordered = dealt.repartition("t", "k", "pair").sortWithinPartitions("t", "k", "pair")
    return ordered.mapInArrow(compared, "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, least): each fingerprint's component, named by the least fingerprint in it, and the least id of the component.

    prints: (id, fp), a row for each text. Ids are reduced by fingerprint, then by component, so that texts themselves
    are only joined with a table that has each fingerprint once.
    """
    nodes = stash(prints.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    of = components(links(nodes.select("fp"), radius)).toDF("fp", "root")
    named = nodes.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    return stash(named.join(least, "root").select("fp", "root", "least"), "groups")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, radius: int = RADIUS, fp: str = "fingerprint", component: str = "component_id") -> DataFrame:
    """df with each row's fingerprint (long) and its component's least id."""
    fp, component = fresh(df.columns, fp), fresh(df.columns, component)
    prints = stash(df.select(F.col(key).alias("id"), fingerprint(F.col(text), words).alias("fp")), "fingerprints")
    of = groups(prints, radius).select(F.col("fp").alias(fp), F.col("least").alias(component))
    return df.withColumn(fp, fingerprint(F.col(text), words)).join(of, fp).select(*df.columns, fp, component)


def first_of_groups(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, radius: int = RADIUS) -> DataFrame:
    """df's rows, one of each near-duplicate group: that with the least id; of rows that share it, any one. A group of null ids keeps one row."""
    prints = stash(df.select(F.col(key).alias("id"), fingerprint(F.col(text), words).alias("fp")), "fingerprints")
    of = prints.join(groups(prints, radius), "fp").filter(F.col("id").eqNullSafe(F.col("least")))
    own, ident, of_text = fresh(df.columns, "fp"), fresh(df.columns, "least"), fresh(df.columns, "print")
    chosen = of.groupBy("root", F.col("id").alias(ident)).agg(F.min("fp").alias(own), F.count("*").alias("rows"))
    chosen = stash(chosen.drop("root"), "chosen")
    out = df.withColumn(of_text, fingerprint(F.col(text), words)).join(chosen.select(own, ident), (F.col(of_text) == F.col(own)) & F.col(key).eqNullSafe(F.col(ident)))
    if not chosen.filter("rows > 1").isEmpty():  # rows that repeat an id
        out = out.dropDuplicates([of_text, key])
    return out.select(df.columns)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = stash(docs.select(F.col("doc_id").alias("id"), fingerprint(F.col("text"), 3).alias("fp")), "fingerprints")
    named = prints.join(groups(prints), "fp")
    return named.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))
