"""Helpers shared by the training-data operators: shared storage, Arrow text access, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table: A-Z to a-z, all else unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one of our own only where that is unset."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    elif told and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(told)
    return told or sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there and survives a lost executor."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of the input's has (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, end to end, and the offsets of its n rows (n + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[pa.Table]:
    """Tables of whole key groups, about limit rows each, from batches in which the rows of a key stand together."""

    def last_start(t: pa.Table) -> int:
        """Where the last group begins."""
        same = np.ones(len(t), bool)
        for k in keys:
            x = t.column(k).combine_chunks()
            same &= np.asarray(pc.equal(x, x[len(t) - 1]).fill_null(False), bool)
        return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) < limit:
            continue
        t = pa.Table.from_batches(held)
        if at := last_start(t):
            yield t.slice(0, at)
            held = t.slice(at).combine_chunks().to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list, root being the least node of its component.

    Contraction: each node points to the least of itself and its neighbours, pointers are followed by doubling to where
    they end, edges are renamed so and those within a node go. Chains of any length end in one round, whose doublings
    are the logarithm of the longest. All steps are aggregations combined before the shuffle and equi-joins.
    """
    edges = stash(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "least")
        while True:
            far = stash(least.join(least.toDF("root", "next"), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "least")
            least = far.drop("moved")
            if far.filter("moved").isEmpty():
                break
        maps.append(least)
        edges = stash(
            edges.join(least.toDF("a", "ra"), "a").join(least.toDF("b", "rb"), "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        return found.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return reduce(follow, maps[1:], maps[0])


def arrow_column(f: Callable[[pa.Array], pa.Array], kind: str) -> Callable:
    """A column function that Spark hands whole Arrow arrays."""
    return F.arrow_udf(f, kind)
