"""Contributions that are dropped into a folder, published batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources import store
from factloom.sources.shared import stash

#: A drop holds rows of all tables: the table's name and the row as JSON.
DROP = "table string, row string"


#: Units that an error names.
NAMED = 20


class Refused(Exception):
    """Units of a drop that break rules."""


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a drop; those that a drop may leave out are empty then."""
    return {t: rows.filter(F.col("table") == t).select(F.from_json("row", s).alias("r")).select("r.*") for t, s in store.TABLES.items()}


def as_drop(batch: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(t).alias("table"), F.to_json(F.struct(*df.columns)).alias("row")) for t, df in batch.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def publish(rows: DataFrame, root: str, refused: str | None = None) -> DataFrame:
    """Publishes a drop's units and returns the problems (unit, rule, reason).

    refused: a folder for the rows of units with problems, each with its rule and reason; the others are published.
    Without it a drop with problems isn't published at all and Refused names them.
    """
    spark, batch = rows.sparkSession, split(rows)
    live = store.snapshot(spark, root)["unit"].select("unit", "fact_label")
    bad = stash(store.problems(batch, live), "problems")
    first = bad.orderBy("unit").limit(NAMED).collect()
    if first and refused is None:
        raise Refused(f"{bad.count()} units are refused: " + "; ".join(f"{r.unit!r}: {r.reason}" for r in first))
    if first:
        kept = {t: df.join(bad.select("unit"), "unit", "left_anti") for t, df in batch.items()}
        gone = {t: df.join(bad.select("unit"), "unit", "left_semi") for t, df in batch.items()}
        told = as_drop(gone).withColumn("unit", F.get_json_object("row", "$.unit")).join(bad, "unit")
        told.write.mode("append").parquet(refused)
        batch = kept
    _, left = store.publish(spark, root, batch)
    if again := left.limit(NAMED).collect():  # another publication came between
        raise Refused("; ".join(f"{r.unit!r}: {r.reason}" for r in again))
    return bad


def watch(spark: SparkSession, folder: str, root: str, checkpoint: str, once: bool = True, refused: str | None = None) -> StreamingQuery:
    """A stream that publishes each micro-batch; units told apart by slot replace what they published before. refused: as of publish."""

    def put(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            publish(rows, root, refused)
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(DROP).parquet(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="30 seconds")).start()
