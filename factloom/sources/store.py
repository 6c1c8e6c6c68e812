"""Generations of fact tables: contributions are validated, slots replaced, and the result written as a new generation.

Rows are dealt to BUCKETS folders of each table by a hash of the slot that owns them. A generation is a list of such
folders; a publication writes the buckets that its slots fall in and lists the others as they are, so its work follows
what changes and not what is stored. A log of publications, appended to as Parquet, says which are committed. Readers
take the last committed one, so a failed or running publication is never seen. Replacement is functional: rows owned by
slots that leave are anti-joined, new ones united, shared symbols kept while a unit has them.

A store has a row of meta data from its first publication on; what isn't there, is of another kind, version or
workspace is refused with a code before anything is read or written.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from factloom.functions import identity
from factloom.functions.identity import is_repo_path
from factloom.operators import facts

#: Tables of a contribution; each row is owned by its unit.
SCHEMAS = {
    "unit": "unit string, fact_label string, command_id string, replay_id string, status string",
    "symbol": "unit string, symbol string, key string, name string, qualified string, kind string, signature string, placeholder boolean",
    "location": "unit string, symbol string, role string, path string, b_off long, e_off long",
    "evidence": "unit string, source string, target string, kind string, confidence string, dispatch string, path string, b_off long",
    "input": "unit string, path_key string, role string, hash string, repo_path string",
}
#: Tables that a contribution may leave out.
OPTIONAL = {
    "unresolved": "unit string, symbol string, expression string, reason string, path string, b_off long",
    "include": "unit string, id string, includer string, path string, b_off long, directive string, operand_kind string, operand string, expanded string, activity string, resolution string, target string",
    "include_term": "unit string, id string, branch int, term int, is_else boolean, kind string, expression string",
}
TABLES = SCHEMAS | OPTIONAL
LOG = "generation long, state string, installed long, retired long, message string, at timestamp"
FOLDERS = "generation long, table string, bucket int, folder string"
#: Fixed values of this library: what a store's meta data starts with, and its version.
MAGIC, VERSION = "factloom-store", 2
META = "magic string, version int, workspace string, profile string, uht boolean"
BUCKETS = 64


class StoreError(Exception):
    """code: db_missing, db_foreign, db_schema_version, db_root_mismatch or unknown_profile."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def profiles(spark: SparkSession, root: str) -> list[str]:
    """The profiles' names in order."""
    return [r.profile for r in _rows(spark, f"{root}/meta", META).select("profile").distinct().orderBy("profile").collect()]


def open_store(spark: SparkSession, root: str, workspace: str | None = None, profile: str | None = None):
    """The meta row of a profile (the only one where none is named); StoreError where the store can't serve it."""
    try:
        meta = spark.read.parquet(f"{root}/meta")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise StoreError("db_foreign", f"{root} has no readable meta data") from e
        found = not _missing(spark, root)
        raise StoreError("db_foreign" if found else "db_missing", f"{root} is {'not a store' if found else 'not there'}") from e
    rows = meta.collect() if set(meta.columns) >= {x.split(" ")[0] for x in META.split(", ")} else []
    if not rows or any(r.magic != MAGIC for r in rows):
        raise StoreError("db_foreign", f"{root} is not a store")
    if any(r.version != VERSION for r in rows):
        raise StoreError("db_schema_version", f"{root} has version {rows[0].version}, not {VERSION}")
    if workspace is not None and any(r.workspace not in (None, workspace) for r in rows):
        raise StoreError("db_root_mismatch", f"{root} belongs to {rows[0].workspace}")
    own = [r for r in rows if profile in (None, r.profile)]
    if not own:
        raise StoreError("unknown_profile", f"no profile {profile!r}")
    return min(own, key=lambda r: r.profile)


def _missing(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return not fs.exists(path) or not fs.listStatus(path)


def log(spark: SparkSession, root: str) -> DataFrame:
    return _rows(spark, f"{root}/log", LOG)


def current(spark: SparkSession, root: str) -> int:
    """The last committed generation; 0 before the first."""
    return log(spark, root).filter("state = 'succeeded'").agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]


def interrupted(spark: SparkSession, root: str) -> DataFrame:
    """(generation, at) of publications that began and neither ended nor failed."""
    return log(spark, root).groupBy("generation").agg(F.max(F.col("state").isin("succeeded", "failed")).alias("ended"), F.max("at").alias("at")).filter("NOT ended").select("generation", "at")


def _folders(spark: SparkSession, root: str, generation: int) -> list:
    """A row for each table and bucket that has rows: TABLES times BUCKETS at most."""
    return _rows(spark, f"{root}/folders", FOLDERS).filter(F.col("generation") == generation).collect()


def snapshot(spark: SparkSession, root: str, generation: int | None = None) -> dict[str, DataFrame]:
    """The tables of one generation, which later publications don't change."""
    n = current(spark, root) if generation is None else generation
    of: dict[str, list[str]] = {}
    for r in _folders(spark, root, n) if n else ():
        of.setdefault(r.table, []).append(r.folder)
    return {t: spark.read.schema(s).parquet(*sorted(of[t])) if t in of else spark.createDataFrame([], s) for t, s in TABLES.items()}


def exclude(spark: SparkSession, root: str, paths: list[str]) -> None:
    """Sets the files that are withheld whatever is on disk, in place of those set before."""
    told = _rows(spark, f"{root}/excluded", "version long, path string")
    n = told.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    spark.createDataFrame([(n, p) for p in paths] or [(n, None)], "version long, path string").write.mode("append").parquet(f"{root}/excluded")


def excluded(spark: SparkSession, root: str) -> DataFrame:
    told = _rows(spark, f"{root}/excluded", "version long, path string")
    return told.join(told.agg(F.max("version").alias("version")), "version").filter("path IS NOT NULL").select("path").distinct()


def problems(batch: dict[str, DataFrame], live: DataFrame | None = None, retire: DataFrame | None = None) -> DataFrame:
    """(unit, rule, reason): the first rule that each unit of a batch breaks.

    live: the units (unit, fact_label) that are committed; retire: a column unit, those that leave with the batch.
    """
    u, s, l, e, i = (batch[t] for t in SCHEMAS)
    told = lambda df, n, why: df.select("unit", F.lit(n).alias("rule"), F.lit(why).alias("reason"))
    known = s.select("unit", "symbol")
    lacks = lambda df, c: df.join(known.withColumnRenamed("symbol", c), ["unit", c], "left_anti")
    bad_path = lambda c: F.col(c).isNotNull() & (F.col(c) != "") & ~is_repo_path(F.col(c))
    digest = F.concat(F.lit("cm1:"), F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 32))
    rules = [
        told(u.filter("coalesce(unit, '') = ''"), 0, "the slot is blank"),
        told(u.groupBy("unit").count().filter("count > 1"), 1, "the slot is given twice"),
        told(u.join(u.groupBy("fact_label").agg(F.count_distinct("unit").alias("n")).filter("n > 1"), "fact_label", "left_semi"), 2, "two slots share a fact label"),
        told(u.filter("coalesce(fact_label, '') = ''"), 3, "the fact label is blank"),
        told(u.filter("coalesce(command_id, '') = ''"), 4, "no command id"),
        told(u.filter("coalesce(replay_id, '') = ''"), 5, "no replay id"),
        told(u.filter("status IS NULL OR status NOT IN ('ok', 'completed_with_errors')"), 6, "the analysis has no usable status"),
        told(s.filter(F.col("symbol") != digest), 7, "the id isn't that of its key"),
        told(s.filter("placeholder").join(l, ["unit", "symbol"], "left_semi"), 8, "a placeholder has a place"),
        told(l.filter(bad_path("path")), 9, "a location's path isn't canonical"),
        told(lacks(e, "source").unionByName(lacks(e, "target").select(e.columns)), 10, "an end of a relation is unknown"),
        told(e.filter(bad_path("path")), 11, "an evidence path isn't canonical"),
        told(i.filter("coalesce(path_key, '') = ''"), 12, "an input has no path"),
        told(i.groupBy("unit", "path_key").count().filter("count > 1"), 13, "an input is given twice"),
        told(i.filter(F.col("repo_path").isNotNull() & ~is_repo_path(F.col("repo_path"))), 14, "an input's path isn't canonical"),
        told(lacks(l, "symbol"), 15, "a place is of an unknown symbol"),
        told(l.filter("b_off < 0 OR e_off < b_off"), 16, "a place ends before it begins"),
    ]
    if "unresolved" in batch:
        rules.append(told(lacks(batch["unresolved"], "symbol"), 17, "an unresolved site is in an unknown symbol"))
    if "include" in batch:
        rules.append(told(batch["include"].filter(bad_path("target")), 18, "an include's target isn't canonical"))
        rules.append(told(batch["include"].groupBy("unit", "id").count().filter("count > 1"), 19, "an include is given twice"))
    if retire is not None:
        rules.append(told(u.join(retire.select("unit"), "unit", "left_semi"), 20, "the slot is installed and retired at once"))
    if live is not None:
        gone = u.select("unit") if retire is None else u.select("unit").unionByName(retire.select("unit"))
        rules.append(told(u.join(live.join(gone, "unit", "left_anti").select("fact_label"), "fact_label", "left_semi"), 21, "another slot owns the fact label"))
    if "fields" in s.columns:  # the key's parts (identity.serialize), where a contribution tells them
        rows = s.filter("fields IS NOT NULL")
        rows = rows.select("unit", "key", identity.problem(F.col("fields")).alias("why"), identity.serialize(F.col("fields")).alias("text"))
        rules.append(rows.filter("why IS NOT NULL").select("unit", F.lit(22).alias("rule"), F.col("why").alias("reason")))
        rules.append(told(rows.filter("why IS NULL AND NOT text <=> key"), 23, "the key isn't that of its parts"))
    every = reduce(DataFrame.unionByName, rules)
    return every.groupBy("unit").agg(F.min(F.struct("rule", "reason")).alias("r")).select("unit", "r.rule", "r.reason")


def bucket_of(unit: str = "unit"):
    return F.pmod(F.xxhash64(unit), F.lit(BUCKETS)).cast("int")


def replaced(old: DataFrame, new: DataFrame, leaving: DataFrame) -> DataFrame:
    """A table's next rows. leaving: a column unit."""
    return facts.merge(facts.without(old, leaving), new.select(old.columns))


def publish(spark: SparkSession, root: str, batch: dict[str, DataFrame], retire: DataFrame | None = None, workspace: str | None = None, profile: str = "default", uht: bool = False) -> tuple[int, DataFrame]:
    """The current generation afterwards, and the problems: if there are any, nothing is published and a failure is logged."""
    retire = spark.createDataFrame([], "unit string") if retire is None else retire
    n = current(spark, root)
    old = snapshot(spark, root, n)
    found = problems(batch, old["unit"].select("unit", "fact_label"), retire)
    installed, gone = batch["unit"].count(), retire.count()

    def note(generation: int, state: str, message: str = "") -> None:
        row = spark.range(1).select(
            F.lit(generation).cast("long").alias("generation"), F.lit(state).alias("state"), F.lit(installed).cast("long").alias("installed"), F.lit(gone).cast("long").alias("retired"),
            F.lit(message).alias("message"), F.current_timestamp().alias("at"),
        )
        row.write.mode("append").parquet(f"{root}/log")

    first = found.orderBy("rule", "unit").limit(1).collect()
    if first:
        note(n + 1, "failed", f"{first[0].unit}: {first[0].reason}")
        return n, found
    if not installed and not gone:
        return n, found
    if not n and profile not in profiles(spark, root):
        spark.createDataFrame([(MAGIC, VERSION, workspace, profile, uht)], META).write.mode("append").parquet(f"{root}/meta")
    note(n + 1, "in_progress")
    leaving = batch["unit"].select("unit").unionByName(retire.select("unit")).distinct()
    touched = [r.b for r in leaving.select(bucket_of().alias("b")).distinct().collect()]  # BUCKETS at most
    kept = [r for r in _folders(spark, root, n) if r.bucket not in touched] if n else []
    listed = [(n + 1, r.table, r.bucket, r.folder) for r in kept]
    for t in TABLES:
        new = batch.get(t, spark.createDataFrame([], TABLES[t]))
        rows = replaced(old[t].filter(bucket_of().isin(touched)), new, leaving).withColumn("bucket", bucket_of())
        folder = f"{root}/tables/{t}/gen={n + 1}-{uuid.uuid4().hex}"
        # a bucket is a task's, so that folders have few files
        rows.repartition(min(BUCKETS, max(1, len(touched))), "bucket").write.partitionBy("bucket").parquet(folder)
        listed += [(n + 1, t, r.b, f"{folder}/bucket={r.b}") for r in _written(spark, folder, TABLES[t]).collect()]
    spark.createDataFrame(listed, FOLDERS).write.mode("append").parquet(f"{root}/folders")
    note(n + 1, "succeeded")
    return n + 1, found


def _written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The buckets of a folder that were written."""
    try:
        return spark.read.schema(f"{schema}, bucket int").parquet(folder).select(F.col("bucket").alias("b")).distinct()
    except AnalysisException:  # no rows, no files
        return spark.createDataFrame([], "b int")
