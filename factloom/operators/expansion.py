"""Response files in command lines, expanded in place, however they are nested.

References are followed level by level with equi-joins; every row knows its place (the path of positions from the
command line down, which orders rows depth first) and the files that it stands in, so a file that would include itself
is refused. Budgets hold in depth-first order: running sums over a command's rows say where the first one is passed, and
whatever comes first in that order is the command's error. A reference is only followed while the rows known to come
before it are within the budget of work, so a command never grows much beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.facts import put
from factloom.operators.history import looks_absolute
from factloom.sources.shared import stash


@dataclass(frozen=True)
class Limits:
    """depth: of nesting, a reference in the command line is 1. work: references and tokens looked at."""

    depth: int = 8
    file_bytes: int = 8 << 20
    total_bytes: int = 64 << 20
    tokens: int = 1 << 20
    work: int = 4 << 20


def normal(path: Column) -> Column:
    """A path with forward slashes, without '.' parts and with '..' parts taken back."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.element_at(s, -1) != ".."), F.slice(s, 1, F.size(s) - 1)).otherwise(F.concat(s, F.array(p))))
    return F.concat(F.when(path.rlike(r"^[/\\]"), F.lit("/")).otherwise(""), F.array_join(kept, "/"))


def is_reference(token: Column) -> Column:
    return token.startswith("@")


def events(commands: DataFrame, files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """A row for each token and reference of each command: id, place, depth, token, path (of the file referred to), within, problem.

    commands: id, directory, args (the compiler first); files: path, n_bytes, problem (why it can't be read as tokens,
    or null), tokens. problem of a row is what is wrong with it whatever came before.
    """
    files = stash(files.select("path", "n_bytes", F.col("problem").alias("unreadable"), F.when(F.col("problem").isNull(), F.coalesce("tokens", F.array())).alias("tokens")), "files")
    sizes = files.select("path", "n_bytes", "unreadable", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("holds"))
    nothing = F.array().cast("array<string>")
    level = commands.select("id", "directory", F.posexplode("args").alias("i", "token")).select(
        "id", "directory", F.array("i").alias("place"), F.when(is_reference(F.col("token")) & (F.col("i") > 0), 1).otherwise(0).alias("depth"), "token", nothing.alias("within"), F.lit(0).alias("looked")
    )
    done = None
    for _ in range(limits.depth + 1):
        refers = F.col("depth") > 0
        name = F.substring("token", 2, 2**31 - 1)
        path = F.when(refers, normal(F.when(looks_absolute(name), name).otherwise(F.concat_ws("/", "directory", name))))
        found = level.withColumn("path", path).join(sizes, "path", "left")
        problem = (
            F.when(~refers, None).when(F.col("depth") > limits.depth, "too_deep").when(F.array_contains("within", F.col("path")), "cycle").when(F.col("n_bytes").isNull(), "missing")
            .when(F.col("n_bytes") > limits.file_bytes, "file_too_large").otherwise(F.col("unreadable"))
        )
        # a reference's look at itself comes on top of the look at its token
        cost = F.col("looked") + F.when(refers & (F.col("depth") <= limits.depth), 1).otherwise(0)
        new = found.select("id", "directory", "place", "depth", "token", "path", "within", "n_bytes", problem.alias("problem"), cost.alias("cost"), F.when(refers & problem.isNull(), F.col("holds")).otherwise(0).alias("holds"))
        known = new if done is None else done.withColumn("holds", F.lit(0).cast("long")).unionByName(new)
        before = W.partitionBy("id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
        sums = known.withColumn("spent", F.coalesce(F.sum("cost").over(before), F.lit(0))).withColumn("due", F.coalesce(F.sum(F.col("cost") + F.col("holds")).over(before), F.lit(0)))
        # what comes after the budget was passed is never looked at
        kept = sums.filter(F.col("spent") <= limits.work).withColumn("open", (F.col("holds") > 0) & (F.col("due") <= limits.work))
        done = stash(kept.drop("spent", "due").withColumn("holds", F.lit(0).cast("long")), "events")
        more = done.filter("open").select("id", "directory", "place", "depth", "path", F.array_append("within", F.col("path")).alias("inside")).join(files.select("path", "tokens"), "path")
        level = more.select("id", "directory", "place", "depth", "inside", F.posexplode("tokens").alias("k", "token")).select(
            "id", "directory", F.array_append("place", F.col("k")).alias("place"), F.when(is_reference(F.col("token")), F.col("depth") + 1).otherwise(0).alias("depth"), "token", F.col("inside").alias("within"), F.lit(1).alias("looked")
        )
        done = done.drop("open")
        if more.isEmpty():
            break
    return done.drop("holds", "directory")


def expanded(rows: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(results, tokens) from events.

    results: id, error (the first, or null), at (the token it is at), n_tokens, n_files, n_bytes (of the files read, each
    once). tokens, of commands without an error: id, place, token, path (null: from the command line), n (from 1).
    """
    order = W.partitionBy("id").orderBy("place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    plain, reads = F.col("depth") == 0, (F.col("depth") > 0) & F.col("n_bytes").isNotNull()
    first = F.row_number().over(W.partitionBy("id", "path", (F.col("problem").isNull() & reads).alias("r")).orderBy("place")) == 1
    rows = rows.withColumn("reads", reads & F.col("problem").isNull() & first)
    spent = F.coalesce(F.sum("cost").over(before), F.lit(0))
    made = F.coalesce(F.sum(plain.cast("int")).over(before), F.lit(0))
    read = F.coalesce(F.sum(F.when(F.col("reads"), F.col("n_bytes"))).over(before), F.lit(0))
    rows = rows.withColumn("spent", spent).withColumn("made", made).withColumn("read", read)
    too_much = F.col("spent") + F.col("cost") > limits.work
    in_time = F.when((F.col("problem") == "too_deep") & ~too_much, "too_deep").when(too_much, F.when((F.col("problem") == "too_deep") & (F.col("spent") + F.col("cost") <= limits.work), "too_deep").otherwise("too_much_work"))
    late = F.when(F.col("problem").isin("cycle", "missing", "file_too_large"), F.col("problem"))
    total = F.when(F.col("reads") & (F.col("read") + F.col("n_bytes") > limits.total_bytes), "total_too_large")
    unread = F.when(F.col("problem").isNotNull() & ~F.col("problem").isin("cycle", "missing", "file_too_large", "too_deep"), F.when(F.col("read") + F.col("n_bytes") > limits.total_bytes, "total_too_large").otherwise(F.col("problem")))
    full = F.when(plain & (F.col("made") >= limits.tokens), "too_many_tokens")
    rows = rows.withColumn("error", F.coalesce(in_time, late, total, unread, full))
    least = F.min(F.when(F.col("error").isNotNull(), F.struct("place", "error", "token")))
    results = rows.groupBy("id").agg(least.alias("e"), F.sum(plain.cast("long")).alias("n"), F.sum(F.col("reads").cast("long")).alias("f"), F.coalesce(F.sum(F.when(F.col("reads"), F.col("n_bytes"))), F.lit(0)).alias("b"))
    good = F.col("e").isNull()
    results = stash(
        results.select("id", F.col("e.error").alias("error"), F.col("e.token").alias("at"), F.when(good, F.col("n")).alias("n_tokens"), F.when(good, F.col("f")).alias("n_files"), F.when(good, F.col("b")).alias("n_bytes")), "expanded"
    )
    tokens = rows.filter(plain).join(results.filter("error IS NULL").select("id"), "id", "left_semi")
    return results, tokens.select("id", "place", "token", F.get("within", F.size("within") - 1).alias("path"), (F.col("made") + 1).alias("n"))


def replay_ids(tokens: DataFrame) -> DataFrame:
    """(id, replay): a digest of each command's tokens with where they come from. A command has at most Limits.tokens of them."""
    row = put(F.col("place")[0], F.col("path"), F.element_at("place", -1), F.col("token"))
    return tokens.groupBy("id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("row")))), lambda x: x["row"]), ""), 256).alias("replay"))
