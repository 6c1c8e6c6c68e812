"""Attempts by layer, outcomes of publications, fingerprints of contributions, sets that should agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import status
from factloom.operators.facts import put


def layer_attempts(attempts: DataFrame) -> DataFrame:
    """(layer, last_attempt, last_state, last_success): each layer's last attempt and its last that succeeded."""
    last = F.max(F.struct("attempt", "state"))
    return attempts.groupBy("layer").agg(last.alias("x"), F.max(F.when(F.col("state") == "succeeded", F.col("attempt"))).alias("last_success")).select("layer", F.col("x.attempt").alias("last_attempt"), F.col("x.state").alias("last_state"), "last_success")


def profile_status(attempts: DataFrame) -> DataFrame:
    """(profile, total, succeeded, failed, availability, failed_slots) of attempts (profile, slot, attempt, state).

    A slot is committed if it ever succeeded, and failed if its last attempt did; failed ones are counted apart.
    """
    each = attempts.groupBy("profile", "slot").agg(F.max(F.struct("attempt", "state")).alias("x"), F.max((F.col("state") == "succeeded").cast("int")).alias("c"))
    bad = F.col("x.state") != "succeeded"
    rows = each.filter(bad | (F.col("c") == 1)).groupBy("profile").agg(
        F.count("*").alias("total"), F.sum((~bad & (F.col("c") == 1)).cast("long")).alias("succeeded"), F.sum(bad.cast("long")).alias("failed"), F.array_sort(F.collect_list(F.when(bad, F.col("slot")))).alias("slots")
    )
    return status.availability(rows.withColumn("failed_slots", F.array_join("slots", ",")).drop("slots"))


def stale_facts(facts: DataFrame, stale: DataFrame, by: str, ident: str = "symbol") -> DataFrame:
    """(by, stale_ids): of returned facts (by, ident, unit), the ids that a stale unit owns, in order."""
    own = facts.join(stale.select("unit").distinct(), "unit", "left_semi").select(by, ident).distinct()
    return own.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(ident)), ",").alias("stale_ids"))


def publishable(units: DataFrame, policy: str) -> DataFrame:
    """(unit, reason): rejected units are never published, provisional ones only without accepted_only. A null reason is a yes."""
    strict = F.lit(policy == "accepted_only")
    reason = F.when(F.col("status") == "rejected", "the analysis was rejected").when(strict & (F.col("status") != "ok"), "the analysis has errors").when(strict & ~F.col("context_complete"), "parts of the compile context are missing")
    return units.select("unit", reason.alias("reason"))


def outcome(**tables: DataFrame) -> DataFrame:
    """(unit, and a count for each table): what a publication of each unit holds."""
    rows = None
    for name, df in tables.items():
        n = df.groupBy("unit").agg(F.count("*").alias(name))
        rows = n if rows is None else rows.join(n, "unit", "full")
    return rows.select("unit", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in tables))


def declaration_api(locations: DataFrame) -> DataFrame:
    """(unit, declaration_api): SHA-256 over a unit's symbols in order of their ids, each with its distinct role@path in order."""
    one = locations.groupBy("unit", "symbol").agg(F.array_sort(F.collect_set(F.concat("role", F.lit("@"), "path"))).alias("d"), F.max((F.col("role") != "implicit_declaration").cast("int")).alias("real"))
    presence = F.when(F.col("real") == 1, "indexed").otherwise("implicit_hidden")
    own = F.concat(put(F.col("symbol"), presence), F.array_join(F.transform("d", lambda x: put(x)), ""))
    ordered = one.select("unit", F.struct("symbol", own.alias("row")).alias("s")).groupBy("unit").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return ordered.select("unit", F.sha2(F.array_join(F.transform("s", lambda x: x["row"]), ""), 256).alias("declaration_api"))


def compile_action(units: DataFrame, fields: list[Column]) -> DataFrame:
    """(unit, compile_action): SHA-256 over what a unit was built with; an absent field is an empty one."""
    return units.select("unit", F.sha2(put(*(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256).alias("compile_action"))


def context_identity(arguments: Column) -> Column:
    """ctx: and the SHA-256 of the arguments, each with its length before it."""
    return F.concat(F.lit("ctx:"), F.sha2(F.array_join(F.transform(arguments, lambda a: put(a)), ""), 256))


def set_differences(declared: DataFrame, observed: DataFrame, by: str, member: str) -> DataFrame:
    """(by, member, side): what one side has and the other hasn't."""
    a, b = declared.select(by, member).distinct(), observed.select(by, member).distinct()
    return a.join(b, [by, member], "left_anti").withColumn("side", F.lit("not_included")).unionByName(b.join(a, [by, member], "left_anti").withColumn("side", F.lit("undeclared")))


def same_sets(a: DataFrame, b: DataFrame, by: str, member: str) -> DataFrame:
    """(by, same): whether both sides have the same members; a side without any has the empty set. Sums stand in for sets, no group is gathered."""
    side = lambda df, n: df.select(by, member).distinct().select(by, member, F.lit(n).alias("n"))
    both = side(a, 1).unionByName(side(b, 2)).groupBy(by, member).agg(F.sum("n").alias("n"))
    return both.groupBy(by).agg((F.min("n") == 3).alias("same"))


def iso8601(ts: Column) -> Column:
    """UTC seconds with a Z."""
    return F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def looks_absolute(path: Column) -> Column:
    return path.rlike(r"^[/\\]|^[A-Za-z]:")


def path_key(path: Column) -> Column:
    """What spellings of a path have in common: forward slashes, one at a time, without '.' parts, lower-cased A-Z."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    rooted = F.when(path.rlike(r"^[/\\]"), F.lit("/")).otherwise(F.lit(""))
    return F.translate(F.concat(rooted, F.array_join(parts, "/")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
