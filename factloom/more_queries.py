"""Registered queries over scopes, includes, unresolved sites, attempts and outcomes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import fileapi, history, projection, status
from factloom.queries import query
from factloom.sources import lens
from factloom.sources.lens import SQL_ATTEMPTS, SQL_INCLUDES, SQL_INPUTS, SQL_LOC, SQL_SCOPES, SQL_SITES, table
from factloom.sources.shared import stash


class Scoped:
    """Located and unlocated symbols with their scopes, and what may be shown of them."""

    def __init__(self, spark, sf_dir: str) -> None:
        self.loc = lens.locations(spark, sf_dir)
        self.ext = lens.externals(spark, sf_dir)
        self.withheld = lens.withheld(self.loc)
        self.public: DataFrame = stash(projection.public(self.loc, self.withheld, lens.scopes(self.loc, self.ext)), "public")


@query(f"WITH RECURSIVE {SQL_SCOPES} SELECT symbol, presence FROM public_all")
def public_symbols(spark, sf_dir):
    """With placeholders, and without symbols that are internal to a withheld file or local to a hidden symbol."""
    return Scoped(spark, sf_dir).public


@query(
    f"""WITH RECURSIVE {SQL_SCOPES}, {SQL_SITES} SELECT source, target, count(*) AS n_sites, count(*) FILTER (path IS NULL) AS n_built_in, count(DISTINCT unit) AS n_units FROM xcalls
WHERE source IN (SELECT symbol FROM public_all) AND target IN (SELECT symbol FROM public_all) AND (path IS NULL OR path NOT IN (SELECT path FROM withheld)) GROUP BY source, target"""
)
def placeholder_calls(spark, sf_dir):
    s = Scoped(spark, sf_dir)
    seen = projection.public_evidence(lens.external_calls(spark, sf_dir, s.loc, s.ext), s.public, s.withheld)
    return seen.groupBy("source", "target").agg(F.count("*").alias("n_sites"), F.sum(F.col("path").isNull().cast("long")).alias("n_built_in"), F.count_distinct("unit").alias("n_units"))


@query(
    f"""WITH RECURSIVE {SQL_SCOPES}, {SQL_SITES} SELECT symbol, expression, reason, count(*) AS n_sites, min(b_off) AS first_off FROM unresolved
WHERE symbol IN (SELECT symbol FROM public_all) AND (path IS NULL OR path NOT IN (SELECT path FROM withheld)) GROUP BY ALL"""
)
def unresolved_sites(spark, sf_dir):
    s = Scoped(spark, sf_dir)
    own = projection.visible(lens.unresolved(spark, sf_dir, s.loc), s.withheld).join(s.public.select("symbol"), "symbol", "left_semi")
    return own.groupBy("symbol", "expression", "reason").agg(F.count("*").alias("n_sites"), F.min("b_off").alias("first_off"))


@query(
    f"""WITH {SQL_LOC}, c AS (SELECT a.symbol, a.path, b.name AS captured, CASE WHEN a.part % 2 = 0 THEN 'copy' ELSE 'reference' END AS kind FROM loc a JOIN loc b ON b.part = a.part - 1 WHERE a.part % 7 = 2 AND a.role <> 'implicit_declaration')
SELECT symbol, captured, kind, count(*) AS n FROM c WHERE path NOT IN (SELECT path FROM withheld) GROUP BY ALL"""
)
def captures(spark, sf_dir):
    """What local callables capture of the symbol around them, in visible files."""
    loc = lens.locations(spark, sf_dir)
    outer = loc.select((F.col("part") + 1).alias("part"), F.col("name").alias("captured"))
    rows = loc.filter("part % 7 = 2 AND role <> 'implicit_declaration'").join(outer, "part").select("symbol", "path", "captured", F.when(F.col("part") % 2 == 0, "copy").otherwise("reference").alias("kind"))
    return projection.visible(rows, lens.withheld(loc)).groupBy("symbol", "captured", "kind").agg(F.count("*").alias("n"))


_SEEN = "seen AS (SELECT * FROM includes WHERE path NOT IN (SELECT path FROM withheld) AND (target IS NULL OR target NOT IN (SELECT path FROM withheld)))"


@query(
    f"""WITH {SQL_LOC}, {SQL_INCLUDES}, {_SEEN}, m AS (SELECT path, b_off, operand, activity, resolution, target, count(DISTINCT unit) AS units, min(id) AS id FROM seen GROUP BY ALL),
b AS (SELECT id, branch, (CASE WHEN branch > 0 THEN 'else ' ELSE '' END) || max(CASE WHEN term < 0 THEN 'if ' || o_orderpriority || '/-1' END) || coalesce(string_agg(CASE WHEN term >= 0 THEN ' after elif ' || o_orderpriority || '/' || term END, '' ORDER BY term), '') AS text FROM terms GROUP BY id, branch),
p AS (SELECT id, string_agg(text, '; ' ORDER BY branch) AS conditions FROM b GROUP BY id)
SELECT path, b_off, operand, activity, resolution, target, units, coalesce(conditions, '') AS conditions FROM m LEFT JOIN p ON m.id = p.id"""
)
def file_includes(spark, sf_dir):
    """Includes of every visible file, merged over units, with the condition path of the first observation."""
    loc = lens.locations(spark, sf_dir)
    rows = fileapi.includes_of(lens.includes(spark, sf_dir, loc), lens.include_terms(spark, sf_dir), lens.withheld(loc))
    said = lambda t: F.concat_ws(" ", t["kind"], t["expression"])
    before = lambda b: F.array_join(F.transform(b["preceding"], lambda t: F.concat(F.lit(" after "), said(t))), "")
    text = F.transform("conditions", lambda b: F.concat(F.when(b["is_else"], "else ").otherwise(""), said(b["own"]), before(b)))
    return rows.select("path", "b_off", "operand", "activity", "resolution", "target", "units", F.coalesce(F.array_join(text, "; "), F.lit("")).alias("conditions"))


@query(f"WITH {SQL_LOC}, o AS (SELECT DISTINCT symbol, unnest([0, 1]) AS ordinal, unnest([split_part(qualified, '::', 1), split_part(qualified, '::', 2)]) AS owner FROM loc) SELECT symbol, string_agg(owner, '::' ORDER BY ordinal) AS owners FROM o GROUP BY symbol")
def symbol_owners(spark, sf_dir):
    """Owner rows joined with their symbols and put in order."""
    s = lens.symbols(lens.locations(spark, sf_dir))
    rows = s.select("symbol", F.posexplode(F.slice(F.split("qualified", "::"), 1, 2)).alias("ordinal", "owner"))
    return s.select("symbol").join(rows, "symbol").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ordinal", "owner"))).alias("o")).select("symbol", F.array_join(F.transform("o", lambda x: x["owner"]), "::").alias("owners"))


@query(
    f"""WITH {SQL_INPUTS}, r AS (SELECT unit, CASE WHEN path_key LIKE '%5.cpp' THEN 'generated' WHEN path_key LIKE '%30.cpp' THEN 'header' ELSE role END AS role FROM inputs) SELECT unit, role, count(*) AS n FROM r GROUP BY ALL"""
)
def role_overrides(spark, sf_dir):
    """Inputs by role, where a small table of endings overrides it."""
    told = spark.createDataFrame([("5.cpp", "generated"), ("30.cpp", "header")], "ending string, told string")
    i = lens.inputs(spark, sf_dir)
    rows = i.join(F.broadcast(told), F.col("path_key").endswith(F.col("ending")), "left")
    return rows.groupBy("unit", F.coalesce("told", "role").alias("role")).agg(F.count("*").alias("n"))


_LAYERED = f"{SQL_ATTEMPTS}, a AS (SELECT *, ['structure', 'semantic', 'uht', 'retrieval', 'deep', 'context'][slot % 6 + 1] AS layer, 'p' || CAST(slot % 5 AS VARCHAR) AS profile FROM attempts)"


def _layered(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, ("structure", "semantic", "uht", "retrieval", "deep", "context")))
    return lens.attempts(spark, sf_dir).withColumn("layer", F.element_at(names, (F.col("slot") % 6 + 1).cast("int"))).withColumn("profile", F.concat(F.lit("p"), (F.col("slot") % 5).cast("string")))


@query(f"WITH {_LAYERED} SELECT layer, max(attempt) AS last_attempt, arg_max(state, attempt) AS last_state, max(attempt) FILTER (state = 'succeeded') AS last_success FROM a GROUP BY layer")
def layer_attempts(spark, sf_dir):
    return history.layer_attempts(_layered(spark, sf_dir))


@query(
    f"""WITH {_LAYERED}, s AS (SELECT profile, slot, arg_max(state, attempt) <> 'succeeded' AS bad, bool_or(state = 'succeeded') AS c FROM a GROUP BY profile, slot),
n AS (SELECT profile, count(*) AS total, count(*) FILTER (c AND NOT bad) AS succeeded, count(*) FILTER (bad) AS failed, coalesce(string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) FILTER (bad), '') AS failed_slots FROM s WHERE c OR bad GROUP BY profile)
SELECT *, CASE WHEN succeeded = 0 AND failed = 0 THEN 'missing' WHEN succeeded = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'ready' END AS availability FROM n"""
)
def profile_status(spark, sf_dir):
    return history.profile_status(_layered(spark, sf_dir))


@query(
    f"""WITH {_LAYERED}, n AS (SELECT layer, count(*) FILTER (state = 'failed') > 0 AS f, count(*) FILTER (state = 'succeeded') > 0 AS s, max(attempt) % 2 = 0 AS fresh FROM a GROUP BY layer),
l AS (SELECT layer, CASE WHEN NOT s AND NOT f THEN 'missing' WHEN NOT s THEN 'failed' WHEN f THEN 'partial' ELSE 'ready' END AS availability, CASE WHEN fresh THEN 'fresh' ELSE 'stale' END AS freshness FROM n WHERE layer <> 'uht'),
u AS (SELECT layer, CASE WHEN availability IN ('failed', 'missing') THEN availability WHEN freshness <> 'fresh' THEN 'stale' WHEN availability = 'partial' THEN 'partial' ELSE 'ready' END AS status FROM l)
SELECT CASE WHEN count(*) = 0 THEN 'missing' WHEN max(CASE WHEN layer = 'structure' AND status IN ('missing', 'failed') THEN status END) IS NOT NULL THEN max(CASE WHEN layer = 'structure' AND status IN ('missing', 'failed') THEN status END)
  WHEN bool_or(status = 'stale') THEN 'stale' WHEN bool_or(status <> 'ready') THEN 'partial' ELSE 'ready' END AS status FROM u"""
)
def overall_status(spark, sf_dir):
    n = _layered(spark, sf_dir).groupBy("layer").agg(F.max((F.col("state") == "failed").cast("int")).alias("failed"), F.max((F.col("state") == "succeeded").cast("int")).alias("succeeded"), F.max("attempt").alias("last"))
    layers = status.availability(n).select("layer", (F.col("layer") != "uht").alias("applicable"), "availability", F.when(F.col("last") % 2 == 0, "fresh").otherwise("stale").alias("freshness"))
    return status.overall(layers)


@query(
    f"""WITH {SQL_LOC}, {SQL_INPUTS}, stale AS (SELECT DISTINCT 'u' || substr(unit, 2) AS unit FROM inputs WHERE second IS DISTINCT FROM recorded AND CAST(substr(unit, 2) AS INTEGER) % 3 = 0)
SELECT path, string_agg(symbol, ',' ORDER BY symbol) AS stale_ids FROM (SELECT DISTINCT path, symbol FROM loc WHERE unit IN (SELECT unit FROM stale)) GROUP BY path"""
)
def stale_fact_ids(spark, sf_dir):
    """The symbols of each file that a stale unit owns."""
    i = lens.inputs(spark, sf_dir)
    gone = i.filter(~F.col("second").eqNullSafe(F.col("recorded")) & (F.substring("unit", 2, 9).cast("int") % 3 == 0))
    return history.stale_facts(lens.locations(spark, sf_dir), gone.select(F.concat(F.lit("u"), F.substring("unit", 2, 9)).alias("unit")), "path")


@query(
    f"""WITH RECURSIVE {SQL_SCOPES}, {SQL_SITES}, {SQL_INCLUDES}, n AS (SELECT unit, 1 AS l, 0 AS e, 0 AS u, 0 AS i FROM loc UNION ALL SELECT unit, 0, 1, 0, 0 FROM xcalls UNION ALL SELECT unit, 0, 0, 1, 0 FROM unresolved UNION ALL SELECT unit, 0, 0, 0, 1 FROM includes)
SELECT unit, CAST(sum(l) AS BIGINT) AS locations, CAST(sum(e) AS BIGINT) AS evidence, CAST(sum(u) AS BIGINT) AS unresolved, CAST(sum(i) AS BIGINT) AS includes FROM n GROUP BY unit"""
)
def publish_outcome(spark, sf_dir):
    loc, ext = lens.locations(spark, sf_dir), lens.externals(spark, sf_dir)
    return history.outcome(locations=loc, evidence=lens.external_calls(spark, sf_dir, loc, ext), unresolved=lens.unresolved(spark, sf_dir, loc), includes=lens.includes(spark, sf_dir, loc))


@query(
    """WITH u AS (SELECT o_orderkey AS unit, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'completed_with_errors' ELSE 'rejected' END AS status, o_orderkey % 4 <> 0 AS context_complete FROM orders)
SELECT unit, CASE WHEN status = 'rejected' THEN 'the analysis was rejected' WHEN status <> 'ok' THEN 'the analysis has errors' WHEN NOT context_complete THEN 'parts of the compile context are missing' END AS reason FROM u"""
)
def publishable_units(spark, sf_dir):
    o = F.col("o_orderstatus")
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.when(o == "O", "ok").when(o == "F", "completed_with_errors").otherwise("rejected").alias("status"), (F.col("o_orderkey") % 4 != 0).alias("context_complete"))
    return history.publishable(units, "accepted_only")


_PUT = lambda v: f"strlen({v}) || ':' || {v} || ';'"


@query(
    f"""WITH {SQL_LOC}, s AS (SELECT unit, symbol, {_PUT('symbol')} || {_PUT("(CASE WHEN bool_or(role <> 'implicit_declaration') THEN 'indexed' ELSE 'implicit_hidden' END)")} || (SELECT string_agg({_PUT('d')}, '' ORDER BY d) FROM (SELECT DISTINCT unnest(list(role || '@' || path)) AS d)) AS row FROM loc GROUP BY unit, symbol)
SELECT unit, sha256(string_agg(row, '' ORDER BY symbol)) AS declaration_api FROM s GROUP BY unit"""
)
def fingerprint_declarations(spark, sf_dir):
    return history.declaration_api(lens.locations(spark, sf_dir))


@query(f"WITH f AS (SELECT o_orderkey AS unit, o_orderpriority AS a, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, '') AS b FROM orders) SELECT unit, sha256({_PUT('a')} || {_PUT('b')}) AS compile_action FROM f")
def fingerprint_actions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "unit")
    return history.compile_action(o, [F.col("o_orderpriority"), F.when(F.col("unit") % 3 > 0, F.col("o_orderstatus"))])


@query(
    f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, 'ctx:' || sha256(array_to_string(list_transform(w, lambda x: {_PUT('x')}), '')) AS context_id FROM d"""
)
def context_ids(spark, sf_dir):
    """Every document's words as the arguments of a compile context."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n\t\r]+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", history.context_identity(words).alias("context_id"))


_MEMBERS = "declared AS (SELECT DISTINCT l_orderkey AS unit, l_partkey AS member FROM lineitem WHERE l_returnflag <> 'R'), observed AS (SELECT DISTINCT l_orderkey AS unit, l_partkey AS member FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag = 'N')"


def _members(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("member"), "l_returnflag", "l_linestatus")
    return rows.filter("l_returnflag <> 'R'"), rows.filter("l_linestatus = 'F' OR l_returnflag = 'N'")


@query(f"WITH {_MEMBERS} SELECT unit, member, 'not_included' AS side FROM (SELECT * FROM declared EXCEPT SELECT * FROM observed) UNION ALL SELECT unit, member, 'undeclared' FROM (SELECT * FROM observed EXCEPT SELECT * FROM declared)")
def unity_differences(spark, sf_dir):
    return history.set_differences(*_members(spark, sf_dir), "unit", "member")


@query(f"WITH {_MEMBERS}, d AS (SELECT unit FROM (SELECT * FROM declared EXCEPT SELECT * FROM observed) UNION SELECT unit FROM (SELECT * FROM observed EXCEPT SELECT * FROM declared)), u AS (SELECT unit FROM declared UNION SELECT unit FROM observed) SELECT unit, unit NOT IN (SELECT unit FROM d) AS same FROM u")
def source_sets(spark, sf_dir):
    return history.same_sets(*_members(spark, sf_dir), "unit", "member")


@query("SELECT DISTINCT l_suppkey AS command FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def missing_commands(spark, sf_dir):
    """What is asked for and isn't there."""
    found = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("command"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("command")).distinct().join(found, "command", "left_anti")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", history.iso8601(F.col("ts")).alias("at"))


@query(
    """WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '/', chr(92)) WHEN 1 THEN '/' || url ELSE url || '/./X' END AS path FROM pages)
SELECT page_id, regexp_matches(path, '^[/\\\\]|^[A-Za-z]:') AS absolute, lower(CASE WHEN regexp_matches(path, '^[/\\\\]') THEN '/' ELSE '' END || array_to_string(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')), '/')) AS key FROM p"""
)
def path_keys(spark, sf_dir):
    n, url = F.col("page_id") % 3, F.col("url")
    path = F.when(n == 0, F.replace(url, F.lit("/"), F.lit("\\"))).when(n == 1, F.concat(F.lit("/"), url)).otherwise(F.concat(url, F.lit("/./X")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", history.looks_absolute(F.col("path")).alias("absolute"), history.path_key(F.col("path")).alias("key"))


@query(f"WITH {SQL_LOC} SELECT symbol, key, name, qualified, kind, signature FROM symbols WHERE symbol IN (SELECT symbol FROM loc WHERE part % 50 = 7)")
def symbol_lookup(spark, sf_dir):
    """Symbols by a list of stable ids."""
    loc = lens.locations(spark, sf_dir)
    return lens.symbols(loc).join(loc.filter("part % 50 = 7").select("symbol").distinct(), "symbol", "left_semi").select("symbol", "key", "name", "qualified", "kind", "signature")


@query(
    f"""WITH {SQL_LOC}, version AS (SELECT path, unit, sha256(path || '#' || unit) AS content, count(*) AS size FROM loc WHERE unit <> 'u3' GROUP BY path, unit)
SELECT l.symbol, l.role, l.path, l.b_off, l.e_off, l.unit, v.content, v.size FROM loc l LEFT JOIN version v ON l.path = v.path AND l.unit = v.unit"""
)
def symbol_places(spark, sf_dir):
    """Every place with the version of its file that its unit saw; a unit without versions keeps its places."""
    loc = lens.locations(spark, sf_dir)
    seen = loc.filter("unit <> 'u3'").groupBy("path", "unit").agg(F.count("*").alias("size"))
    version = seen.withColumn("content", F.sha2(F.concat("path", F.lit("#"), "unit").cast("binary"), 256))
    return loc.select("symbol", "role", "path", "b_off", "e_off", "unit").join(version, ["path", "unit"], "left").select("symbol", "role", "path", "b_off", "e_off", "unit", "content", "size")


@query(
    f"""WITH RECURSIVE {SQL_SCOPES}, {SQL_SITES}, e AS (SELECT source, target, path, b_off FROM xcalls WHERE source IN (SELECT symbol FROM public_all) AND target IN (SELECT symbol FROM public_all) AND (path IS NULL OR path NOT IN (SELECT path FROM withheld)))
SELECT target AS symbol, count(DISTINCT source) AS unique_callers, count(DISTINCT source || '|' || coalesce(path, '') || '|' || b_off) AS callsites FROM e GROUP BY target"""
)
def record_counts(spark, sf_dir):
    """Callers and call sites of every placeholder."""
    s = Scoped(spark, sf_dir)
    seen = projection.public_evidence(lens.external_calls(spark, sf_dir, s.loc, s.ext), s.public, s.withheld)
    by_caller = seen.select("source", "target", "path", "b_off").distinct().groupBy("target", "source").agg(F.count("*").alias("n"))
    return by_caller.groupBy(F.col("target").alias("symbol")).agg(F.count("*").alias("unique_callers"), F.sum("n").alias("callsites"))
