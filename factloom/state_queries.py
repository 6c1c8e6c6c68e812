"""Registered queries over kept inspections, content versions, spans and ordered includes, with their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import facts, inspection, versions
from factloom.queries import query
from factloom.functions import identity
from factloom.sources import lens, store
from factloom.sources.lens import CONTEXT_ROLES, SQL_INCLUDES, SQL_INPUTS, SQL_LOC, SQL_SCOPES, SQL_SITES, table
from factloom.sources.shared import stash

# --- inspections ---------------------------------------------------------------------------------------------------

_CTX = ", ".join(f"'{r}'" for r in CONTEXT_ROLES)


def _concluded(name: str, inputs: str) -> str:
    """<name>: states of the units of a relation with recorded, first and second."""
    return f"""{name}_kinds AS (SELECT *, CASE WHEN second IS NULL THEN 'deleted' WHEN second <> recorded THEN 'modified' WHEN first IS DISTINCT FROM second THEN 'changed_during_check' END AS kind FROM {inputs}),
{name}_lines AS (SELECT unit, kind || ' ' || path_key AS line, row_number() OVER (PARTITION BY unit ORDER BY path_key, kind) AS place FROM (SELECT DISTINCT unit, kind, path_key FROM {name}_kinds WHERE kind IS NOT NULL)),
{name}_reasons AS (SELECT unit, string_agg(line, chr(10) ORDER BY place) FILTER (place <= {inspection.REASONS}) || CASE WHEN count(*) > {inspection.REASONS} THEN chr(10) || 'and ' || (count(*) - {inspection.REASONS}) || ' more' ELSE '' END AS r FROM {name}_lines GROUP BY unit),
{name}_units AS (SELECT k.unit, count(kind) > 0 AS changed, coalesce(bool_or(kind IS NOT NULL AND role IN ({_CTX})), false) AS ctx, coalesce(bool_or(kind IS NOT NULL AND role = 'reflected_header'), false) AS refl, bool_or(verified) AS verified FROM {name}_kinds k LEFT JOIN currency c ON k.unit = c.unit GROUP BY k.unit),
{name} AS (SELECT u.unit, CASE WHEN changed THEN 'stale' WHEN NOT ctx AND verified THEN 'fresh' ELSE 'unknown' END AS semantic, CASE WHEN ctx THEN 'stale' WHEN verified THEN 'fresh' ELSE 'unknown' END AS compile_context, CASE WHEN refl THEN 'stale' ELSE 'unknown' END AS uht,
  coalesce(r, CASE WHEN NOT changed AND NOT (NOT ctx AND verified) THEN 'the build isn''t verified' END, '') AS reasons FROM {name}_units u LEFT JOIN {name}_reasons r ON u.unit = r.unit)"""


@query(f"WITH {SQL_INPUTS}, {_concluded('found', 'inputs')} SELECT * FROM found")
def freshness_states(spark, sf_dir):
    """What a complete inspection keeps of every unit."""
    i = lens.inputs(spark, sf_dir)
    return inspection.conclude(i, lens.currency(i), CONTEXT_ROLES, F.lit(None)).drop("checked_at")


@query(
    f"""WITH {SQL_INPUTS}, calm AS (SELECT unit, path_key, role, recorded, recorded AS first, recorded AS second FROM inputs), part AS (SELECT unit, path_key, role, recorded, first, first AS second FROM inputs WHERE CAST(substr(unit, 2) AS INTEGER) % 3 > 0),
{_concluded('old', 'calm')}, {_concluded('new', 'part')}, less AS (SELECT unit, replace(semantic, 'fresh', 'unknown') AS semantic, replace(compile_context, 'fresh', 'unknown') AS compile_context, replace(uht, 'fresh', 'unknown') AS uht,
  CASE WHEN reasons = '' THEN '' ELSE reasons || chr(10) END || 'the last inspection was incomplete: budget_exhausted' AS reasons FROM old)
SELECT * FROM new WHERE semantic = 'stale' UNION ALL SELECT * FROM less WHERE unit NOT IN (SELECT unit FROM new WHERE semantic = 'stale')"""
)
def freshness_downgrade(spark, sf_dir):
    """States that were kept of unchanged inputs, after an inspection that ran out of time with two thirds of the units seen once."""
    i = stash(lens.inputs(spark, sf_dir), "inputs")
    currency, none = stash(lens.currency(i), "currency"), F.lit(None)
    old = inspection.conclude(i.withColumn("first", F.col("recorded")).withColumn("second", F.col("recorded")), currency, CONTEXT_ROLES, none)
    part = i.filter(F.substring("unit", 2, 9).cast("int") % 3 > 0).withColumn("second", F.col("first"))
    return inspection.downgraded(old, "budget_exhausted", inspection.conclude(part, currency, CONTEXT_ROLES, none)).drop("checked_at")


# --- content versions and spans ------------------------------------------------------------------------------------

_VERSIONED = f"""WITH RECURSIVE {SQL_SCOPES}, {SQL_SITES},
rows AS (SELECT *, qualified || signature AS line FROM loc), lined AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows),
texts AS (SELECT path, g, string_agg(line, chr(10) ORDER BY part) || CASE WHEN g THEN chr(10) || '// generated' ELSE '' END AS text FROM rows, (SELECT unnest([true, false]) AS g) GROUP BY path, g),
contents AS (SELECT path, g, text, sha256(text) AS content FROM texts),
places AS (SELECT l.symbol, l.role, l.unit, l.path, c.content, c.text, CAST(start AS BIGINT) AS b_off, CAST(start + strlen(line) AS BIGINT) AS e_off FROM lined l JOIN contents c ON l.path = c.path AND c.g = (l.unit IN ('u3', 'u7'))),
evidence AS (SELECT x.source, x.target, x.unit, x.path, coalesce(c.content, sha256('built in')) AS content FROM xcalls x LEFT JOIN contents c ON x.path = c.path AND c.g = (x.unit IN ('u3', 'u7'))),
before AS (SELECT *, row_number() OVER (ORDER BY path NULLS FIRST, content) AS version FROM (SELECT DISTINCT path, content FROM places WHERE CAST(substr(unit, 2) AS INTEGER) % 2 = 0)),
fresh AS (SELECT path, content FROM places UNION SELECT path, content FROM evidence EXCEPT SELECT path, content FROM before),
versions AS (SELECT * FROM before UNION ALL SELECT *, (SELECT count(*) FROM before) + row_number() OVER (ORDER BY path NULLS FIRST, content) FROM fresh),
spans AS (SELECT symbol, role, unit, path, content, 1 + length(left(text, b_off)) - length(replace(left(text, b_off), chr(10), '')) AS begin_line, strlen(list_last(string_split(left(text, b_off), chr(10)))) + 1 AS begin_column,
  1 + length(left(text, e_off)) - length(replace(left(text, e_off), chr(10), '')) AS end_line, strlen(list_last(string_split(left(text, e_off), chr(10)))) + 1 AS end_column, CASE WHEN unit <> 'u5' THEN sha256(substr(text, b_off + 1, e_off - b_off)) END AS span_hash FROM places)"""


class Versioned:
    """Files made of their parts' lines, as two groups of units saw them; locations and calls with what they were seen in."""

    def __init__(self, spark, sf_dir: str) -> None:
        loc = lens.locations(spark, sf_dir).withColumn("line", F.concat("qualified", "signature"))
        own = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        lined = loc.withColumn("b_off", F.coalesce(F.sum(F.octet_length("line") + 1).over(own), F.lit(0)).cast("long"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n")
        texts = loc.groupBy("path").agg(joined.alias("text")).withColumn("g", F.explode(F.array(F.lit(True), F.lit(False))))
        text = F.concat("text", F.when(F.col("g"), F.lit("\n// generated")).otherwise(""))
        self.contents = stash(texts.select("path", "g", F.encode(text, "UTF-8").alias("bytes"), F.sha2(text, 256).alias("content")), "contents")
        seen = self.contents.select(F.col("path").alias("p"), "g", "content")
        late = F.col("unit").isin("u3", "u7")
        places = lined.join(seen, (F.col("path") == F.col("p")) & (F.col("g") == late))
        self.places = stash(places.select("symbol", "role", "unit", "path", "content", "b_off", (F.col("b_off") + F.octet_length("line")).alias("e_off")), "places")
        self.spark, self.sf_dir, self.loc, self.seen, self.late = spark, sf_dir, loc, seen, late

    def _within(self, calls):
        """calls (path, unit, ...) with the content that they were seen in."""
        return calls.join(self.seen, (F.col("path") == F.col("p")) & (F.col("g") == self.late), "left").withColumn("content", F.coalesce("content", F.sha2(F.lit("built in"), 256))).drop("p", "g")

    @property
    def evidence(self):
        calls = lens.external_calls(self.spark, self.sf_dir, self.loc, lens.externals(self.spark, self.sf_dir))
        return self._within(calls).select("source", "target", "unit", "path", "content")

    @cached_property
    def versions(self):
        """Only paths and units of calls are needed here, which are few."""
        number = lens.Numbers(self.loc)
        met = lens.external_lines(self.spark, self.sf_dir, number, lens.externals(self.spark, self.sf_dir)).select("p", "u").distinct()
        named = met.withColumnRenamed("p", "at").join(number.ids.join(number.parts.select("n", F.col("p").alias("at")).distinct(), "n").select("at", "path").distinct(), "at", "left")
        met = self._within(named.select("path", F.concat(F.lit("u"), F.col("u").cast("string")).alias("unit")))
        empty = self.spark.createDataFrame([], "version long, path string, content string")
        before = versions.find_or_insert(empty, self.places.filter(F.substring("unit", 2, 9).cast("int") % 2 == 0))
        return stash(versions.find_or_insert(stash(before, "versions"), self.places, met), "versions")


@query(
    f"{_VERSIONED}, n AS (SELECT path, content, count(*) AS n, 0 AS m FROM places GROUP BY ALL UNION ALL SELECT path, content, 0, count(*) FROM evidence GROUP BY ALL) "
    "SELECT version, v.path, v.content, CAST(sum(n) AS BIGINT) AS n_locations, CAST(sum(m) AS BIGINT) AS n_evidence FROM versions v JOIN n ON v.path IS NOT DISTINCT FROM n.path AND v.content = n.content GROUP BY ALL"
)
def content_versions(spark, sf_dir):
    """Every version with the locations and call sites that refer to it; versions that were there first keep their numbers."""
    v = Versioned(spark, sf_dir)
    refer = lambda rows, k: versions.with_version(rows, v.versions).groupBy("version").agg(F.count("*").alias(k))
    zero = F.lit(0).cast("long")
    told = v.versions.join(refer(v.places, "n"), "version", "left").join(refer(v.evidence, "m"), "version", "left")
    return told.select("version", "path", "content", F.coalesce("n", zero).alias("n_locations"), F.coalesce("m", zero).alias("n_evidence"))


def _spans(v: Versioned):
    """Places with spans; unit u5's bytes aren't known any more."""
    told = versions.with_spans(v.places, v.contents)
    return told.withColumn("span_hash", F.when(F.col("unit") != "u5", F.col("span_hash")))


_COLUMNS = "begin_line, begin_column, end_line, end_column"


@query(f"{_VERSIONED} SELECT symbol, role, unit, s.path, version, {_COLUMNS}, span_hash FROM spans s JOIN versions v ON s.path = v.path AND s.content = v.content")
def place_spans(spark, sf_dir):
    """Every location by version, lines, columns and the digest of its bytes."""
    v = Versioned(spark, sf_dir)
    return versions.with_version(_spans(v), v.versions).select("symbol", "role", "unit", "path", "version", *_COLUMNS.split(", "), "span_hash")


@query(f"{_VERSIONED}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, {_COLUMNS}, span_hash NULLS FIRST) AS rn FROM spans) SELECT symbol, path, {_COLUMNS}, span_hash FROM o WHERE rn = 1")
def first_places(spark, sf_dir):
    """The first place of every symbol by path, lines and columns."""
    return versions.first_places(_spans(Versioned(spark, sf_dir)))


# --- include edges -------------------------------------------------------------------------------------------------

_EDGES = f"""WITH {SQL_LOC}, {SQL_INCLUDES}, sites AS (SELECT *, row_number() OVER (ORDER BY path, b_off, operand) AS site FROM (SELECT DISTINCT path, b_off, operand FROM includes)),
edges AS (SELECT i.unit, i.id, s.site, s.path, s.b_off, s.operand, row_number() OVER (PARTITION BY i.unit ORDER BY i.id, s.site) - 1 AS ordinal FROM includes i JOIN sites s ON i.path = s.path AND i.b_off = s.b_off AND i.operand = s.operand)"""


def _edges(spark, sf_dir):
    """(edges, sites) of all includes."""
    rows = stash(lens.includes(spark, sf_dir, lens.locations(spark, sf_dir)), "includes")
    empty = spark.createDataFrame([], "site long, path string, b_off long, operand string")
    sites = stash(facts.upsert(empty, rows, ["path", "b_off", "operand"], "site"), "sites")
    return stash(versions.ordered_edges(rows.join(sites, ["path", "b_off", "operand"]).select("unit", "id", "site"), ("id", "site")), "edges"), sites


@query(f"{_EDGES} SELECT unit, ordinal, site, path, b_off, operand FROM edges")
def include_edges(spark, sf_dir):
    """Every include edge with its place in its unit and the site that it stands for."""
    edges, sites = _edges(spark, sf_dir)
    return edges.join(sites, "site").select("unit", "ordinal", "site", "path", "b_off", "operand")


@query(f"{_EDGES} SELECT unit, count(*) AS n_edges, sha256(string_agg(site || ':' || operand, ',' ORDER BY ordinal)) AS digest FROM edges GROUP BY unit")
def include_edge_lists(spark, sf_dir):
    """Each unit's include sites in order, as a digest of the array."""
    edges, sites = _edges(spark, sf_dir)
    lists = versions.edge_lists(edges, sites, fields=("operand",))
    told = F.array_join(F.transform("edges", lambda x: F.concat(x["site"].cast("string"), F.lit(":"), x["operand"])), ",")
    return lists.select("unit", F.size("edges").cast("long").alias("n_edges"), F.sha2(told, 256).alias("digest"))


# --- contributions that break rules --------------------------------------------------------------------------------

#: Fixed by this library: what each rule of a contribution says, in the order of store.problems.
REASONS = (
    "the slot is blank", "the slot is given twice", "two slots share a fact label", "the fact label is blank", "no command id", "no replay id", "the analysis has no usable status", "the id isn't that of its key",
    "a placeholder has a place", "a location's path isn't canonical", "an end of a relation is unknown", "an evidence path isn't canonical", "an input has no path", "an input is given twice", "an input's path isn't canonical",
    "a place is of an unknown symbol", "a place ends before it begins", "an unresolved site is in an unknown symbol", "an include's target isn't canonical", "an include is given twice", "the slot is installed and retired at once",
    "another slot owns the fact label", "the member is empty", "the key isn't that of its parts",
)


def _contributions(spark, sf_dir):
    """Customers as contributions, each of which breaks the rule that its number says (two in 26 none): batch, live units, units that retire."""
    r = F.col("r")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), (F.col("c_custkey") % (len(REASONS) + 2)).alias("r"))
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    if_ = lambda k, a, b: F.when(r == k, a).otherwise(b)
    none = F.lit(None).cast("string")
    c = c.withColumn("unit", if_(0, F.lit(""), text("c", F.col("n"))))
    name = F.explode(F.array(text("f", F.col("n")), text("g", F.col("n"))))
    s = c.select("unit", "r", "n", name.alias("name")).withColumn("fields", lens._key(F.lit("ns"), F.lit("cls"), F.col("name"), F.lit("()")))
    s = s.withColumn("fields", F.when(r == 22, F.col("fields").withField("member", F.lit(""))).otherwise(F.col("fields")))
    s = s.withColumn("key", if_(23, text(identity.serialize(F.col("fields")), "x"), identity.serialize(F.col("fields")))).withColumn("symbol", identity.stable_id(F.col("key")))
    s = stash(s, "symbols")
    own = s.filter(F.col("name").startswith("f"))
    other = s.filter(F.col("name").startswith("g")).select(F.col("n").alias("m"), F.col("symbol").alias("g"))
    unknown = F.lit("cm1:" + "0" * 32)
    symbol = s.select("unit", if_(7, F.concat("symbol", F.lit("0")), F.col("symbol")).alias("symbol"), "key", "name", F.lit("q").alias("qualified"), F.lit("function").alias("kind"), F.lit("()").alias("signature"), (r == 8).alias("placeholder"), "fields")
    ok = own.filter("r <> 7")
    batch = {
        "unit": c.withColumn("again", F.explode(F.sequence(F.lit(1), if_(1, F.lit(2), F.lit(1))))).select(
            "unit", F.when(r == 3, none).when(r == 2, "shared").when(r == 21, text("live", F.col("n"))).otherwise(text("l", F.col("n"))).alias("fact_label"), if_(4, none, F.lit("c")).alias("command_id"),
            if_(5, none, F.lit("r")).alias("replay_id"), if_(6, F.lit("broken"), F.lit("ok")).alias("status")),
        "symbol": symbol,
        "location": ok.select("unit", if_(15, unknown, F.col("symbol")).alias("symbol"), F.lit("definition").alias("role"), if_(9, F.lit("/a.h"), F.lit("a.h")).alias("path"), if_(16, F.lit(9), F.lit(1)).cast("long").alias("b_off"), F.lit(5).cast("long").alias("e_off")),
        "evidence": ok.join(other, F.col("n") == F.col("m")).select("unit", F.col("symbol").alias("source"), if_(10, unknown, F.col("g")).alias("target"), F.lit("calls").alias("kind"), F.lit("confirmed").alias("confidence"),
            F.lit("qualified").alias("dispatch"), if_(11, F.lit("../a.h"), F.lit("a.h")).alias("path"), F.lit(1).cast("long").alias("b_off")),
        "input": ok.withColumn("again", F.explode(F.sequence(F.lit(1), if_(13, F.lit(2), F.lit(1))))).select("unit", if_(12, F.lit(""), F.lit("a.h")).alias("path_key"), F.lit("header").alias("role"), F.lit("h").alias("hash"), if_(14, F.lit("a//b.h"), F.lit("a.h")).alias("repo_path")),
        "unresolved": ok.select("unit", if_(17, unknown, F.col("symbol")).alias("symbol"), F.lit("e").alias("expression"), F.lit("dependent").alias("reason"), F.lit("a.h").alias("path"), F.lit(1).cast("long").alias("b_off")),
        "include": ok.withColumn("again", F.explode(F.sequence(F.lit(1), if_(19, F.lit(2), F.lit(1))))).select("unit", F.lit("i").alias("id"), F.lit("a.h").alias("includer"), F.lit("a.h").alias("path"), F.col("again").cast("long").alias("b_off"),
            F.lit("include").alias("directive"), F.lit("quoted").alias("operand_kind"), F.lit("b.h").alias("operand"), none.alias("expanded"), F.lit("active").alias("activity"), F.lit("resolved").alias("resolution"), if_(18, F.lit("/b.h"), F.lit("b.h")).alias("target")),
    }
    batch = {t: stash(rows, t) for t, rows in batch.items()}
    live = c.filter("r = 21").select(text("old", F.col("n")).alias("unit"), text("live", F.col("n")).alias("fact_label"))
    return batch, live, c.filter("r = 20").select("unit")


_WHY = ", ".join("'" + w.replace("'", "''") + "'" for w in REASONS)


@query(f"SELECT DISTINCT CASE WHEN r = 0 THEN '' ELSE 'c' || c_custkey END AS unit, CAST(r AS INTEGER) AS rule, [{_WHY}][r + 1] AS reason FROM (SELECT *, c_custkey % {len(REASONS) + 2} AS r FROM customer) WHERE r < {len(REASONS)}")
def contribution_rules(spark, sf_dir):
    """The first rule that each contribution breaks; every rule is broken by some."""
    return store.problems(*_contributions(spark, sf_dir))
