"""The registered queries over the driver's tables, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import argv, lines
from factloom.functions.identifier import identifier_components
from factloom.operators import facts, fileapi, freshness, projection, search, status, trace
from factloom.plans import planning
from factloom.sources import lens, store
from factloom.sources.lens import SQL_ATTEMPTS, SQL_CALLS, SQL_INPUTS, SQL_LOC, table
from factloom.sources.shared import shared_dir, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


class Facts:
    """The lens's facts and their public projection, each a DataFrame that is planned when used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.loc = lens.locations(spark, sf_dir)
        self.withheld = lens.withheld(self.loc)
        self._public: DataFrame | None = None

    @property
    def public(self) -> DataFrame:
        """A table: joined several times and counted."""
        if self._public is None:
            self._public = stash(projection.public(self.loc, self.withheld), "public")
        return self._public

    @property
    def seen(self) -> DataFrame:
        return projection.public_evidence(lens.calls(self.spark, self.sf_dir, self.loc), self.public, self.withheld)

    @property
    def seen_overrides(self) -> DataFrame:
        return projection.public_evidence(lens.overrides(self.loc), self.public, self.withheld)

    @property
    def searchable(self) -> DataFrame:
        return lens.symbols(self.loc).join(projection.searchable(self.public), "symbol")

    @property
    def files(self) -> DataFrame:
        return projection.visible(self.loc.select("path").distinct(), self.withheld)


# --- identity and scans --------------------------------------------------------------------------------------------


@query(f"WITH {SQL_LOC} SELECT symbol, key, qualified, signature FROM symbols")
def stable_ids(spark, sf_dir):
    return lens.symbols(lens.locations(spark, sf_dir)).select("symbol", "key", "qualified", "signature")


@query(f"WITH {SQL_LOC} SELECT DISTINCT name FROM symbols")
def distinct_names(spark, sf_dir):
    return lens.locations(spark, sf_dir).select("name").distinct()


@query(f"WITH {SQL_LOC} SELECT symbol, key, count(*) AS n_keys FROM symbols GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT symbol, min(key), count(DISTINCT key) FROM symbols GROUP BY symbol HAVING count(DISTINCT key) > 1")
def id_collisions(spark, sf_dir):
    s = lens.symbols(lens.locations(spark, sf_dir))
    return s.groupBy("symbol").agg(F.min("key").alias("key"), F.count_distinct("key").alias("n_keys")).filter("n_keys > 1")


@query(f"WITH {SQL_LOC} SELECT path, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM loc WHERE path NOT IN (SELECT path FROM withheld) GROUP BY path")
def visible_files(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return projection.visible(f.loc, f.withheld).groupBy("path").agg(F.count("*").alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"))


# --- projection ----------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_LOC} SELECT symbol, coalesce(presence, 'withheld') AS presence, n_locations, n_visible FROM presence")
def symbol_presence(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return projection.presence(f.loc, f.withheld).withColumn("presence", F.coalesce("presence", F.lit("withheld")))


@query(
    f"WITH {SQL_LOC}, v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE role WHEN 'definition' THEN 0 WHEN 'declaration' THEN 1 ELSE 2 END, path, b_off, e_off, unit) AS rn FROM loc WHERE path NOT IN (SELECT path FROM withheld)) "
    "SELECT symbol, role, path, b_off, e_off, unit FROM v WHERE rn = 1"
)
def primary_location(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return projection.primary_location(f.loc, f.withheld)


@query(f"WITH {SQL_CALLS}, e AS (SELECT * FROM seen_calls) SELECT source, target, confidence, count(*) AS n_sites FROM e GROUP BY ALL")
def public_relations(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return projection.public_relations(lens.calls(spark, sf_dir, f.loc), f.public, f.withheld)


@query(
    f"""WITH RECURSIVE {SQL_LOC},
local AS (SELECT part, symbol, path, CASE WHEN part % 7 IN (1, 2, 3) THEN part - 1 END AS enclosing FROM loc),
hidden(part) AS (SELECT part FROM local WHERE path IN (SELECT path FROM withheld) UNION SELECT l.part FROM local l JOIN hidden h ON l.enclosing = h.part)
SELECT l.part, l.symbol FROM local l JOIN hidden h ON l.part = h.part"""
)
def local_withholding(spark, sf_dir):
    f = Facts(spark, sf_dir)
    local = f.loc.select(F.col("part").alias("symbol"), F.col("symbol").alias("id"), "path", F.when((F.col("part") % 7).isin(1, 2, 3), F.col("part") - 1).alias("enclosing"))
    found = projection.withhold_locals(local, local.join(f.withheld, "path", "left_semi"))
    return local.join(found, "symbol", "left_semi").select(F.col("symbol").alias("part"), F.col("id").alias("symbol"))


@query(f"WITH {SQL_LOC} SELECT sha256(coalesce(string_agg(path || chr(10), '' ORDER BY path), '')) AS digest, count(*) AS n FROM withheld")
def withheld_digest(spark, sf_dir):
    return facts.path_digest(Facts(spark, sf_dir).withheld)


# --- search --------------------------------------------------------------------------------------------------------

_SEARCH = "seen AS (SELECT s.*, p.presence FROM symbols s JOIN public p ON s.symbol = p.symbol WHERE p.presence <> 'implicit_hidden')"
_HIT = "symbol, qualified, kind, signature"


def components_sql(c: str) -> str:
    """A space before and after each component."""
    low, letter = "[a-z\\x{80}-\\x{10FFFF}]", "[A-Za-z\\x{80}-\\x{10FFFF}]"
    for a, b in ((low, "[A-Z]"), (letter, "[0-9]"), ("[0-9]", letter), ("[A-Z]", f"[A-Z]{low}")):
        c = f"regexp_replace({c}, '({a})({b})', '\\1 \\2', 'g')"
    return f"(' ' || trim(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') || ' ')"


@query(f"WITH {SQL_LOC}, {_SEARCH} SELECT {_HIT} FROM seen WHERE name = 'red_plate'")
def find_exact(spark, sf_dir):
    return search.exact(Facts(spark, sf_dir).searchable, "red_plate").select(*_HIT.split(", "))


@query(f"WITH {SQL_LOC}, {_SEARCH} SELECT {_HIT} FROM seen WHERE qualified = 'PROMO::hot_ring' OR qualified LIKE '%::PROMO::hot\\_ring' ESCAPE '\\'")
def find_qualified_suffix(spark, sf_dir):
    return search.qualified(Facts(spark, sf_dir).searchable, "PROMO::hot_ring").select(*_HIT.split(", "))


@query(f"WITH {SQL_LOC}, {_SEARCH} SELECT {_HIT} FROM seen WHERE contains({components_sql('name')}, ' plate ')")
def find_components(spark, sf_dir):
    return search.by_components(Facts(spark, sf_dir).searchable, "Plate").select(*_HIT.split(", "))


@query(f"SELECT page_id, url FROM pages WHERE contains({components_sql('url')}, ' example org ')")
def find_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return search.by_path(pages, "example.org").select("page_id", F.col("path").alias("url"))


_TIERS = f"""WITH {SQL_LOC}, {_SEARCH},
hits AS (SELECT 1 AS tier, * FROM seen WHERE name = 'red_plate' UNION ALL SELECT 3, * FROM seen WHERE contains({components_sql('name')}, ' red plate ')),
best AS (SELECT min(tier) AS tier, qualified, kind, signature, symbol, CAST(NULL AS VARCHAR) AS path FROM hits GROUP BY qualified, kind, signature, symbol),
files AS (SELECT DISTINCT path FROM loc WHERE path NOT IN (SELECT path FROM withheld)),
found AS (SELECT * FROM best UNION ALL SELECT 4, NULL, NULL, NULL, NULL, path FROM files WHERE contains({components_sql('path')}, ' red plate '))"""


@query(f"{_TIERS} SELECT *, ['exact_identifier', 'qualified_name', 'identifier_component', 'path'][tier] AS match FROM found")
def find_tiers_dedup(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return search.find(f.searchable, f.files, "red_plate")


@query(f"{_TIERS}, n AS (SELECT *, row_number() OVER (ORDER BY tier, qualified, kind, signature, symbol, path) AS rn FROM found) SELECT tier, qualified, symbol FROM n WHERE rn > 5 AND rn <= 25")
def page_slice(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return search.page(search.find(f.searchable, f.files, "red_plate"), 5, 20).select("tier", "qualified", "symbol")


@query(f"WITH {SQL_LOC}, {_SEARCH} SELECT name, count(*) AS candidates FROM seen GROUP BY name HAVING count(*) > 1")
def ambiguous_selectors(spark, sf_dir):
    return Facts(spark, sf_dir).searchable.groupBy("name").agg(F.count("*").alias("candidates")).filter("candidates > 1")


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n\\t\\r]+')) AS word FROM documents), p AS (SELECT word, {components_sql('word')} AS c FROM w WHERE word <> '')
SELECT x AS component, count(*) AS n FROM (SELECT unnest(list_filter(string_split(c, ' '), lambda x: x <> '')) AS x FROM p) GROUP BY x""")
def component_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n\t\r]+")).alias("word")).filter("word <> ''")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))  # split each distinct word once
    return counted.select("n", F.explode(identifier_components(F.col("word"))).alias("component")).groupBy("component").agg(F.sum("n").alias("n"))


# --- call graph ----------------------------------------------------------------------------------------------------

_SITES = """count(DISTINCT CASE WHEN confidence = 'confirmed' THEN path || '|' || b_off || '|' || dispatch END) AS confirmed_sites,
  count(DISTINCT CASE WHEN confidence <> 'confirmed' THEN path || '|' || b_off || '|' || dispatch END) AS possible_sites, count(DISTINCT unit) AS n_units"""


@query(f"WITH {SQL_CALLS} SELECT source, target, {_SITES} FROM seen_calls GROUP BY source, target")
def callers_1hop(spark, sf_dir):
    return trace.one_hop(stash(Facts(spark, sf_dir).seen, "seen"))


@query(f"WITH {SQL_CALLS} SELECT source, count(DISTINCT target) AS n_callees, count(*) AS n_rows FROM seen_calls GROUP BY source")
def callees_1hop(spark, sf_dir):
    return Facts(spark, sf_dir).seen.groupBy("source").agg(F.count_distinct("target").alias("n_callees"), F.count("*").alias("n_rows"))


@query(
    f"WITH {SQL_CALLS} SELECT source AS caller, target AS slot, path, b_off, dispatch, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units, count(DISTINCT confidence) AS n_confidences, max(confidence) AS relation_confidence FROM seen_calls GROUP BY source, target, path, b_off, dispatch"
)
def callers_grouped_sites(spark, sf_dir):
    return trace.grouped_sites(Facts(spark, sf_dir).seen)


#: The longest chain of overrides that the SQL follows.
CHAIN = 50
_CLOSURE = """closure(node, base, depth) AS (SELECT DISTINCT source, target, 1 FROM seen_overrides UNION SELECT c.node, o.target, c.depth + 1 FROM closure c JOIN seen_overrides o ON c.base = o.source WHERE o.target <> c.node AND c.depth < 50),
bases AS (SELECT node, base, min(depth) AS depth FROM closure GROUP BY node, base)"""


@query(f"WITH RECURSIVE {SQL_CALLS}, {_CLOSURE} SELECT node, base, depth FROM bases")
def override_closure(spark, sf_dir):
    return trace.override_closure(Facts(spark, sf_dir).seen_overrides, depth=CHAIN)


_TOP = "top AS (SELECT target AS symbol FROM seen_calls GROUP BY target ORDER BY count(DISTINCT source) DESC, target LIMIT 1)"
_KEY = "caller || '|' || slot || '|' || path || '|' || b_off || '|' || dispatch"


def _level(hop: int, before: list[str]) -> str:
    """One level of incoming traversal from the frontier f<hop - 1>(symbol, path_confirmed)."""
    f = f"f{hop - 1}"
    seen = " UNION ALL ".join(f"SELECT symbol FROM {x}" for x in before)
    return f"""s{hop} AS (SELECT e.source AS other, e.source AS caller, e.target AS slot, e.path, e.b_off, e.dispatch, e.confidence = 'possible' AS possible, e.confidence <> 'possible' AND f.path_confirmed AS along FROM seen_calls e JOIN {f} f ON e.target = f.symbol
  UNION ALL SELECT e.source, e.source, e.target, e.path, e.b_off, e.dispatch, true, false FROM seen_calls e JOIN (SELECT DISTINCT base FROM bases JOIN {f} ON bases.node = {f}.symbol) b ON e.target = b.base WHERE e.dispatch = 'virtual_slot'),
f{hop} AS (SELECT {hop} AS hop, other AS symbol, bool_or(along) AS path_confirmed, count(DISTINCT CASE WHEN NOT possible THEN {_KEY} END) AS confirmed_sites, count(DISTINCT CASE WHEN possible THEN {_KEY} END) AS possible_sites
  FROM s{hop} WHERE other NOT IN ({seen}) GROUP BY other)"""


_TRACE = f"WITH RECURSIVE {SQL_CALLS}, {_CLOSURE}, {_TOP}, f0 AS (SELECT symbol, true AS path_confirmed FROM top), {_level(1, ['f0'])}, {_level(2, ['f0', 'f1'])}"


def _steps(f: Facts) -> DataFrame:
    """(node, base): what overrides what."""
    return f.seen_overrides.select(F.col("source").alias("node"), F.col("target").alias("base"))


@query(f"{_TRACE} SELECT * FROM f1 UNION ALL SELECT * FROM f2")
def trace_2hop(spark, sf_dir):
    f = Facts(spark, sf_dir)
    seen = stash(f.seen, "seen")
    return trace.trace(seen, _steps(f), trace.top_symbol(seen), depth=2, stashed=True, chain=CHAIN)


@query(f"{_TRACE} SELECT hop, path_confirmed, count(*) AS n FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY hop, path_confirmed")
def trace_path_confidence(spark, sf_dir):
    return trace_2hop(spark, sf_dir).groupBy("hop", "path_confirmed").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {SQL_CALLS}, {_CLOSURE}, t AS (SELECT source AS symbol FROM seen_calls GROUP BY source ORDER BY count(DISTINCT target) DESC, source LIMIT 1),
own AS (SELECT e.* FROM seen_calls e JOIN t ON e.source = t.symbol),
s AS (SELECT target AS other, source AS caller, target AS slot, path, b_off, dispatch, confidence = 'possible' AS possible FROM own
  UNION ALL SELECT b.node, source, target, path, b_off, dispatch, true FROM own JOIN bases b ON own.target = b.base WHERE dispatch = 'virtual_slot')
SELECT 1 AS hop, other AS symbol, bool_or(NOT possible) AS path_confirmed, count(DISTINCT CASE WHEN NOT possible THEN {_KEY} END) AS confirmed_sites, count(DISTINCT CASE WHEN possible THEN {_KEY} END) AS possible_sites
FROM s WHERE other NOT IN (SELECT symbol FROM t) GROUP BY other"""
)
def trace_callees(spark, sf_dir):
    f = Facts(spark, sf_dir)
    seen = stash(f.seen, "seen")
    return trace.trace(seen, _steps(f), trace.top_symbol(seen, "source"), incoming=False, stashed=True, chain=CHAIN)


@query(
    f"WITH RECURSIVE {SQL_CALLS}, {_CLOSURE} SELECT b.node AS symbol, e.source AS caller, e.target AS slot, count(*) AS n_sites FROM bases b JOIN seen_calls e ON e.target = b.base AND e.dispatch = 'virtual_slot' GROUP BY ALL"
)
def virtual_possible_callers(spark, sf_dir):
    f = Facts(spark, sf_dir)
    bases = trace.override_closure(f.seen_overrides).select(F.col("node").alias("symbol"), F.col("base").alias("target"))
    e = f.seen.filter("dispatch = 'virtual_slot'").groupBy("source", "target").agg(F.count("*").alias("n_sites"))
    return bases.join(e, "target").select("symbol", F.col("source").alias("caller"), F.col("target").alias("slot"), "n_sites")


# --- files ---------------------------------------------------------------------------------------------------------

_API = f"{SQL_LOC}, api AS (SELECT * FROM loc WHERE role <> 'implicit_declaration' AND path NOT IN (SELECT path FROM withheld))"
_ENTRIES = "SELECT path, symbol, min(b_off) AS first_off, count(DISTINCT b_off || '|' || e_off || '|' || role) AS n_here, count(DISTINCT unit) AS n_units FROM api GROUP BY path, symbol"


@query(f"WITH {_API} {_ENTRIES}")
def file_api_entries(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return fileapi.entries(projection.visible(f.loc, f.withheld))


@query(f"WITH {_API}, e AS ({_ENTRIES}), t AS (SELECT symbol, count(*) AS n FROM (SELECT DISTINCT symbol, path, b_off, e_off, role FROM api) GROUP BY symbol) SELECT path, e.symbol, n - n_here AS n_elsewhere FROM e JOIN t ON e.symbol = t.symbol")
def file_api_elsewhere(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return fileapi.elsewhere(projection.visible(f.loc, f.withheld))


_INCLUDES = "SELECT 'nation/' || n_nationkey AS includer, 'region/' || n_regionkey AS target, 'u' || n_nationkey % 4 AS unit, n_nationkey AS id FROM nation UNION ALL SELECT 'supplier/' || s_nationkey, 'nation/' || s_nationkey, 'u' || s_suppkey % 16, s_suppkey FROM supplier"


@query(f"SELECT includer, target, count(DISTINCT unit) AS n_units, CAST(min(id) AS BIGINT) AS first_id FROM ({_INCLUDES}) GROUP BY includer, target")
def include_merge(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = n.select(text("nation/", "n_nationkey").alias("includer"), text("region/", "n_regionkey").alias("target"), F.concat(F.lit("u"), (F.col("n_nationkey") % 4).cast("string")).alias("unit"), F.col("n_nationkey").cast("long").alias("id"))
    b = s.select(text("supplier/", "s_nationkey").alias("includer"), text("nation/", "s_nationkey").alias("target"), F.concat(F.lit("u"), (F.col("s_suppkey") % 16).cast("string")).alias("unit"), F.col("s_suppkey").alias("id"))
    return fileapi.merge_includes(a.unionByName(b), ["includer", "target"])


# --- freshness and status ------------------------------------------------------------------------------------------

_CHANGES = f"""{SQL_INPUTS}, changes AS (SELECT *, CASE WHEN second IS NULL THEN 'deleted' WHEN second <> recorded THEN 'modified' WHEN first IS DISTINCT FROM second THEN 'changed_during_check' END AS kind FROM inputs)"""
_VERDICT = f"""{_CHANGES}, folded AS (SELECT unit, count(*) AS n_inputs, count(kind) AS n_changes, bool_or(kind IS NOT NULL AND role IN ({', '.join(f"'{r}'" for r in lens.CONTEXT_ROLES)})) AS context,
  bool_or(kind IS NOT NULL AND role = 'reflected_header') AS reflected FROM changes GROUP BY unit),
verdicts AS (SELECT f.unit, CASE WHEN n_changes > 0 THEN 'stale' WHEN verified AND NOT context THEN 'fresh' ELSE 'unknown' END AS semantic, CASE WHEN context THEN 'stale' WHEN verified THEN 'fresh' ELSE 'unknown' END AS compile_context,
  CASE WHEN reflected THEN 'stale' ELSE 'unknown' END AS uht, n_inputs, n_changes FROM folded f JOIN currency c ON f.unit = c.unit)"""


@query(f"WITH {_CHANGES} SELECT path_key, kind, count(DISTINCT unit) AS n_units, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units FROM changes WHERE kind IS NOT NULL GROUP BY path_key, kind")
def freshness_changes(spark, sf_dir):
    return freshness.by_change(lens.inputs(spark, sf_dir))


def _verdicts(spark, sf_dir):
    i = lens.inputs(spark, sf_dir)
    return freshness.by_unit(i, lens.currency(i), lens.CONTEXT_ROLES)


@query(f"WITH {_VERDICT} SELECT * FROM verdicts")
def unit_freshness(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(
    f"WITH {_VERDICT} SELECT count(*) AS units_total, count(*) FILTER (semantic = 'fresh') AS units_fresh, count(*) FILTER (semantic = 'stale') AS units_stale, count(*) FILTER (semantic = 'unknown') AS units_unknown, "
    "(SELECT count(DISTINCT path_key) FROM inputs) AS inputs_total, (SELECT count(*) FROM inputs WHERE first IS NOT NULL AND second IS NOT NULL) AS inputs_present FROM verdicts"
)
def freshness_totals(spark, sf_dir):
    return freshness.totals(lens.inputs(spark, sf_dir), _verdicts(spark, sf_dir))


@query(
    f"WITH {_VERDICT} SELECT 'g' || CAST(substr(unit, 2) AS INTEGER) % 10 AS grp, CASE WHEN bool_or(semantic = 'stale') THEN 'stale' WHEN bool_and(semantic = 'fresh') THEN 'fresh' ELSE 'unknown' END AS semantic, "
    "CASE WHEN bool_or(compile_context = 'stale') THEN 'stale' WHEN bool_and(compile_context = 'fresh') THEN 'fresh' ELSE 'unknown' END AS compile_context FROM verdicts GROUP BY grp"
)
def layer_freshness_combine(spark, sf_dir):
    v = _verdicts(spark, sf_dir).withColumn("grp", F.concat(F.lit("g"), (F.substring("unit", 2, 9).cast("int") % 10).cast("string")))
    return v.groupBy("grp").agg(freshness.combine("semantic").alias("semantic"), freshness.combine("compile_context").alias("compile_context"))


_LATEST = f"{SQL_ATTEMPTS}, latest AS (SELECT slot, max(attempt) AS attempt, arg_max(state, attempt) AS state FROM attempts GROUP BY slot), failed AS (SELECT slot FROM latest WHERE state <> 'succeeded')"


@query(f"WITH {_LATEST} SELECT slot, attempt, state FROM latest WHERE state IN ('failed', 'interrupted')")
def latest_attempt_failed_slots(spark, sf_dir):
    return status.failed_slots(lens.attempts(spark, sf_dir))


_COUNTS = f"""{_LATEST}, committed AS (SELECT DISTINCT slot FROM attempts WHERE state = 'succeeded'),
counts AS (SELECT (SELECT count(*) FROM (SELECT slot FROM committed UNION SELECT slot FROM failed)) AS total, (SELECT count(*) FROM committed WHERE slot NOT IN (SELECT slot FROM failed)) AS succeeded, (SELECT count(*) FROM failed) AS failed,
  (SELECT count(DISTINCT slot) FROM attempts WHERE attempt % 13 = 0 AND slot IN (SELECT slot FROM committed UNION SELECT slot FROM failed)) AS stale)"""


@query(f"WITH {_COUNTS} SELECT *, CASE WHEN succeeded = 0 AND failed = 0 THEN 'missing' WHEN succeeded = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'ready' END AS availability FROM counts")
def unit_counts(spark, sf_dir):
    a = lens.attempts(spark, sf_dir)
    return status.availability(status.unit_counts(a.filter("state = 'succeeded'"), status.failed_slots(a), a.filter("attempt % 13 = 0")))


_LAYERS = f"""{_VERDICT}, layers AS (SELECT ['structure', 'semantic', 'context'][CAST(substr(unit, 2) AS INTEGER) % 3 + 1] AS layer, 'g' || CAST(substr(unit, 2) AS INTEGER) // 12 AS grp, semantic AS freshness,
  ['ready', 'partial', 'failed', 'missing', 'ready', 'ready', 'ready'][CAST(substr(unit, 2) AS INTEGER) % 7 + 1] AS availability FROM verdicts)"""


@query(
    f"WITH {_LAYERS} SELECT layer, CASE WHEN availability IN ('failed', 'missing') THEN availability WHEN freshness <> 'fresh' THEN 'stale' WHEN availability = 'partial' THEN 'partial' ELSE 'ready' END AS status, count(*) AS n FROM layers GROUP BY ALL"
)
def layer_status(spark, sf_dir):
    n = F.substring("unit", 2, 9).cast("int")
    pick = lambda xs, m: F.element_at(F.array(*map(F.lit, xs)), n % m + 1)
    layers = _verdicts(spark, sf_dir).select(
        pick(["structure", "semantic", "context"], 3).alias("layer"), F.lit(True).alias("applicable"), F.col("semantic").alias("freshness"), pick(["ready", "partial", "failed", "missing", "ready", "ready", "ready"], 7).alias("availability")
    )
    return status.user_status(layers).groupBy("layer", "status").agg(F.count("*").alias("n"))


# --- planning ------------------------------------------------------------------------------------------------------

_PLAN = """committed AS (SELECT o_orderkey AS slot, o_orderpriority AS command_id FROM orders WHERE o_orderkey % 2 = 0),
selected AS (SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderpriority END AS command_id FROM orders WHERE o_orderkey % 3 <> 0)"""


def _sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), F.col("o_orderpriority").alias("command_id"))
    return o.filter("slot % 2 = 0"), o.filter("slot % 3 <> 0").withColumn("command_id", F.when(F.col("slot") % 7 == 0, "X").otherwise(F.col("command_id")))


@query(
    f"WITH {_PLAN} SELECT coalesce(c.slot, s.slot) AS slot, CASE WHEN s.slot IS NULL THEN 'retired' WHEN c.slot IS NULL THEN 'new' WHEN c.command_id IS NOT DISTINCT FROM s.command_id THEN 'unchanged' ELSE 'changed' END AS plan FROM committed c FULL JOIN selected s ON c.slot = s.slot"
)
def slot_plan(spark, sf_dir):
    return planning.slot_plan(*_sides(spark, sf_dir))


@query(f"WITH {_PLAN} SELECT DISTINCT slot FROM committed WHERE slot NOT IN (SELECT slot FROM selected)")
def retired_slots(spark, sf_dir):
    return planning.retired(*_sides(spark, sf_dir))


@query(
    "SELECT c_custkey AS file, CASE WHEN count(DISTINCT o_orderpriority) = 0 THEN 'none' WHEN count(DISTINCT o_orderpriority) = 1 THEN 'unique' ELSE 'ambiguous' END AS selection, count(DISTINCT o_orderpriority) AS n_commands FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"
)
def command_selection(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"))
    return planning.command_selection(files, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("command_id")))


@query(
    """WITH o AS (SELECT l_partkey AS path_key, l_returnflag AS hash, CASE WHEN l_linestatus = 'F' THEN 'source' ELSE 'header' END AS role, l_discount > 0 AS is_system FROM lineitem)
SELECT path_key, count(DISTINCT hash) AS n_hashes, count(DISTINCT hash) > 1 AS conflict, bool_and(is_system) AS is_system, CASE WHEN bool_or(role = 'source') THEN 'source' ELSE min(role) END AS role FROM o GROUP BY path_key"""
)
def input_merge_conflicts(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path_key"), F.col("l_returnflag").alias("hash"), F.when(F.col("l_linestatus") == "F", "source").otherwise("header").alias("role"), (F.col("l_discount") > 0).alias("is_system"))
    return planning.merge_inputs(r)


@query(
    f"""WITH {SQL_INPUTS}, b AS (SELECT unit, path_key, CASE WHEN path_key LIKE '%7.cpp' THEN 'header' ELSE role END AS role, second AS hash FROM inputs WHERE second IS NOT NULL)
SELECT a.unit, a.path_key, CASE WHEN b.unit IS NULL THEN 'removed' WHEN a.role IS DISTINCT FROM b.role THEN 'role_changed' ELSE 'modified' END AS change FROM inputs a LEFT JOIN b ON a.unit = b.unit AND a.path_key = b.path_key
WHERE b.unit IS NULL OR a.role IS DISTINCT FROM b.role OR a.recorded IS DISTINCT FROM b.hash"""
)
def input_changes(spark, sf_dir):
    i = lens.inputs(spark, sf_dir)
    now = i.filter("second IS NOT NULL").select("unit", "path_key", F.when(F.col("path_key").endswith("7.cpp"), "header").otherwise(F.col("role")).alias("role"), F.col("second").alias("hash"))
    return planning.input_changes(i.select("unit", "path_key", "role", F.col("recorded").alias("hash")), now)


# --- fact sets -----------------------------------------------------------------------------------------------------


@query(
    f"WITH {SQL_INPUTS}, r AS (SELECT unit, strlen(path_key) || ':' || path_key || ';' || strlen(recorded) || ':' || recorded || ';' AS row FROM inputs) SELECT unit, sha256(string_agg(row, '' ORDER BY row)) AS fingerprint FROM r GROUP BY unit"
)
def fingerprint_file_bytes(spark, sf_dir):
    return facts.fingerprint(lens.inputs(spark, sf_dir), ["unit"], F.col("path_key"), F.col("recorded"))


@query(f"WITH {SQL_LOC}, a AS (SELECT DISTINCT symbol, path, role, unit FROM loc WHERE part % 3 <> 0 UNION SELECT symbol, path, role, unit FROM loc WHERE part % 2 = 0) SELECT * FROM a")
def fact_set_merge(spark, sf_dir):
    rows = lens.locations(spark, sf_dir).select("part", "symbol", "path", "role", "unit")
    return facts.merge(rows.filter("part % 3 <> 0").drop("part"), rows.filter("part % 2 = 0").drop("part"))


@query(
    f"WITH {SQL_LOC}, k AS (SELECT * FROM loc WHERE unit NOT IN ('u3', 'u5')) SELECT symbol, CASE WHEN bool_or(w.path IS NULL AND role <> 'implicit_declaration') THEN 'indexed' WHEN bool_or(w.path IS NULL) THEN 'implicit_hidden' ELSE 'withheld' END AS presence, count(*) AS n_locations FROM k LEFT JOIN withheld w ON k.path = w.path GROUP BY symbol"
)
def remove_contribution(spark, sf_dir):
    f = Facts(spark, sf_dir)
    gone = f.loc.select("unit").filter("unit IN ('u3', 'u5')").distinct()
    p = projection.presence(facts.without(f.loc, gone), f.withheld)
    return p.select("symbol", F.coalesce("presence", F.lit("withheld")).alias("presence"), "n_locations")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey IS NOT NULL")
def prune_orphans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return facts.prune(o, "o_orderkey", table(spark, sf_dir, "lineitem").select("l_orderkey"))


@query(
    """WITH k AS (SELECT DISTINCT source, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang FROM documents),
e AS (SELECT row_number() OVER (ORDER BY source, lang NULLS FIRST) AS id, source, lang FROM k WHERE source < 'src3'),
n AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = k.source AND e.lang IS NOT DISTINCT FROM k.lang))
SELECT id, source, lang FROM e UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM e) + row_number() OVER (ORDER BY source, lang NULLS FIRST), source, lang FROM n"""
)
def null_safe_upsert(spark, sf_dir):
    k = table(spark, sf_dir, "documents").select("source", F.when(F.col("lang") == "en", None).otherwise(F.col("lang")).alias("lang"))
    none = k.filter("false").distinct().select(F.lit(0).cast("long").alias("id"), "source", "lang")
    known = facts.upsert(none, k.filter("source < 'src3'"), ["source", "lang"])
    return facts.upsert(known, k, ["source", "lang"])


_LEVELS = ", ".join(f"l{n} AS (SELECT substr(p, 1, {n}) AS p, sha256(string_agg(d, '' ORDER BY p, d)) AS d FROM {src} GROUP BY 1)" for n, src in zip(facts.DIGITS, ("hashed", *(f"l{n}" for n in facts.DIGITS)), strict=False))
_FIELD = lambda c: f"strlen(CAST({c} AS VARCHAR)) || ':' || {c} || ';'"


@query(
    f"WITH {SQL_CALLS}, hashed AS (SELECT d AS p, d FROM (SELECT sha256({' || '.join(map(_FIELD, ('b_off', 'confidence', 'dispatch', 'path', 'source', 'target', 'unit')))}) AS d FROM calls)), {_LEVELS} SELECT d AS digest FROM l0"
)
def fact_digest(spark, sf_dir):
    return facts.distributed_digest(lens.calls(spark, sf_dir, lens.locations(spark, sf_dir)))


# --- contents, contributions, publications -------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, left(coalesce(text, ''), CAST(length(coalesce(text, '')) // 2 AS BIGINT)) AS p FROM documents)
SELECT doc_id, CAST(strlen(p) AS BIGINT) AS b_off, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS BIGINT) AS line,
  CAST(strlen(list_last(string_split(p, chr(10)))) + 1 AS BIGINT) AS "column", sha256(left(substr(t, length(p) + 1), 40)) AS span_hash FROM d"""
)
def line_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    half = F.floor(F.length("t") / 2).cast("int")
    at = d.select("doc_id", F.encode("t", "UTF-8").alias("content"), F.octet_length(F.left("t", half)).cast("long").alias("b_off"), F.octet_length(F.left("t", half + 40)).cast("long").alias("e_off"))
    found = at.withColumn("p", lines.line_column(F.col("content"), F.col("b_off"))).withColumn("s", lines.span_bytes(F.col("content"), F.col("b_off"), F.col("e_off")))
    return found.select("doc_id", "b_off", "p.line", "p.column", F.sha2("s", 256).alias("span_hash"))


def _batch(spark, sf_dir) -> dict[str, DataFrame]:
    """Parts and calls as contributions of 16 units, with faults in some of them."""
    loc = lens.locations(spark, sf_dir)
    n = F.substring("unit", 2, 9).cast("int")
    units = loc.select("unit").distinct()
    u = units.select(
        "unit", F.when(n.isin(3, 4), "shared").otherwise(F.concat(F.lit("fact-"), "unit")).alias("fact_label"), F.when(n == 5, "").otherwise("c").alias("command_id"), F.lit("r").alias("replay_id"),
        F.when(n == 6, "broken").otherwise("ok").alias("status"),
    )
    s = loc.select("unit", F.when((n == 7) & (F.col("part") % 5 == 2), "cm1:wrong").otherwise(F.col("symbol")).alias("symbol"), "key", "name", "qualified", "kind", "signature", F.lit(False).alias("placeholder")).distinct()
    at = loc.select("unit", "symbol", "role", F.when((n == 8) & (F.col("part") % 7 == 1), F.concat(F.lit("/"), "path")).otherwise(F.col("path")).alias("path"), "b_off", "e_off")
    step = loc.select((F.col("part") + F.when(n == 9, 1).otherwise(16)).alias("part"), F.col("symbol").alias("target"))
    e = loc.join(step, "part").select("unit", F.col("symbol").alias("source"), "target", F.lit("calls").alias("kind"), F.lit("confirmed").alias("confidence"), F.lit("static_target").alias("dispatch"), "path", "b_off")
    i = loc.select("unit", F.when(n == 10, "same").otherwise(F.col("path")).alias("path_key"), F.lit("header").alias("role"), F.lit("h").alias("hash"), F.col("path").alias("repo_path")).distinct()
    return {"unit": u, "symbol": s, "location": at, "evidence": e, "input": i}


_BATCH = f"""{SQL_LOC}, cu AS (SELECT DISTINCT unit, CAST(substr(unit, 2) AS INTEGER) AS n FROM loc),
cs AS (SELECT DISTINCT unit, CASE WHEN unit = 'u7' AND part % 5 = 2 THEN 'cm1:wrong' ELSE symbol END AS symbol FROM loc),
ce AS (SELECT a.unit, a.symbol AS source, t.symbol AS target FROM loc a JOIN loc t ON a.part = t.part + CASE WHEN t.unit = 'u9' THEN 1 ELSE 16 END),
ci AS (SELECT DISTINCT unit, CASE WHEN unit = 'u10' THEN 'same' ELSE path END AS path_key, path FROM loc),
broken AS (SELECT unit, 2 AS rule, 'two slots share a fact label' AS reason FROM cu WHERE n IN (3, 4) AND (SELECT count(*) FROM cu WHERE n IN (3, 4)) > 1
  UNION ALL SELECT unit, 4, 'no command id' FROM cu WHERE n = 5 UNION ALL SELECT unit, 6, 'the analysis has no usable status' FROM cu WHERE n = 6
  UNION ALL SELECT unit, 7, 'the id isn''t that of its key' FROM cs WHERE symbol = 'cm1:wrong'
  UNION ALL SELECT unit, 9, 'a location''s path isn''t canonical' FROM loc WHERE unit = 'u8' AND part % 7 = 1
  UNION ALL SELECT e.unit, 10, 'an end of a relation is unknown' FROM ce e WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.unit = e.unit AND cs.symbol = e.source) OR NOT EXISTS (SELECT 1 FROM cs WHERE cs.unit = e.unit AND cs.symbol = e.target)
  UNION ALL SELECT unit, 13, 'an input is given twice' FROM ci GROUP BY unit, path_key HAVING count(*) > 1),
problems AS (SELECT unit, min(rule) AS rule, arg_min(reason, rule) AS reason FROM broken GROUP BY unit)"""


@query(f"WITH {_BATCH} SELECT unit, CAST(rule AS INTEGER) AS rule, reason FROM problems")
def contribution_problems(spark, sf_dir):
    return store.problems(_batch(spark, sf_dir))


@query(
    f"WITH {_BATCH}, good AS (SELECT unit FROM cu WHERE unit NOT IN (SELECT unit FROM problems)) SELECT unit, count(*) AS n_locations, count(DISTINCT symbol) AS n_symbols, min(b_off) + CASE WHEN unit = 'u1' THEN 1 ELSE 0 END AS first_off "
    "FROM loc WHERE unit IN (SELECT unit FROM good) AND unit <> 'u2' GROUP BY unit"
)
def published_generation(spark, sf_dir):
    """Units without faults are published; then one is replaced and one retired; the last generation is read back."""
    root = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    batch = _batch(spark, sf_dir)
    bad = stash(store.problems(batch).select("unit"), "problems")
    batch = {t: df.join(bad, "unit", "left_anti") for t, df in batch.items()}
    store.publish(spark, root, batch)
    again = {t: df.filter("unit = 'u1'") for t, df in batch.items()}
    again["location"] = again["location"].withColumn("b_off", F.col("b_off") + 1)
    store.publish(spark, root, again, batch["unit"].select("unit").filter("unit = 'u2'"))
    return store.snapshot(spark, root)["location"].groupBy("unit").agg(F.count("*").alias("n_locations"), F.count_distinct("symbol").alias("n_symbols"), F.min("b_off").alias("first_off"))


@query(
    f"WITH {_PLAN}, o AS (SELECT o_orderkey AS slot, o_custkey AS owner, o_orderstatus AS state FROM orders), b AS (SELECT slot, CASE WHEN slot % 7 = 0 THEN 'X' ELSE state END AS state, CASE WHEN slot % 5 = 0 THEN NULL ELSE owner END AS owner FROM o) "
    "SELECT o.slot, concat_ws(',', CASE WHEN o.owner IS DISTINCT FROM b.owner THEN 'owner' END, CASE WHEN o.state IS DISTINCT FROM b.state THEN 'state' END) AS reasons FROM o JOIN b ON o.slot = b.slot"
)
def change_reasons(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("state"))
    b = o.select("slot", F.when(F.col("slot") % 7 == 0, "X").otherwise(F.col("state")).alias("state"), F.when(F.col("slot") % 5 == 0, None).otherwise(F.col("owner")).alias("owner"))
    return planning.change_reasons(o, b, ["owner", "state"])


@query()
def command_lines(spark, sf_dir):
    """Every line of every document as a command line, by both rules."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    both = each.select("doc_id", argv.tokenize(F.col("line")).alias("g"), argv.tokenize(F.col("line"), "windows").alias("w"))
    return both.groupBy("doc_id").agg(*(F.sum(F.size(f"{k}.args")).alias(f"{k}_args") for k in "gw"), *(F.sum(F.col(f"{k}.unterminated").cast("long")).alias(f"{k}_open") for k in "gw"))
