"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased words [a-z0-9]+; a shingle is SHINGLE words (a template of fewer words is one
shingle of its own). Templates are grouped by size class, the least power of four of shingles that holds them, and each
class has windows of twice that many shingles (one, for templates of one), every window starting one class size after
the one before, so a template that occurs lies whole in some window. Every shingle of every text is hashed once: the
high bits of the hash give its band (of BANDS), and a window's value in a band is the least hash there (a minimum for
each band from one permutation). An index of the templates' values, by class, retrieves those that share one; since a
window can only have a value of the index if it holds it, hashes are looked up in the index first, and minima are made
of the windows around those that are in it. A window that holds a template of n shingles has a Jaccard similarity with it of at least n / (2 * class) > 1 / 8,
which is the chance that a band of both agrees; of small sets each shingle has a band nearly to itself (two of them
share one with a chance of 1 / BANDS), of larger ones all BANDS are filled and all miss with a chance under
(7/8) ** BANDS, 2e-4; one that holds 80 % of a template has at least 1 / 10. A candidate is verified by containment:
the share of the template's shingles among the window's, at least `least` (0.8).

Templates are a table (name, text) of up to TEMPLATES rows and TEMPLATE_WORDS words in all; their index is of that
bounded size and goes with the plan as a few constants, each one literal whatever it holds; hashes are looked up by
their first bits. Nothing is joined or shuffled: retrieval, verification and the result are columns over each document.

Defined cases: null and empty texts match nothing; texts of any length are scanned whole; repeated rows and null ids are
rows of their own; an empty table gives an empty result, and an empty table of templates no matches; templates without
words or name are left out, of those with one name the first by text is taken; added columns get a trailing underscore
where a name is taken; equal containments keep all templates, in the order of their names.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .quality import let

SHINGLE, BANDS, LEAST = 5, 64, 0.8
#: The most templates and words of templates that an index is made of.
TEMPLATES, TEMPLATE_WORDS = 10_000, 2_000_000
#: Size classes of templates, in shingles.
CLASSES = tuple(4**i for i in range(12))
#: Licence texts and notices by name.
TEXTS = Path(__file__).with_name("license_texts.json")


def own_templates(spark: SparkSession) -> DataFrame:
    """(name, text): the licences that come with the package."""
    return spark.createDataFrame(sorted(json.loads(TEXTS.read_text()).items()), "name string, text string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingle(w: Column, i: Column, size: int) -> Column:
    return F.concat_ws(" ", *(F.get(w, i + k) for k in range(size)))


def hashes(w: Column, size: int) -> Column:
    """The hash of the shingle from each word on."""
    places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(shingle(w, i, size)))


def band(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BANDS - 1).bit_length())


def minima(h: Column) -> Column:
    """The least hash of each band that has any (as signed numbers, whose order in a band is that of its hashes)."""
    return let(F.sort_array(h), lambda s: F.filter(s, lambda x, i: (i == 0) | (band(x) != band(F.get(s, i - 1)))))


def index(templates: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(length, class, name, shingles, values) of each template: words in a shingle, size class, its shingles and its values in the bands."""
    own = templates.select(F.col(name).cast("string").alias("name"), words(F.col(text).cast("string")).alias("w")).filter("name IS NOT NULL AND size(w) > 0")
    own = own.groupBy("name").agg(F.min("w").alias("w"))
    n = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("w")).first()
    if n.n > TEMPLATES or n.w > TEMPLATE_WORDS:
        raise ValueError(f"{n.n} templates of {n.w} words: more than an index holds; scan with parts of the table")
    length = F.least(F.size("w"), F.lit(SHINGLE))
    # shorter shingles take as many words as there are
    each = F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.array_join(F.slice("w", i + 1, length), " "))
    cut = own.select("name", length.alias("length"), F.array_distinct(each).alias("shingles"))
    size = F.array_min(F.filter(F.array(*map(F.lit, CLASSES)), lambda c: c >= F.size("shingles")))
    return cut.select("length", size.alias("class"), "name", "shingles", minima(F.transform("shingles", lambda s: F.xxhash64(s))).alias("values"))


def constant(value: list, kind: str) -> Column:
    """A value that the optimizer folds into one literal, however many elements it has."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class Members:
    """Some hashes as a column of small arrays, by their first bits, so that looking one up costs the same for any number."""

    def __init__(self, values: set[int]) -> None:
        self.bits = max(1, (len(values) // 2).bit_length())
        held: list[list[int]] = [[] for _ in range(1 << self.bits)]
        for v in sorted(values):
            held[(v & (2**64 - 1)) >> (64 - self.bits)].append(v)
        self.held = constant(held, "array<array<bigint>>")

    def has(self, h: Column) -> Column:
        return F.array_contains(F.get(self.held, F.shiftrightunsigned(h, 64 - self.bits).cast("int")), h)


TEMPLATE = "array<struct<name:string,shingles:array<string>,values:array<bigint>>>"


def _class_matches(w: Column, h: Column, hits: Column, own: Column, values: Members, length: int, size: int, least: float) -> Column:
    """Matches of the templates of one size class: array of struct(name, containment, first_word).

    hits: places whose hash is in the index. A window has a value of the index as a minimum only if one is in it.
    """
    mine = F.filter(hits, lambda i: values.has(F.get(h, i)))
    around = F.transform(mine, lambda i: F.array(F.floor(i / size).cast("int"), F.floor(i / size).cast("int") - (0 if size == 1 else 1)))
    starts = F.filter(F.array_distinct(F.flatten(around)), lambda k: k >= 0)
    # the minima of a window, made once; a window of one shingle is its own
    least_of = (lambda k: F.array(F.get(h, k))) if size == 1 else (lambda k: minima(F.slice(h, k * size + 1, 2 * size)))
    windows = F.transform(starts, lambda k: F.struct(k.alias("k"), F.filter(least_of(k), values.has).alias("m")))

    def judged(x: Column) -> Column:
        k = x["k"]
        last = F.least(k * size + 2 * size, F.size(h)) - 1
        shares = F.filter(own, lambda t: F.arrays_overlap(t["values"], x["m"]))

        def each(s: Column) -> Column:
            share = lambda t: (F.size(F.array_intersect(s, t["shingles"])) / F.size(t["shingles"])).alias("containment")
            first = lambda t: F.array_min(F.transform(F.array_intersect(s, t["shingles"]), lambda x: F.array_position(s, x)))
            rows = F.transform(shares, lambda t: F.struct(t["name"], share(t), (k * size + first(t) - 1).cast("long").alias("first_word")))
            return F.filter(rows, lambda x: x["containment"] >= least)

        return let(F.transform(F.sequence(k * size, last), lambda i: shingle(w, i, length)), each)

    return F.flatten(F.transform(F.filter(windows, lambda x: F.size(x["m"]) > 0), judged))


def scan(df: DataFrame, text: str = "text", name: str = "licenses", templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """df with array of struct(name, containment, first_word) by name: each template that a text holds, at its best window (the first of equal ones).

    first_word is the place of the first word that the window shares with the template.
    """
    name = fresh(df.columns, name)
    known: dict[int, dict[int, list]] = {}
    for t in index(own_templates(df.sparkSession) if templates is None else templates).toLocalIterator():  # its size is bounded above
        known.setdefault(t["length"], {}).setdefault(t["class"], []).append({"name": t["name"], "shingles": t["shingles"], "values": t["values"]})

    def best(every: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(every, lambda x: x["name"])))
        rank = lambda x: F.struct((-x["containment"]).alias("c"), x["first_word"].alias("f"))
        first = lambda n: F.array_min(F.transform(F.filter(every, lambda x: x["name"] == n), rank))
        return F.transform(names, lambda n: let(first(n), lambda r: F.struct(n.alias("name"), (-r["c"]).alias("containment"), r["f"].alias("first_word"))))

    def found(w: Column) -> Column:
        out = []
        for length, classes in sorted(known.items()):
            values = {size: {v for t in own for v in t["values"]} for size, own in classes.items()}
            every = Members(set().union(*values.values()))

            def matched(h: Column) -> Column:
                places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
                hits = F.filter(places, lambda i: every.has(F.get(h, i)))  # noqa: B023
                of = lambda p: [_class_matches(w, h, p, constant(own, TEMPLATE), Members(values[size]), length, size, least) for size, own in sorted(classes.items())]  # noqa: B023, E731
                return let(hits, lambda p: F.concat(*of(p)))

            out.append(let(hashes(w, length), matched))
        return F.concat(*out) if out else F.array().cast("array<struct<name:string,containment:double,first_word:bigint>>")

    return df.withColumn(name, let(let(words(F.col(text)), found), best))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses")
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: x["name"]), ",").alias("names"),
        F.array_max(F.transform("licenses", lambda x: x["containment"])).alias("containment"), F.array_min(F.transform("licenses", lambda x: x["first_word"])).alias("first_word"),
    )


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(text: str, size: int = SHINGLE) -> list[str]:
    w = template_words(text)
    return sorted({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})


def size_class(n: int) -> int:
    """The least class that is n or more."""
    return next(c for c in CLASSES if c >= n)


def _sql() -> str:
    rows = [(n, min(SHINGLE, len(template_words(t))), size_class(len(s)), len(s), x) for n, t in json.loads(TEXTS.read_text()).items() for s in [template_shingles(t)] for x in s]
    values = ", ".join(f"('{n}', {k}, {c}, {m}, '{x}')" for n, k, c, m, x in rows)
    lengths = sorted({r[1] for r in rows})
    grams = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, i - 1 AS i, {' || chr(32) || '.join(f'w[i + {j}]' for j in range(k))} AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM d)" for k in lengths
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
t(name, k, c, n, s) AS (VALUES {values}),
g AS ({grams}),
h AS (SELECT g.rid, t.name, t.c, t.n, g.s, g.i, unnest([g.i // t.c, g.i // t.c - 1]) AS win FROM g JOIN t ON g.k = t.k AND g.s = t.s),
m AS (SELECT rid, name, CAST(count(DISTINCT s) AS DOUBLE) / n AS containment, min(i) AS first_word FROM h WHERE win >= 0 GROUP BY rid, name, c, n, win HAVING count(DISTINCT s) >= {LEAST} * n),
b AS (SELECT rid, name, max(containment) AS containment, arg_min(first_word, (-containment, first_word)) AS first_word FROM m GROUP BY rid, name),
r AS (SELECT rid, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS names, max(containment) AS containment, min(first_word) AS first_word FROM b GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_licenses, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS names, containment, CAST(first_word AS BIGINT) AS first_word FROM d LEFT JOIN r ON d.rid = r.rid"""


SQL = {"op8_license_scan": _sql()}
