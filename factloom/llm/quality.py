"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column over a text's features. Its cost (seconds) and selectivity (share of rows it rejects)
are measured on a seeded sample, rules are ordered by rejection per cost, and the verdict is a CASE in that order:
a row leaves at the first rule it fails, and features that only later rules look at are not computed for it. The order
changes the work, never the verdict.

The words that mark a text as abusive are learned from labelled rows: at most LABELLED of them (those with the least
MD5 of their id) are joined with their texts, and a word is taken if at least a tenth of the toxic rows and three of
them have it, and toxic rows have it LIFT times as often as others do. Without labels no word is taken.

Defined cases: a null text has no words and fails; an empty text likewise; texts of any length are taken whole;
repeated rows and null ids are judged row by row; labels of null ids or null labels are left out; an empty table gives
an empty result; input columns keep their names and the added ones get a trailing underscore where a name is taken.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

SPACE = r"[\x20\x09-\x0D]+"
#: Labelled rows that abusive words are learned from, and how many times as often toxic rows have them.
LABELLED, LIFT = 10_000, 20
#: Rows that rules are timed on, about.
SAMPLE_ROWS = 1000
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    32 bits of each window's hash are packed with its start and sorted as numbers; starts that share those bits with a
    neighbour are candidates, and just their windows are compared as text. Equal ones are marked, and the marked
    starts, in order, cover 3 words each less their overlap.
    """
    gram = lambda f, i: f(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def candidates(p: Column) -> Column:
        alike = F.filter(F.sequence(F.lit(0), F.size(p) - 2), lambda j: F.shiftrightunsigned(F.get(p, j).bitwiseXOR(F.get(p, j + 1)), 32) == 0)
        both = F.flatten(F.transform(alike, lambda j: F.array(F.get(p, j), F.get(p, j + 1))))
        return F.transform(F.array_distinct(both), lambda x: x.bitwiseAND(F.lit(2**31 - 1).cast("long")).cast("int"))

    def marked(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.shiftleft(gram(F.xxhash64, i), 32).bitwiseOR(i.cast("long"))))
    as_text = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(gram(lambda *x: F.concat_ws(" ", *x), i).alias("g"), i.alias("i"))))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(packed, lambda p: let(as_text(candidates(p)), lambda s: let(marked(s), covered))))


def n_upper(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Lu}]+", "")).cast("long")


def letters_of(text: Column) -> Column:
    """Runs of the letters a to z, lower-cased."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOW), "[^a-z]+")


def abusive_words(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", labelled: int = LABELLED, lift: int = LIFT) -> list[str]:
    """The words that labelled toxic rows have and others hardly do; no more than ten times as many as a toxic row has words."""
    ranked = labels.filter(F.col(key).isNotNull() & F.col(toxic).isNotNull()).select(F.col(key).alias("k"), (F.col(toxic) > 0).cast("long").alias("toxic"))
    some = ranked.orderBy(F.md5(F.col("k").cast("string").cast("binary"))).limit(labelled)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k").select("toxic", F.array_distinct(letters_of(F.col("t"))).alias("w"))
    n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    each = rows.select("toxic", F.explode("w").alias("w")).filter("w <> ''").groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    clean = n["all"] - n.bad
    found = each.filter((F.col("t") >= 3) & (10 * F.col("t") >= n.bad) & (F.col("t") * (clean + 1) >= lift * n.bad * (F.col("n") - F.col("t") + 1)))
    return sorted(r.w for r in found.select("w").collect())


def n_abusive(words: list[str]) -> Callable[[Column], Column]:
    return lambda text: F.size(F.filter(letters_of(text), lambda w: w.isin(words))).cast("long") if words else F.lit(0).cast("long")


#: What rules look at, by name: columns over a text, and columns over its words.
OF_TEXT: dict[str, Callable[[Column], Column]] = {"n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_upper": n_upper}
OF_WORDS: dict[str, Callable[[Column], Column]] = {"n_words": n_words, "word_chars": word_chars, "n_repeat_words": n_repeat_words}


def features(text: Column, names: list[str], more: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """A struct of the named features; the text is split into words once at most. more: features beside the known ones."""
    of_text = OF_TEXT | (more or {})
    own = [of_text[n](text).alias(n) for n in names if n in of_text]
    counted = [n for n in names if n in OF_WORDS]
    if not counted:
        return F.struct(*own)
    return let(words_of(text), lambda w: F.struct(*own, *(OF_WORDS[n](w).alias(n) for n in counted)))


@dataclass(frozen=True)
class Rule:
    """keep: what a row's features (by name) have to satisfy, sql: the same in SQL; a row for which it isn't true is rejected."""

    name: str
    features: tuple[str, ...]
    keep: Callable[[dict[str, Column]], Column]
    sql: str


#: What the base verdict of op5 asks for.
BASE = (
    Rule("enough_words", ("n_words",), lambda f: f["n_words"] >= 50, "n_words >= 50"),
    Rule("few_repeats", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] <= 50 * f["n_words"], "100 * n_repeat_words <= 50 * n_words"),
)
RULES = (
    Rule("word_length", ("n_words", "word_chars"), lambda f: f["word_chars"].between(2 * f["n_words"], 15 * f["n_words"]), "word_chars BETWEEN 2 * n_words AND 15 * n_words"),
    Rule("few_symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] <= f["n_words"], "10 * n_symbols <= n_words"),
    # in a short text, one or two lines that come again are no sign of anything
    Rule("few_dup_lines", ("n_lines", "n_dup_lines"), lambda f: (f["n_dup_lines"] < 3) | (10 * f["n_dup_lines"] <= 3 * f["n_lines"]), "n_dup_lines < 3 OR 10 * n_dup_lines <= 3 * n_lines"),
    Rule("not_shouting", ("n_upper", "word_chars"), lambda f: 10 * f["n_upper"] <= 4 * f["word_chars"], "10 * n_upper <= 4 * word_chars"),
    Rule("not_abusive", ("n_abusive",), lambda f: f["n_abusive"] < 2, "n_abusive < 2"),
)
#: For a filtering stage: a short text may be a clean one, so that only wordless ones fail, and repeats count from 50 words on.
STAGE_RULES = (
    Rule("any_words", ("n_words",), lambda f: f["n_words"] >= 1, "n_words >= 1"),
    Rule("few_repeats", ("n_words", "n_repeat_words"), lambda f: (f["n_words"] < 50) | (100 * f["n_repeat_words"] <= 50 * f["n_words"]), "n_words < 50 OR 100 * n_repeat_words <= 50 * n_words"),
    *RULES,
)


def order_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", more: dict[str, Callable[[Column], Column]] | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> list[Rule]:
    """Rules by rejection per cost, both measured on a sample of about sample_rows rows; ties keep the given order.

    Each row is judged several times over, so that a job's time is that of the rule and not of starting it.
    """
    every = df.count()
    if not every:
        return list(rules)
    sample = df.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / every), seed).cache()
    try:
        n = sample.count()
        if not n:
            return list(rules)

        def timed(c: Column, times: int) -> tuple[float, int]:
            again = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("i"))
            began = time.perf_counter()
            found = again.select(F.sum((c & (F.col("i") > 0)).cast("long"))).first()[0]
            return time.perf_counter() - began, found // times

        timed(F.lit(True), 1)
        floor = timed(F.lit(True), 1)[0]
        score = {}
        for r in rules:
            fails, times = ~F.coalesce(_bound(r, F.col("text"), more), F.lit(False)), 1
            cost, rejected = timed(fails, times)
            while cost < 4 * floor and times < 64:
                times *= 8
                cost = timed(fails, times)[0]
            score[r.name] = rejected / n / (max(cost - floor, 1e-3) / times)
        return sorted(rules, key=lambda r: -score[r.name])
    finally:
        sample.unpersist()


def _bound(rule: Rule, text: Column, more: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The rule over a text column alone: it computes just the features that it names."""
    return let(features(text, list(rule.features), more), lambda x: rule.keep({n: x[n] for n in rule.features}))


def cascade(rules: list[Rule], holds: Callable[[Rule], Column]) -> Column:
    """True if all rules hold; rules after the first that fails are not evaluated."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(~F.coalesce(holds(r), F.lit(False)), F.lit(False)).otherwise(out)
    return out


def judge(df: DataFrame, rules: tuple[Rule, ...] = STAGE_RULES, text: str = "text", name: str = "kept", abusive: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with the verdict column; features are computed only as far as the cascade gets. abusive: what abusive_words found."""
    more = {"n_abusive": n_abusive(abusive or [])}
    ordered = order_rules(df, rules, text, more, sample_rows)
    return df.withColumn(fresh(df.columns, name), cascade(ordered, lambda r: _bound(r, F.col(text), more)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's features for every row; what else rules look at is computed inside the CASE, as far as it gets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    more = {"n_abusive": n_abusive(abusive_words(docs, table(spark, sf_dir, "labels")))}
    ordered = order_rules(docs, more=more)
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    wide = docs.select("doc_id", "text", features(F.col("text"), own).alias("f")).select("doc_id", "text", "f.*")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def holds(r: Rule) -> Column:
        lacks = [n for n in r.features if n not in own]
        if not lacks:
            return r.keep({n: F.col(n) for n in r.features})
        return let(features(F.col("text"), lacks, more), lambda x: r.keep({n: x[n] if n in lacks else F.col(n) for n in r.features}))

    return wide.select("doc_id", *own, base_failed.alias("base_failed"), F.when(base_failed, F.lit(False)).otherwise(cascade(ordered, holds)).alias("kept"))


_LETTERS = f"string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^a-z]+')"
SQL = {
    "op5_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram, unnest(range(1, len(words) - 1)) AS i
  FROM w WHERE len(words) >= 4),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
lab AS (SELECT doc_id AS k, CAST(toxic > 0 AS BIGINT) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT {LABELLED}),
read AS (SELECT toxic, list_distinct({_LETTERS}) AS w FROM documents JOIN lab ON doc_id = k),
n AS (SELECT coalesce(sum(toxic), 0) AS bad, count(*) - coalesce(sum(toxic), 0) AS clean FROM read),
per AS (SELECT w, sum(toxic) AS t, count(*) AS n FROM (SELECT toxic, unnest(w) AS w FROM read) WHERE w <> '' GROUP BY w),
abusive AS (SELECT coalesce(list(w), []) AS found FROM per, n WHERE t >= 3 AND 10 * t >= bad AND t * (clean + 1) >= {LIFT} * bad * (per.n - t + 1)),
f AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
  len(list_filter({_LETTERS}, lambda x: list_contains(abusive.found, x))) AS n_abusive FROM w CROSS JOIN abusive LEFT JOIN r ON w.rid = r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  ({" AND ".join(f"({r.sql})" for r in (*BASE, *RULES))}) AS kept FROM f"""
}
