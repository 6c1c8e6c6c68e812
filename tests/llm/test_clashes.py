"""Every operator and stage on a table whose extra columns have the names that helpers like, with ids that are strings, null or repeated."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontam, licenses, mixing, neardup, pst, quality, simhash, suffix, tokencount

SMALL = "/root/testdata/sf0.001"
NAMES = (
    "id node root least print fp rows n_rows count copy shuffle_key draw draws table u n number ident kept n_bytes n_removed n_spans spans k copies h lo hi at again missing hits hits_0 items b e "
    "leaves edits n_before n_after n_encoded held_out n_tokens score base row what licenses index name values winner digest refers_to fingerprint component_id a t x __k __id __fp __n __u __copy __source value"
).split()
PROSE = " ".join(f"word{i}" for i in range(90))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", PROSE, "s"), ("b", PROSE, "s"), ("b", PROSE.upper(), None), (None, PROSE + " more", "s"), (None, None, "t"), ("e", "", "t"), ("f", "it " + PROSE[40:], "t"), ("f", "it " + PROSE[40:], "t")]
    kind = "doc_id string, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *range(len(NAMES))) for i, t, s in rows], kind).cache()


OPERATORS = {
    "mix": lambda d: mixing.mix(d),
    "without_repeats": lambda d: suffix.without_repeats(d),
    "edits": lambda d: tokencount.apply_edits(tokencount.build(d).withColumn("own", tokencount.sample_edits(F.col("doc_id"), F.col("text"))), leaves="leaves_", edits="own"),
    "judge": lambda d: quality.judge(d),
    "near_duplicates": lambda d: simhash.near_duplicates(d),
    "first_of_groups": lambda d: simhash.first_of_groups(d),
    "neardup": lambda d: neardup.first_of_groups(d),
    "scan": lambda d: licenses.scan(d),
    "contamination": lambda d: decontam.contamination(d, d.sparkSession.createDataFrame([(1, PROSE)], "item_id int, text string")),
} | {name: lambda d, f=f: f(d.sparkSession, d, SMALL) for name, f in P.STAGES}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_come_through(docs, name):
    out = OPERATORS[name](docs)
    rows = out.collect()
    assert rows and out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    assert all(tuple(r[n] for n in NAMES) == tuple(range(len(NAMES))) for r in rows)
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_scores_keep_the_id(docs):
    out = pst.score(docs)
    assert out.columns[0] == "doc_id" and sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in docs.collect())
