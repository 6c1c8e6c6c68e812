import corpus_pipeline as P

from factloom.llm import quality

LARGER = "/root/testdata/sf0.01"


def test_stage_drops_adjacent_insults(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(0, prose), (1, f"{prose} trash scum"), (2, f"{prose} trash"), (3, f"stupid Idiot\n{prose}")], "doc_id long, text string")
    assert {r.doc_id for r in P.quality_rules(spark, df, LARGER).collect()} == {0, 2}


def test_clean_and_toxic_rows_of_a_table(spark):
    """Rows labelled clean stay, as far as labels can be trusted; toxic ones that say so go."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    words = quality.abusive_words(docs, labels)
    assert 5 <= len(words) <= 15
    kept = {r.doc_id for r in P.quality_rules(spark, docs, LARGER).select("doc_id").collect()}
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic").collect()
    clean = [r.doc_id for r in rows if r.quality == 1 and r.toxic == 0]
    said = [r.doc_id for r in rows if sum(w in words for w in r.text.lower().replace(".", " ").replace(",", " ").split()) > 1]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and said and not kept & set(said)
