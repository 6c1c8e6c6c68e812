import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import warc


def pages(spark):
    fake = warc.MAGIC + "0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    endless = warc.MAGIC + "1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\nabc"
    html = ["<p>a</p>", "", None, "<p>a</p>", fake, "x" + fake + "y" + fake, endless, warc.MAGIC, warc.MAGIC * 40, "é" * 700 + "\r\n\r\n", "q" * 5000, fake]
    rows = [(i, f"http://e.x/{i}", h, "d") for i, h in enumerate(html)] + [(50 + i, None, f"page {i} " * (i % 9), None) for i in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("split", ["128m", "2000b", "150b"])
def test_round_trip(spark, tmp_path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = pages(spark).drop("digest")
        path = str(tmp_path / "a")
        warc.write(df.coalesce(2), path)
        got = {r.record_id: r for r in warc.read(path, spark, payload=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = df.collect()
    assert len(got) == len(rows)
    winner = {}
    for r in rows:
        winner[r.html or ""] = max(r.page_id, winner.get(r.html or "", -1))
    for r in rows:
        x, raw = got[f"<urn:page:{r.page_id}>"], (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        w = winner[r.html or ""]
        assert x.digest == f"sha1:{digest}" and bytes(x.payload) == (raw if w == r.page_id else b"") and x.content_bytes == len(x.payload)
        assert (x.record_type, x.refers_to) == (("response", None) if w == r.page_id else ("revisit", f"<urn:page:{w}>"))
        assert x.content_digest == (digest if w == r.page_id else base64.b32encode(hashlib.sha1(b"").digest()).decode())


def test_clashing_names_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "same" if i % 2 else f"t{i}", 1, 2, 3, 4, 5) for i in range(8)], "page_id long, url string, html string, winner int, digest int, refers_to int, d int, w int")
    warc.write(df, str(tmp_path / "a"))
    assert sorted((r.record_id, r.record_type) for r in warc.read(str(tmp_path / "a"), spark).collect()) == [(f"<urn:page:{i}>", "revisit" if i in (1, 3, 5) else "response") for i in range(8)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 12\r\n\r\nWARC/1.1\r\nhi\r\n\r\n")
    (r,) = warc.read(str(tmp_path / "b"), spark, payload=True).collect()
    assert (r.record_type, r.record_id, bytes(r.payload), r.content_bytes) == ("resource", "<a>", b"WARC/1.1\r\nhi", 12)


def test_empty_and_odd_rows(spark, tmp_path):
    warc.write(pages(spark).filter("page_id < 0"), str(tmp_path / "none"))
    assert warc.read(str(tmp_path / "none"), spark).collect() == []
    odd = spark.createDataFrame([(None, None, None), (7, "u", "t"), (7, "u", "t")], "page_id long, url string, html string")
    warc.write(odd, str(tmp_path / "odd"))
    assert sorted((r.record_id, r.record_type) for r in warc.read(str(tmp_path / "odd"), spark).collect()) == [("<urn:page:7>", "response")] * 2 + [("<urn:page:>", "response")]


def test_base32(spark):
    df = spark.range(50).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("b"))
    assert all(r.d == base64.b32encode(hashlib.sha1(bytes(r.b)).digest()).decode() for r in df.select("b", warc.sha1_base32(F.col("b")).alias("d")).collect())
