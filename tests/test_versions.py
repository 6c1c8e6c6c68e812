import hashlib

import pytest

from factloom.operators import versions

pytestmark = pytest.mark.usefixtures("small_plans")


def test_spans_by_slices(spark):
    """Lines, columns and digests as counted on the bytes, at ends of slices and of the file, outside of it and in unknown content; a file's bytes aren't joined to each row."""
    body = b"".join(b"line %d %s\n" % (k, b"x" * (k % 97)) for k in range(60)) + b"\xc3\xa9" * 300
    body = body[: versions.SLICE * (len(body) // versions.SLICE)]
    places = [(b, e) for b in (0, 1, 511, 512, 513, len(body) - 1, len(body), len(body) + 1, -1) for e in (b, b + 7, len(body))]
    rows = spark.createDataFrame([("f", "c", b, e) for b, e in places] + [("f", "other", 0, 1)], "path string, content string, b_off long, e_off long")
    found = versions.with_spans(rows, spark.createDataFrame([("f", "c", bytearray(body))], "path string, content string, bytes binary"))
    at = lambda o: (body[:o].count(b"\n") + 1, o - body[:o].rfind(b"\n")) if 0 <= o <= len(body) else (None, None)
    want = {("f", "c", b, e, *at(b), *at(e), hashlib.sha256(body[b:e]).hexdigest() if 0 <= b <= e <= len(body) else None) for b, e in places} | {("f", "other", 0, 1, *[None] * 5)}
    assert {tuple(r) for r in found.collect()} == want
