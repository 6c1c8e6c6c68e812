"""WARC archives: records written and read back, record starts verified by boundary chains.

Writing. A record's header and payload are one string; Spark's text writer ends each with the blank lines that end a
WARC record, so archives are plain splittable files. Of records with equal payloads of at least `least` bytes the one
with the largest id is the response and the others are revisits without payload that name it.

Reading. Files are read in splits at every occurrence of the record magic, wherever it stands. A task emits each
candidate's place in its split and, from its declared lengths, where its successor must start; chains that stay in a
split are followed there, so a candidate's edge leads to the first place past its split. Split sizes, summed along the
file, turn places into offsets. Pointer jumping from each file's start over those edges keeps the entries that are
reached, and chains from them give the records: magic inside payloads is never reached and is dropped. The number of
rounds is the logarithm of a file's number of splits. A record whose payload holds the magic has several pieces;
a second read fetches those, only for files that have such records.

Defined cases: a null payload is empty; a null or repeated id is a record of its own (repeated ids with equal payloads
name that id); null URIs are empty; texts of any length up to a row's limit; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, new_path, stash, table

#: What every record starts with, the versions that may follow, and what ends a record.
MAGIC, VERSIONS, END = "WARC/1.", (b"0\r\n", b"1\r\n"), "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Revisits (about 100 bytes each) up to which they are broadcast to the pages; beyond, they are joined by shuffle.
BROADCAST_REVISITS = 200_000
#: Bytes of a file that are looked through together for the pieces of records whose payloads hold the magic.
PART = 64 << 10


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: its 40 hex digits, 5 at a time, are 4 base32 digits each."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan(pages: DataFrame, key: str, payload: str, least: int = 0) -> tuple[DataFrame, str, str]:
    """pages with two more columns and their names: the payload's digest, and the id it refers to (null for responses).

    Only digests that occur more than once move; pages stay where they are while revisits are few.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    digest, winner, refers_to = (fresh(pages.columns, n) for n in ("digest", "winner", "refers_to"))
    marked = pages.withColumn(digest, sha1_base32(body))
    ids = marked.filter(F.octet_length(body) >= least).select(F.col(digest).alias("d"), F.col(key).alias("id"))
    groups = stash(ids.groupBy("d").agg(F.max("id").alias("w"), F.count("*").alias("n")).filter("n > 1").select(F.col("d").alias(digest), F.col("w").alias(winner)), "copies")
    few = groups.count() <= BROADCAST_REVISITS
    joined = marked.join(F.broadcast(groups) if few else groups, digest, "left")
    revisit = F.col(winner).isNotNull() & ~F.col(key).eqNullSafe(F.col(winner)) & (F.octet_length(body) >= least)
    return joined.withColumn(refers_to, F.when(revisit, F.col(winner))).drop(winner), digest, refers_to


def record(key: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A record without its final blank lines. The id is kept in the record id; a null one leaves it bare."""
    body = F.coalesce(payload, F.lit(""))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20")
    head = lambda kind, *more: F.concat(
        F.lit(f"{MAGIC}{VERSIONS[0].decode()}WARC-Type: {kind}\r\nWARC-Record-ID: "), name(key), F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), digest, *more,
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
    )
    full = F.concat(head("response"), F.octet_length(body).cast("string"), F.lit(END), body)
    short = F.concat(head("revisit", F.lit("\r\nWARC-Refers-To: "), name(refers_to)), F.lit(f"0{END}"))
    return F.when(refers_to.isNull(), full).otherwise(short)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> None:
    p, digest, refers_to = plan(pages, key, payload, least)
    p.select(record(F.col(key), F.col(url), F.col(payload), F.col(digest), F.col(refers_to)).alias("value")).write.option("lineSep", END).text(path)


# --- reading -------------------------------------------------------------------------------------------------------


def parse_head(piece: bytes) -> tuple[dict[str, str], int, int] | None:
    """Of the bytes after a record's magic: its fields, the length of its head, and of its content; None if it isn't one."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or piece[:3] not in VERSIONS:
        return None
    fields = {}
    for line in piece[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    n = fields.get("content-length", "")
    if not n.isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4, int(n)


FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to")
PIECE = "file string, block long, rel long, size long, next_rel long, exit_rel long, fields array<string>, sha1 string, n long, whole boolean"


def _pieces(path: str, spark: SparkSession) -> DataFrame:
    """The archives' text between occurrences of the magic, in order inside each split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's place in its split, and where the record that it may begin ends (PIECE); a split's last row has its size."""
    now, at, rows = None, 0, []

    def flush() -> pa.RecordBatch:
        # from the last to the first: a candidate's chain leads to its successor in the split, else past it
        places = {r["rel"]: i for i, r in enumerate(rows)}
        for r in reversed(rows):
            if r["next_rel"] is not None:
                i = places.get(r["next_rel"])
                r["exit_rel"] = r["next_rel"] if r["next_rel"] >= at else (rows[i]["exit_rel"] if i is not None else None)
        rows.append(dict.fromkeys(SCHEMA.names) | {"file": now[0], "block": now[1], "size": at})
        return pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    for b in batches:
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if (file, block) != now:
                if now:
                    yield flush()
                now, at, rows = (file, block), 0, []
            # `at` is where this piece's magic would start, counted from the split's first piece
            r = dict.fromkeys(SCHEMA.names) | {"file": file, "block": block, "rel": at, "size": len(value)}
            if (head := parse_head(value)) is not None:
                fields, skip, n = head
                r["next_rel"] = at + len(MAGIC) + skip + n + len(END)
                r["fields"] = [fields.get(x) for x in FIELDS]
                r["whole"] = skip + n + len(END) == len(value)
                r["n"] = n
                if r["whole"]:
                    r["sha1"] = base64.b32encode(hashlib.sha1(value[skip : skip + n]).digest()).decode()
            rows.append(r)
            at += len(value) + len(MAGIC)
    if now:
        yield flush()


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.strip().split(" ") for x in PIECE.split(", "))])


def boundaries(path: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """All pieces with offsets in their files, and of them the records: those a chain from the file's start reaches."""
    raw = stash(_pieces(path, spark).mapInArrow(_candidates, PIECE), "pieces")
    along = W.partitionBy("file").orderBy("block")  # one row for each split of a file
    base = raw.filter("rel IS NULL").select("file", "block", (F.sum("size").over(along) - F.col("size") - len(MAGIC)).alias("base"))
    # a file's first piece is the empty one before its first magic: offsets count from that magic, at 0
    placed = raw.filter("rel IS NOT NULL").join(base, ["file", "block"]).withColumn("off", F.col("rel") + F.col("base"))
    for c in ("next", "exit"):
        placed = placed.withColumn(f"{c}_off", F.col(f"{c}_rel") + F.col("base"))
    placed = stash(placed, "offsets")
    edges = placed.filter("exit_off IS NOT NULL").select("file", "off", F.col("exit_off").alias("to"))
    entries = edges.select("file", F.col("to").alias("off")).unionByName(edges.select("file", F.lit(0).cast("long").alias("off"))).distinct()
    jump = stash(edges.join(entries, ["file", "off"]), "jumps")  # only places that a chain can enter
    seen = stash(jump.filter("off = 0").select("file", "off"), "reached")
    known = seen.count()
    while True:
        step = seen.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        seen = stash(seen.unionByName(step).distinct(), "reached")
        if (n := seen.count()) == known:
            break
        known = n
        jump = stash(jump.join(jump.toDF("file", "to", "far"), ["file", "to"], "left").select("file", "off", F.coalesce("far", "to").alias("to")), "jumps")
    return placed, seen


def _inside(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """The records: each split's chain from the entry that is reached. A split is entered at one place, if at all."""
    entry = placed.join(entries, ["file", "off"]).groupBy("file", "block").agg(F.min("off").alias("entry"))
    links = placed.filter("next_off IS NOT NULL").select("file", "block", "off", "next_off", "fields", "sha1", "n", "whole").join(entry, ["file", "block"])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, want = None, None
        for b in batches:
            keep = np.zeros(len(b), bool)
            files, parts, offs, nexts, first = (b.column(c).to_pylist() for c in ("file", "block", "off", "next_off", "entry"))
            for i in range(len(b)):
                if (files[i], parts[i]) != now:
                    now, want = (files[i], parts[i]), first[i]
                if offs[i] == want:
                    keep[i] = True
                    want = nexts[i]
            yield b.filter(pa.array(keep))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema)
    return links.repartition("file", "block").sortWithinPartitions("file", "block", "off").mapInArrow(followed, kind)


def read(path: str, spark: SparkSession, payload: bool = False) -> DataFrame:
    """(file, off, record_type, record_id, uri, digest, refers_to, content_bytes, content_digest) of each record, and its payload (binary) if asked for.

    content_bytes and content_digest are of the bytes that were read; payloads take a second read of the archive.
    """
    placed, reached = boundaries(path, spark)
    records = stash(_inside(reached, placed).drop("entry", "block"), "records")
    cut = records.filter("NOT whole")
    rest = records.filter("whole")
    if not cut.isEmpty():
        sha1 = F.arrow_udf(lambda p: pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in map(_content, p)], pa.string()), "string")
        own = _pieces_of(path, spark, placed, cut).select("file", "off", sha1("p").alias("sha1"))
        rest = rest.unionByName(cut.drop("sha1").join(own, ["file", "off"]).select(cut.columns))
    names = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "uri", "warc-payload-digest": "digest", "warc-refers-to": "refers_to"}
    out = rest.select("file", "off", *(F.col("fields")[i].alias(names[x]) for i, x in enumerate(FIELDS)), F.col("n").alias("content_bytes"), F.col("sha1").alias("content_digest"))
    if not payload:
        return out
    content = F.arrow_udf(lambda p: pa.array(map(_content, p), pa.binary()), "binary")
    return out.join(_pieces_of(path, spark, placed, records).select("file", "off", content("p").alias("payload")), ["file", "off"])


def _content(pieces: pa.Scalar) -> bytes:
    piece = MAGIC.encode().join(x["value"].as_py() for x in pieces)
    _, skip, n = parse_head(piece)
    return piece[skip : skip + n]


def _pieces_of(path: str, spark: SparkSession, placed: DataFrame, records: DataFrame) -> DataFrame:
    """(file, off, p): the pieces of each record in order; several where its payload holds the magic."""
    base = placed.select("file", "block", (F.col("off") - F.col("rel")).alias("base")).distinct()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for b in batches:
            rel = []
            for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if (file, block) != now:
                    now, at = (file, block), 0
                rel.append(at)
                at += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rel, pa.int64()), b.column(2).cast(pa.binary())], names=["file", "block", "rel", "value"])

    part = lambda c: F.floor(F.col(c) / PART)
    # records don't overlap, so a part of a file has few of them; a long record has a row for each part that it reaches into
    of = records.select("file", F.col("off").alias("start"), F.col("next_off").alias("stop"))
    of = of.withColumn("part", F.explode(F.sequence(part("start"), part("stop"))))
    files = of.select("file").distinct()
    bytes_at = _pieces(path, spark).mapInArrow(numbered, "file string, block long, rel long, value binary").join(files, "file", "left_semi").join(base, ["file", "block"]).select("file", (F.col("rel") + F.col("base")).alias("off"), "value")
    inside = bytes_at.withColumn("part", part("off")).join(of, ["file", "part"]).filter("start <= off AND off < stop")
    whole = inside.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("p"))

    return whole.select("file", F.col("start").alias("off"), "p")


def op10_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest are those of the bytes read back: a response's own, or for a revisit those of the response with the digest that it names."""
    path = new_path(spark, "archives")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    ident = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    id_of = lambda c: F.when(ident(c) != "", ident(c).cast("long"))
    records = read(path, spark)
    own = records.filter("record_type <> 'revisit'")
    of = own.groupBy("content_digest").agg(F.first("content_bytes").alias("content_bytes"))
    again = records.filter("record_type = 'revisit'").select("record_id", "record_type", "refers_to", F.regexp_replace("digest", "^sha1:", "").alias("content_digest")).join(of, "content_digest")
    return own.select(again.columns).unionByName(again).select(
        id_of(F.col("record_id")).alias("page_id"), F.col("content_bytes").alias("payload_bytes"), F.col("content_digest").alias("payload_digest"), "record_type", id_of(F.col("refers_to")).alias("refers_to")
    )


_B32 = "translate(concat(" + ", ".join(f"to_base(CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT), 32, 4)" for i in range(8)) + "), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
SQL = {
    "op10_warc_roundtrip": f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to FROM w"""
}
