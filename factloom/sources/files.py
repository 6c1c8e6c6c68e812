"""What is on disk: file hashes against a recorded list, and which recorded paths are gone."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read and hashed at a time, and files that a task takes at a time.
CHUNK, FILES = 1 << 20, 200
SEEN = "path string, size long, hash string, state string"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files under a root, relative to it; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = root.rstrip("/").rpartition("://")[2].removeprefix("file:") + "/"
    return found.select(F.substring_index("path", place, -1).alias("path"), F.col("length").alias("size"))


def hash_file(files: pafs.FileSystem, path: str, until: float | None = None) -> tuple[int | None, str | None, str]:
    """(size, SHA-256, state: present, absent, unreadable or late), a chunk at a time, so that memory doesn't grow with the file."""
    if until is not None and time.time() >= until:
        return None, None, "late"
    try:
        if files.get_file_info(path).type != pafs.FileType.File:
            return None, None, "absent"
        digest, size = hashlib.sha256(), 0
        with files.open_input_stream(path, buffer_size=0) as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
                size += len(chunk)
                if until is not None and time.time() >= until:
                    return None, None, "late"
    except OSError:
        return None, None, "unreadable"
    return size, digest.hexdigest(), "present"


def hashes(paths: DataFrame, root: str, seconds: float | None = None) -> DataFrame:
    """(path, size, hash, state) of files by their paths relative to a root that all executors see (a folder or a URI).

    paths: a column path, each once. seconds: from now on until files are given up; what isn't hashed by then is late.
    Files are dealt FILES to a task and read by chunks, so neither a large file nor many files are held by one.
    """
    until = None if seconds is None else time.time() + seconds
    own = paths.select("path")
    tasks = max(1, -(-own.count() // FILES))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, files = root.rstrip("/"), None
        for b in batches:
            if files is None:
                files, base = pafs.FileSystem.from_uri(base) if "://" in base else (pafs.LocalFileSystem(), os.path.abspath(base.removeprefix("file:")))
            rows = [(p, *(hash_file(files, f"{base}/{p}", until) if p else (None, None, "absent"))) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "size", "hash", "state"])

    return own.repartition(tasks, "path").mapInArrow(hashed, SEEN)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, hash) of all files under a root, relative to it."""
    return hashes(listed(spark, root), root).filter("state = 'present'").select("path", "size", "hash")


def probe(recorded: DataFrame, seen: DataFrame) -> DataFrame:
    """recorded (path, ...) with current: the hash that a file has now; null for one that is absent or unreadable."""
    return recorded.join(seen.select("path", F.col("hash").alias("current")), "path", "left")


def missing(recorded: DataFrame, seen: DataFrame) -> DataFrame:
    """Recorded paths without a file."""
    return recorded.select("path").join(seen.select("path"), "path", "left_anti").distinct()


def withheld(excluded: DataFrame, recorded: DataFrame, seen: DataFrame) -> DataFrame:
    """Explicit exclusions and what is gone from disk."""
    return excluded.select("path").unionByName(missing(recorded, seen)).distinct()
