"""Places in file contents: bytes, 1-based lines and byte columns, half-open spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes_as_text(content: Column) -> Column:
    """A character for each byte."""
    return F.decode(content, "ISO-8859-1")


def line_column(content: Column, offset: Column) -> Column:
    """struct(line, column) of a byte offset; null outside the content. content: binary."""
    before = _bytes_as_text(F.substr(content, F.lit(1), offset.cast("int")))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
    last = F.instr(F.reverse(before), "\n")
    column = F.when(last == 0, F.length(before) + 1).otherwise(last)
    return F.when((offset >= 0) & (offset <= F.octet_length(content)), F.struct(line.cast("long").alias("line"), column.cast("long").alias("column")))


def span_bytes(content: Column, begin: Column, end: Column) -> Column:
    """The bytes of a span; null where it isn't inside the content."""
    return F.when((begin >= 0) & (begin <= end) & (end <= F.octet_length(content)), F.substr(content, (begin + 1).cast("int"), (end - begin).cast("int")))


def snippet(content: Column, recorded: Column, begin: Column, end: Column) -> Column:
    """struct(text, problem): a span's bytes if the file is still the one recorded (a SHA-256), else why not."""
    inside = span_bytes(content, begin, end)
    problem = F.when(F.sha2(content, 256) != recorded, "source_changed").when(inside.isNull(), "span_out_of_range")
    return F.struct(F.when(problem.isNull(), inside).alias("text"), problem.alias("problem"))
