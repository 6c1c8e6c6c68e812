"""Compile databases and response files as DataFrames, with a diagnostic for each entry that can't be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import argv


def read(spark: SparkSession, path: str, rules: str = "gnu") -> DataFrame:
    """(database, index, directory, file, arguments, output, command_id, problem): an entry a row; problem is null where it is usable.

    A database that isn't a JSON array is one row with a problem. A leading byte order mark is dropped.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("database"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    listed = raw.withColumn("entries", F.when(F.col("text").rlike(r"^\s*\["), F.from_json("text", "array<string>")))
    each = listed.select("database", F.posexplode_outer(F.coalesce("entries", F.array(F.lit(None).cast("string")))).alias("index", "entry"), F.col("entries").isNull().alias("no_array"))
    get = lambda f: F.get_json_object("entry", f"$.{f}")
    listed_args = F.from_json(get("arguments"), "array<string>")
    strings = get("arguments").rlike(r'^\s*\[\s*("(\\.|[^"\\])*"\s*(,\s*"(\\.|[^"\\])*"\s*)*)?\]\s*$')
    is_object = F.coalesce(F.col("entry").rlike(r"^\s*\{"), F.lit(False))
    problem = (
        F.when(F.col("no_array"), "the database is not an array")
        .when(~is_object, "not an object")
        .when(F.coalesce(get("directory"), F.lit("")) == "", "no directory")
        .when(F.coalesce(get("file"), F.lit("")) == "", "no file")
        .when(get("arguments").isNull() & get("command").isNull(), "neither arguments nor command")
        .when(get("arguments").isNotNull() & ~F.coalesce(strings, F.lit(False)), "arguments are not an array of strings")
    )
    split = argv.tokenize(get("command"), rules)
    rows = each.select("database", "index", get("directory").alias("directory"), get("file").alias("file"), F.coalesce(listed_args, split["args"]).alias("arguments"), get("output").alias("output"), problem.alias("problem"))
    return rows.withColumn("command_id", F.when(F.col("problem").isNull(), argv.command_id(F.col("directory"), F.col("file"), F.col("arguments"), F.col("output"))))


def select_commands(commands: DataFrame) -> DataFrame:
    """(file, selection, n_commands) over usable entries: repeats of one command don't make a file ambiguous."""
    n = F.count_distinct("command_id")
    return commands.filter("problem IS NULL").groupBy("file").agg(F.when(n == 1, "unique").otherwise("ambiguous").alias("selection"), n.alias("n_commands"))


def decode_response(content: Column) -> Column:
    """struct(encoding, text, problem) of a response file's bytes: ASCII without a mark, UTF-8 and UTF-16LE with theirs, nothing else."""
    head = F.hex(F.substring(content, 1, 4))
    digits = F.hex(content)
    ascii_only = ~digits.rlike("^(..)*[89A-F]")
    nul = digits.rlike("^(..)*00")
    body8 = F.substring(content, 4, 2**31 - 1)
    valid8 = F.is_valid_utf8(body8.cast("string"))
    body16 = F.substring(content, 3, 2**31 - 1)
    encoding = F.when(head.startswith("EFBBBF"), "utf8_bom").when(head.startswith("FFFE") & (head != "FFFE0000"), "utf16le_bom").when(~head.rlike("^(FEFF|0000FEFF|FFFE0000)"), "ascii")
    problem = (
        F.when(encoding.isNull(), "the encoding is not supported")
        .when((encoding == "utf8_bom") & ~valid8, "malformed UTF-8")
        .when((encoding == "utf16le_bom") & (F.octet_length(content) % 2 == 1), "an odd number of bytes")
        .when((encoding == "ascii") & nul, "a NUL byte inside the text")
        .when((encoding == "ascii") & ~ascii_only, "non-ASCII byte without a byte order mark")
    )
    text = F.when(encoding == "utf8_bom", body8.cast("string")).when(encoding == "utf16le_bom", F.decode(body16, "UTF-16LE")).otherwise(content.cast("string"))
    return F.struct(encoding.alias("encoding"), F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


def read_responses(spark: SparkSession, path: str, rules: str = "gnu") -> DataFrame:
    """(path, encoding, args, problem) of response files."""
    r = spark.read.format("binaryFile").load(path).select("path", decode_response(F.col("content")).alias("r"))
    return r.select("path", "r.encoding", F.col("r.problem").alias("problem"), argv.tokenize(F.col("r.text"), rules)["args"].alias("args"))
