"""Chat formatting over typed content parts, in DataFrame functions only.

A turn's content is an array of parts: struct(kind, text, ref, units). The visitor, one branch for each kind, flattens
a turn into the template's text: text parts are escaped, image, audio and document parts become placeholders numbered
by kind in order of appearance in the conversation, their references are recorded in that order, and each stands for
as many tokens as its units expand to. The template is

    <|turn|>role<|body|>content<|end|>      for each turn,

and the loss mask holds the content of assistant turns. Control strings all begin with '<' or '['; in roles and texts
the escape character and those two are written ~e ~l ~o, so no control string survives inside a text, and reading the
three back (in the order ~o ~l ~e) restores it exactly.

Defined cases: null text is empty, a null role is the empty role, a null turn sorts first; a null conversation id is a
conversation; repeated rows are turns of their own, ties in turn are ordered by role and text; parts of an unknown kind
or null kind are text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens that a unit of each kind expands to: an image tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 576, "audio": 50, "document": 1500}
PART = "struct<kind:string,text:string,ref:string,units:int>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~e")), F.lit("<"), F.lit("~l")), F.lit("["), F.lit("~o"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~o"), F.lit("[")), F.lit("~l"), F.lit("<")), F.lit("~e"), F.lit("~"))


def text_part(text: Column) -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("units")))


def visit(parts: Column) -> Column:
    """struct(text, refs, tokens) of a conversation's parts, each with its turn's opening or closing around it.

    parts: array of struct(open, kind, text, ref, units, close). One pass counts parts of each kind as it goes.
    """
    kinds = list(UNIT_TOKENS)
    start = F.struct(
        F.array().cast("array<string>").alias("text"), F.array().cast("array<struct<kind:string,ref:string>>").alias("refs"), F.lit(0).cast("long").alias("tokens"), *(F.lit(0).alias(k) for k in kinds)
    )

    def step(s: Column, p: Column) -> Column:
        shown, tokens, held = escape(F.coalesce(p["text"], F.lit(""))), F.lit(0).cast("long"), F.lit(False)
        for k in kinds:
            here = F.coalesce(p["kind"] == k, F.lit(False))
            held = held | here
            shown = F.when(here, F.concat(F.lit(f"<|{k}_"), s[k].cast("string"), F.lit("|>"))).otherwise(shown)
            tokens = F.when(here, F.coalesce(p["units"], F.lit(1)).cast("long") * UNIT_TOKENS[k]).otherwise(tokens)
        return F.struct(
            F.concat(s["text"], F.array(F.concat(p["open"], shown, p["close"]))).alias("text"),
            F.when(held, F.concat(s["refs"], F.array(F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"))))).otherwise(s["refs"]).alias("refs"),
            (s["tokens"] + tokens).alias("tokens"),
            *((s[k] + F.coalesce(p["kind"] == k, F.lit(False)).cast("int")).alias(k) for k in kinds),
        )

    return F.aggregate(parts, start, step, lambda s: F.struct(F.array_join(s["text"], "").alias("text"), s["refs"].alias("refs"), s["tokens"].alias("tokens")))


def _steps(turns: Column) -> Column:
    """Parts in order, the first and last of a turn with the template's marks; a turn without parts has one empty part."""

    def of(t: Column) -> Column:
        empty = F.array(F.struct(F.lit("text").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))
        parts = F.when(F.coalesce(F.size(t["parts"]), F.lit(0)) > 0, t["parts"]).otherwise(empty)
        opening = F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
        return F.transform(
            parts,
            lambda p, i: F.struct(
                F.when(i == 0, opening).otherwise("").alias("open"), p["kind"].alias("kind"), p["text"].alias("text"), p["ref"].alias("ref"), p["units"].alias("units"),
                F.when(i == F.size(parts) - 1, F.lit(END)).otherwise("").alias("close"),
            ),
        )

    return F.flatten(F.transform(turns, of))


def chat_format(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv_id, formatted, attachments, attachment_tokens): one row for each conversation.

    turns: a row for each turn, its parts an array of PART.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts"))
    gathered = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    shown = gathered.select("conv_id", visit(_steps(F.col("turns"))).alias("v"))
    return shown.select("conv_id", F.col("v.text").alias("formatted"), F.col("v.refs").alias("attachments"), F.col("v.tokens").alias("attachment_tokens"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped; placeholders stay as they are."""
    marked = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    halves = F.transform(marked, lambda x: F.split(F.substring(x, len(TURN) + 1, 2**31 - 1), r"<\|body\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(F.get(h, F.lit(1))).alias("text")))


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """The loss mask: array of struct(b, e), half-open ranges in code points of what assistant turns hold."""
    marked = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    opening = TURN + role + BODY
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:int,e:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        n = F.length(x)
        span = F.array(F.struct((s["at"] + len(opening)).alias("b"), (s["at"] + n).alias("e")))
        return F.struct((s["at"] + n + len(END)).alias("at"), F.when(x.startswith(opening), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(marked, start, step, lambda s: s["spans"])


def masked_text(formatted: Column, spans: Column) -> Column:
    """What stands under the mask, unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["b"] + 1, s["e"] - s["b"]))), "")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    shown = chat_format(own.unionByName(more).withColumn("parts", text_part(F.col("text"))))
    read = shown.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), loss_spans(F.col("formatted"))).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = {
    "op7_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + {len(TURN + BODY + END)} + len(regexp_extract_all(role || text, '[~<\\[]')) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""
}
