"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs, sorted, and neighbours of one role are
merged into a block. The template is

    ### role: text<next>text</turn>

with one line break after each block; ``<next>`` marks where turns were merged. Inside texts and
roles the signs that begin control strings are written as a backslash and a digit, so a text
never holds a control string and everything can be read back. The loss mask is a list of spans
(start, length in code points of the formatted text) that cover the escaped assistant texts.

A formatted conversation is one string, so one conversation has to fit into one row (2 GB), as
the template and the digest over all turns demand; conversations are spread over tasks.

Edge cases: null texts and roles are empty, rows with a null ``conv_id`` form one conversation,
turns are ordered by (turn, role, text) with nulls first, repeated rows are repeated turns, and
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillspark.llm.common import table

OPEN, CLOSE, NEXT, AFTER_ROLE = "### ", "</turn>\n", "<next>", ": "
LOSS_ROLE = "assistant"
# A control string begins with one of these signs; the backslash has to go first.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("#", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"))


def escaped(text: Column, escapes=ESCAPES) -> Column:
    for sign, code in escapes:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for sign, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, length>>) from (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    safe = sorted_turns.select("conv_id", F.transform("t", lambda x: F.struct(
        escaped(x["role"], ROLE_ESCAPES).alias("role"), escaped(x["text"]).alias("text"),
        (x["role"] == LOSS_ROLE).alias("loss"))).alias("t"))

    def begins(i: Column) -> Column:
        return (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"])

    places = F.sequence(F.lit(0), F.size("t") - 1)
    cut = safe.withColumn("starts", F.filter(places, begins))
    block = F.transform("starts", lambda s, k: F.struct(
        F.get("t", s)["role"].alias("role"),
        F.slice("t", s + 1, F.coalesce(F.get("starts", k + 1), F.size("t")) - s).alias("turns")))
    merged = cut.withColumn("blocks", block)
    text = F.array_join(F.transform("blocks", lambda b: F.concat(
        _head(b["role"]), F.array_join(F.transform(b["turns"], lambda x: x["text"]), NEXT),
        F.lit(CLOSE))), "")
    # Spans: one walk over the turns with the place reached so far.
    nothing = F.struct(F.lit(0).alias("at"), F.expr(
        "cast(array() as array<struct<start: int, length: int>>)").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        x = F.get("t", i)
        before = F.when(begins(i), F.when(i == 0, 0).otherwise(len(CLOSE))
                        + F.length(_head(x["role"]))).otherwise(len(NEXT))
        start = (acc["at"] + before).cast("int")
        span = F.struct(start.alias("start"), F.length(x["text"]).alias("length"))
        return F.struct(
            (start + F.length(x["text"])).alias("at"),
            F.when(x["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"])
            .alias("spans"))

    return merged.select("conv_id", text.alias("formatted"),
                         F.aggregate(places, nothing, step)["spans"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the original turns of a formatted conversation."""
    blocks = F.transform(
        F.slice(F.split(formatted, "</turn>\n"), 1,
                F.size(F.split(formatted, "</turn>\n")) - 1),
        lambda b: F.struct(
            F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), AFTER_ROLE, 1).alias("role"),
            b.alias("block")))
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substr(b["block"], F.lit(len(OPEN + AFTER_ROLE) + 1) + F.length(b["role"])),
                NEXT),
        lambda x: F.struct(unescaped(b["role"], ROLE_ESCAPES).alias("role"),
                           unescaped(x).alias("text")))))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, with its escapes undone."""
    return F.array_join(F.transform(loss, lambda s: unescaped(
        F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    read = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                            masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(
        x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# A conversation whose texts look like the template itself.
TRAP_ID, TRAP_TEXT = -7, "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(TRAP_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP_TEXT).alias("text"))
    return digests(format_conversations(turns.unionByName(trap)))


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS written,
    length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS named
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
    ORDER BY turn, role, text), '')) AS loss_sha256,
  cast(sum(written + CASE WHEN before IS NULL OR before <> role THEN named + 14 ELSE 6 END)
    AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
