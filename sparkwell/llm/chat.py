"""Conversations as one marked-up string each, with a loss mask, by Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the template.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What may follow a bracket in a control string: the template's own and other common ones, all of which are escaped in texts.
TAILS = r"(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>)"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """One more backslash after the bracket of everything that is a control string but for backslashes there."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={TAILS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    """Takes that backslash out again."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={TAILS})", "$1$2")


def format_conversations(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, formatted, mask) for every conversation.

    Turns are collected as structs, sorted by turn (ties by role, then text; a null turn first) and joined: a
    change of role closes the message before and opens one, and adjacent turns of one role stay in one message, a
    separator between them. ``mask`` lists for each turn how many characters come before its text, how long
    the text is there, and whether it is learned, which the assistant's are. Null roles and texts are empty
    strings; repeated rows are repeated turns; a null conv_id is a conversation of its own; other columns are ignored. A conversation is one
    string, so its turns meet in one row, and texts and conversations may be as long as a string can be. No rows give none.
    """
    rows = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"])
        head = F.concat(F.when(i > 0, F.lit(END)).otherwise(""), F.lit(START), escape(t["role"]), F.lit(SEPARATOR))
        return F.struct(F.when(opens, head).otherwise(SEPARATOR).alias("lead"), escape(t["text"]).alias("body"), (t["role"] == LEARNED_ROLE).alias("learned"))

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END))
    mask = F.transform("pieces", lambda p: F.struct(F.length(p["lead"]).alias("skip"), F.length(p["body"]).alias("length"), p["learned"].alias("learned")))
    return pieces.select("conv_id", formatted.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame, *kept: str) -> DataFrame:
    """(conv_id, formatted, turns: array of (role, text, body: the text as it stands there)), parsed from the formatted strings alone; ``kept`` columns follow."""
    messages = F.split("formatted", F.lit(r"<\|im_end\|>\n"), -1)
    messages = F.slice(messages, F.lit(1), F.size(messages) - 1)

    def turns_of(message: Column) -> Column:
        parts = F.split(F.substring(message, len(START) + 1, F.length(message)), F.lit(r"<\|im_sep\|>"), -1)
        one = F.transform(
            F.array(parts), lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 1), lambda x: F.struct(unescape(p[0]).alias("role"), unescape(x).alias("text"), x.alias("body")))
        )
        return one[0]

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(messages, turns_of)).alias("turns"), *kept)


def under_mask(turns: Column, mask: Column) -> Column:
    """Array of the texts under the mask: those of the turns read back (role, text, body) whose places the mask marks as learned.

    A turn's place is what comes before it in the string, so the mask fits if it has as many places as there are turns and each says as many
    characters as that turn's text has there; a mask that does not fit is an error. No position is looked up in the string anew for each turn.
    """
    both = F.arrays_zip(turns.alias("turn"), mask.alias("place"))
    fits = F.forall(both, lambda x: F.coalesce(F.length(x["turn"]["body"]) == x["place"]["length"], F.lit(False)))
    texts = F.transform(F.filter(both, lambda x: x["place"]["learned"]), lambda x: x["turn"]["text"])
    return F.when(fits, texts).otherwise(F.raise_error(F.lit("the loss mask does not fit the formatted text")).cast("array<string>"))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds in it, one row for each conversation: its turns by the marks, what is learned by the mask."""
    read = read_back(formatted, "mask").withColumn("learned", F.array_join(under_mask(F.col("turns"), F.col("mask")), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``digests`` of all ``conversations``, and of one more whose texts hold control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.sql("SELECT CAST(id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM VALUES (-1, 0, 'user', :t), (-1, 1, 'assistant', :t) AS v(id, turn, role, text)", {"t": tricky})
    return digests(format_conversations(turns.unionByName(own)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS>)')) AS escaped
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN before IS DISTINCT FROM role THEN 12 + length(role) + 10 + 11 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
