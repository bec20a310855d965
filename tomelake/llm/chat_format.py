r"""Chat formatting: event-sourced reconstruction of conversations, rendered with a reversible template.

A log is a table of events (conv_id, seq, message_id, kind, role, text): `message` starts a message with its text,
`delta` appends streamed text, `edit` replaces the text so far, `regenerate` empties it and starts anew, `delete` removes
the message. `fold_events` partitions the log by conversation, orders it by seq, and folds each message's events after
its last reset. `render` lays the messages out as

    ### role: text</turn>\n

`\`, `#`, `</turn>` and (in a role) `:` and newline are escaped, so no text can look like a mark, and `parse` reads
roles and texts back exactly. The loss mask is an array of (start, length) in code points over the escaped texts of
assistant messages.

Edge cases: null text, role or delta counts as empty; a delta or edit for a message that was never started starts it; a
message takes the place and role of its first event; ties of seq are ordered by message_id, kind, role and text; rows
that repeat are messages of their own in `events_of_turns`; a conversation all of whose messages are deleted has no row in `render`; an empty log gives an empty result; extra columns are
ignored. A conversation is one output string, so it must fit into one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: The template's marks.
HEAD, SEPARATOR, TAIL = "### ", ": ", "</turn>\n"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("#"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\l/turn>"))
    return F.replace(F.replace(out, F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column) -> Column:
    """Pairs of backslashes are split off first, so each single one that is left begins an escape."""

    def plain(x: Column) -> Column:
        for a, b in (("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\n", "\n")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    return F.when(F.instr(text, "\\") == 0, text).otherwise(F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log: each row is one whole message, in the order of turn, role, text."""
    at = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", "turn", "role", "text", F.row_number().over(at).cast("long").alias("seq")).select(
        "conv_id", "seq", F.col("seq").alias("message_id"), F.lit("message").alias("kind"), "role", "text"
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, position (from 1), role, text. One shuffle, by conversation."""
    order = ["seq", "message_id", "kind", "role", "text"]
    within = W.partitionBy("conv_id").orderBy(*order)
    reset = F.col("kind").isin(*RESETS)
    log = events.select("conv_id", *order).withColumn("_n", F.row_number().over(within))
    whole = W.partitionBy("conv_id", "message_id")
    log = log.withColumn("_from", F.coalesce(F.max(F.when(reset, F.col("_n"))).over(whole), F.lit(0)))
    log = log.withColumn("_gone", F.coalesce(F.max(F.when(F.col("kind") == "delete", F.col("_n"))).over(whole), F.lit(-1)))
    live = F.col("_n") >= F.col("_from")
    messages = log.groupBy("conv_id", "message_id").agg(
        F.min("_n").alias("_first"),
        F.min_by(F.coalesce("role", F.lit("")), "_n").alias("role"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(live & (F.col("kind") != "delete"), F.struct("_n", F.coalesce("text", F.lit("")).alias("text"))))), lambda x: x["text"]
            ),
            "",
        ).alias("text"),
        (F.max("_gone") >= F.max("_from")).alias("_dropped"),
    )
    at = W.partitionBy("conv_id").orderBy("_first")
    return messages.filter("not _dropped").select("conv_id", F.row_number().over(at).cast("long").alias("position"), "role", "text")


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans array<struct<start, length>> (code points, from 0)."""
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(SEPARATOR))
    parts = messages.select("conv_id", "position", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + F.lit(len(TAIL))
    before = F.sum(size).over(W.partitionBy("conv_id").orderBy("position")) - F.char_length("body") - F.lit(len(TAIL))
    parts = parts.withColumn("start", before.cast("long"))
    piece = F.struct("position", F.concat("head", "body", F.lit(TAIL)).alias("piece"))
    span = F.when(F.col("role") == learn_role, F.struct("start", F.char_length("body").cast("long").alias("length")))
    return parts.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns in a formatted conversation: array<struct<role, text>>."""
    pieces = F.split(formatted, TAIL.replace("\n", r"\n"))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, SEPARATOR)
        role = F.substring(piece, len(HEAD) + 1, at - len(HEAD) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, at + len(SEPARATOR), F.char_length(piece))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_chats(turns: DataFrame) -> DataFrame:
    return render(fold_events(events_of_turns(turns)))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = format_chats(turns).withColumn("turns", parse(F.col("formatted"))).withColumn("learnt", masked_text(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(replace(replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '</turn>', '\l/turn>'), ':', '\c'), chr(10), '\n'))
              + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '</turn>', '\l/turn>')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
