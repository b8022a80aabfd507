"""The driver tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators import edits as E
from taskloom.operators import scan as S
from taskloom.operators import segment as G
from taskloom.plans.registry import spread, table


def cohort(ident: str):
    """Cohort by parity."""
    return F.when(F.pmod(F.col(ident), F.lit(2)) == 0, "a").otherwise("b").alias("cohort")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "lineitem"), "l_orderkey")


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Message log: one conversation is one session, the turn is the message index."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("msg_index"),
        F.col("role").alias("type"), F.col("text").alias("user_text"), F.lit(False).alias("is_tool_result"),
        cohort("conv_id"))


def conversation_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return G.task_starts(G.mark_tasks(conversation_messages(spark, folder)))


def event_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls: the user is the session, a user-day is the task, the event type is the tool."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("date").cast("string").alias("day"),
        F.col("event_type").alias("name"), F.col("event_id"), S.epoch_seconds("ts").alias("at_s"),
        "value", F.get_json_object("props", "$.k").cast("long").alias("k"), cohort("user_id"))


def day_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions as time ranges: first and last event of a user-day."""
    return event_calls(spark, folder).groupBy("cohort", "session_id", "day").agg(
        F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"), F.count(F.lit(1)).alias("calls"),
        F.sum("value").alias("estimated_cost")
    ).withColumn("session_id", F.concat_ws("/", F.col("session_id").cast("string"), "day"))


def block_tasks(spark: SparkSession, folder: str, hours: int = 4) -> DataFrame:
    """Tasks inside a user-day: blocks of a few hours."""
    return event_calls(spark, folder).withColumn(
        "block", F.floor(F.col("at_s") / (hours * 3600))
    ).groupBy("cohort", F.concat_ws("/", F.col("session_id").cast("string"), "day").alias("session_id"), "block").agg(
        F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"), F.sum("value").alias("estimated_cost")
    ).withColumn("duration_seconds", F.col("end_s") - F.col("start_s"))


def document_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits: a source is a session with one file per language; every document is an edit that leaves its
    own text behind. It replaces the text of the document before it in the file (with its own behind it, for
    every third document). Every 13th writes the file anew, every 11th replaces all places. Texts are whole.
    The rows keep the pieces of the scan that finds the text before, for the scans of the lineage."""
    docs = table(spark, folder, "documents").select(
        F.col("source").alias("session_id"), F.col("lang").alias("file_path"), F.col("doc_id").alias("msg_index"), "text")
    # the file is read from the key, so whatever is asked of the edits, the documents are sent in the same form and once
    cut = S.pieces(docs, E.FILE, S.index_chunk("msg_index", E.BLOCK)).drop(*E.FILE)
    before = S.along(cut, ["msg_index"], before=S.latest_before(F.col("text"))).select("*", "_key.*")
    ident, previous = F.col("msg_index"), F.coalesce("before", F.lit(""))
    write = ident % 13 == 0
    old = F.when(write, "").when((ident % 3 == 0) & (previous != ""), F.concat(previous, F.lit("\n"), "text")).otherwise(previous)
    return before.select(
        *S.PIECE, *E.FILE, F.concat_ws("-", "session_id", F.floor(ident / 200).cast("string")).alias("task_id"),
        "msg_index", F.lit(0).alias("pos"), F.when(write, "Write").otherwise("Edit").alias("tool_name"),
        old.alias("old_string"), F.col("text").alias("new_string"), (~write & (ident % 11 == 0)).alias("replace_all"))


def conversation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A session log as ``sources.logs.read_lines`` gives it: JSON lines with list content, tool calls, tool results and usage.

    Every turn of a conversation is a message of the log. A user turn is a plain
    string, a list with a bare string, or the result of the call before it; an
    assistant turn answers with a text and a call; a system turn marks a
    compaction and is followed by a blank and by a broken line.
    """
    text, conv, turn = F.coalesce("text", F.lit("")), F.col("conv_id"), F.col("turn")
    ident = F.concat_ws("-", conv.cast("string"), turn.cast("string"))
    def block(**fields):
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    def message(kind: str, blocks, **fields):
        return F.concat(F.lit('{"type":"' + kind + '","message":{"content":['), F.array_join(F.array(*blocks), ","), F.lit("]"),
                        *[F.concat(F.lit(f',"{k}":'), v) for k, v in fields.items() if k != "rest"], F.lit("}"), fields.get("rest", F.lit("")), F.lit("}"))
    said = block(type=F.lit("text"), text=text)
    user = (conv + F.floor(turn / 2)) % 3
    result = block(type=F.lit("tool_result"), tool_use_id=F.concat_ws("-", conv.cast("string"), (turn - 1).cast("string")),
                   is_error=conv % 2 == 0, content=F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))))
    asked = (F.when(user == 0, F.to_json(F.struct(F.lit("user").alias("type"), F.struct(text.alias("content")).alias("message"))))
             .when(user == 1, message("user", [said, F.lit('"and more"')])).otherwise(message("user", [result])))
    def call(name: str, **given):
        return block(type=F.lit("tool_use"), id=ident, name=F.lit(name), input=F.struct(*[v.alias(k) for k, v in given.items()]))
    which = (conv + turn) % 3
    made = (F.when(which == 0, call("Edit", file_path=F.concat(F.lit("f"), turn.cast("string")), old_string=text,
                                    new_string=F.concat(text, F.lit("\n"), text), replace_all=conv % 5 == 0))
            .when(which == 1, call("Bash", command=text, run_in_background=conv % 2 == 0)).otherwise(call("Grep", pattern=text, path=F.lit("src"))))
    usage = F.to_json(F.struct(F.length(text).alias("input_tokens"), (turn * 2).alias("output_tokens"), conv.alias("cache_read_input_tokens"),
                               F.lit(7).alias("cache_creation_input_tokens")))
    request = F.concat(F.lit(',"requestId":"'), conv.cast("string"), F.lit("-"), F.floor(turn / 4).cast("string"), F.lit('"'))
    marker = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), F.struct(
        F.lit("auto").alias("trigger"), F.length(text).alias("preTokens")).alias("compactMetadata")))
    value = (F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", message("assistant", [said, made], usage=usage, rest=request))
             .otherwise(marker))
    more = F.when(F.col("role") == "system", F.array(F.lit(""), F.lit('{"type": "user", "broken'))).otherwise(F.array().cast("array<string>"))
    lines = table(spark, folder, "conversations").select(conv, turn, F.posexplode(F.concat(F.array(value), more)).alias("at", "value"))
    return lines.select(
        "value", F.concat(F.lit("p/"), conv.cast("string"), F.lit(".jsonl")).alias("file_path"), F.floor(turn / 1024).alias("block"),
        (turn * 3 + F.col("at")).alias("line"), conv.cast("string").alias("session_id"), F.lit("p").alias("project_path"))
