"""Quotation linking with DataFrame functions only.

The lines of a message carry a quote level: the number of `>` in front. Neighbouring lines of
one level without a blank line between them are a passage. Passages are normalised (ASCII
lower case, runs of white space as one blank) and hashed; a quoted passage is linked to the
first message of its conversation that has it as own text, if that is an earlier turn. Hash
and text are both compared. A message replies to the latest of the origins of its shallowest
linked quotes. Its own passages, without quotes, are its body; conversations are read by
thread (root, depth, turn).

Originals are one row per conversation and passage before they are joined, and threads are
followed by pointer doubling, so no conversation meets in one task.

Defined cases: a null text is empty; messages with null conv_id or turn keep their body and
have no links; rows that repeat conv_id and turn are separate messages that link to the same
origins; of several origins at one turn none is preferred, reply_to is the turn; an empty table
gives an empty result; texts of any length are read whole; a quote of only a part of a passage, or of
several passages run together, is no link; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paideon.llm.common import whole_text
from paideon.llm.decontaminate import UPPER
from paideon.session import stage

_MARKS = r"^((?:[ \t]*>)+)"
ROUNDS = 64  # doublings: more than any chain of turns needs


def passages(messages: DataFrame) -> DataFrame:
    """msg_no, conv_id, turn, level, place, body (lines as written), norm of every passage."""
    lines = messages.select("msg_no", "conv_id", "turn", F.posexplode(F.split(whole_text(), r"\r\n|\n|\r")).alias("line_no", "line"))
    marks = F.regexp_extract("line", _MARKS, 1)
    read = lines.select(
        "msg_no", "conv_id", "turn", "line_no", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        F.regexp_replace("line", _MARKS + "[ \t]?", "").alias("content"))
    tidy = F.trim(F.regexp_replace(F.translate("content", UPPER, UPPER.lower()), r"[\x20\x09-\x0D]+", " "))
    read = read.withColumn("norm", tidy)
    order = Window.partitionBy("msg_no").orderBy("line_no")
    # A line opens a passage unless the line before it has its level and both have words.
    goes_on = (F.lag("level").over(order) == F.col("level")) & (F.lag("norm").over(order) != "") & (F.col("norm") != "")
    numbered = read.withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn(
        "place", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "content", "norm")))
    grouped = numbered.filter("norm <> ''").groupBy("msg_no", "conv_id", "turn", "level", "place").agg(parts.alias("parts"))
    return grouped.select(
        "msg_no", "conv_id", "turn", "level", "place", F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("body"),
        F.array_join(F.transform("parts", lambda p: p["norm"]), " ").alias("norm"))


def links(listed: DataFrame) -> DataFrame:
    """msg_no, conv_id, turn, level, place, origin (turn) of every linked quoted passage."""
    keyed = listed.filter("conv_id is not null and turn is not null").withColumn("key", F.xxhash64("norm"))
    originals = keyed.filter("level = 0").groupBy("conv_id", "key", "norm").agg(F.min("turn").alias("origin"))
    return (keyed.filter("level > 0").join(originals, ["conv_id", "key", "norm"]).filter("origin < turn")
            .select("msg_no", "conv_id", "turn", "level", "place", "origin"))


def _threads(messages: DataFrame, parents: DataFrame) -> DataFrame:
    """conv_id, turn, thread_root, depth of every turn that replies to another."""
    # A turn may be held by several rows: its latest parent stands for it.
    up = stage(parents.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up")).withColumn("depth", F.lit(1).cast("long")), "parents")
    for _ in range(ROUNDS):
        above = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        if up.join(above, ["conv_id", "up"], "left_semi").isEmpty():
            break
        moved = up.join(above, ["conv_id", "up"], "left")
        up = stage(moved.select("conv_id", "turn", F.coalesce("next", "up").alias("up"),
                                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "parents")
    return up.select("conv_id", "turn", F.col("up").alias("thread_root"), "depth")


def reply_threads(conversations: DataFrame) -> DataFrame:
    """One row per message: body without quotes, reply_to, thread_root, depth, n_quotes, n_linked."""
    messages = stage(conversations.select("conv_id", "turn", "role", F.col("text")).withColumn(
        "msg_no", F.monotonically_increasing_id()), "messages")
    listed = stage(passages(messages), "passages")
    linked = stage(links(listed), "quote-links")
    body = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("place", "body"))))
    of_message = listed.groupBy("msg_no").agg(
        F.array_join(F.transform(body, lambda p: p["body"]), "\n\n").alias("body"),
        F.count_if(F.col("level") > 0).alias("n_quotes"))
    nearest = linked.groupBy("msg_no", "conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("near"), "origin"))["origin"].alias("reply_to"), F.count(F.lit(1)).alias("n_linked"))
    nearest = stage(nearest, "replies")
    threads = _threads(messages, nearest)
    joined = (messages.join(of_message, "msg_no", "left").join(nearest.select("msg_no", "reply_to", "n_linked"), "msg_no", "left")
              .join(threads, ["conv_id", "turn"], "left"))
    return joined.select(
        "conv_id", "turn", "role", F.coalesce("body", F.lit("")).alias("body"), "reply_to",
        F.coalesce("thread_root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def in_reply_order(threads: DataFrame) -> DataFrame:
    """Conversations as they are read, for a writer of chat records."""
    return threads.orderBy("conv_id", "thread_root", "depth", "turn")
