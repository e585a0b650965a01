"""Chat formatting by quotation linking, in DataFrame functions only.

1.  Quote levels: the number of ">" that a line begins with.  A passage is a run of lines of one level above 0.
2.  Lines are normalised (lower case, single blanks) and hashed.  The original of a quoted line is the first message
    of the conversation that has the line unquoted, if it comes before the quoting message; at any level.  There is one
    original per conversation and line, so the join yields at most one row per quoted line, however often it is quoted.
3.  A passage is linked to the message that most of its lines come from (the earliest of several).  A message replies to
    the original of its linked passage with the lowest level, and of those the one with most lines.
4.  Reply order: a message's path is the path of the message it replies to, and its own turn.  Paths are put together by
    doubling, so a chain of n replies takes log2(n) joins.  Sorted by path, every reply stands below its original.

Quoted lines, and a line "On ... wrote:" before them, are left out of the formatted content.

A null text counts as empty, a null conversation id as one conversation of its own (an empty id is another), a null turn as
the last.  An empty table gives an empty result.  Repeated rows
are messages of their own; a message never replies to one with the same turn.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwise.session import write_through

_QUOTE = r"^((?:[ \t]*>)+)[ \t]?(.*)$"
_QUOTED_LINES = r"(?m)^(?:On [^\n]* wrote:[ \t]*\n(?=[ \t]*>)|[ \t]*>[^\n]*(?:\n|\z))"
_LAST_TURN = 2**62


def _levels(messages: DataFrame) -> DataFrame:
    """Lines of messages: message, conversation, place, line number, level, normalised line."""
    lines = messages.select("message", "conversation", "place", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    marks = F.regexp_extract("raw", _QUOTE, 1)
    level = F.length(F.regexp_replace(marks, r"[^>]", ""))
    content = F.when(level > 0, F.regexp_extract("raw", _QUOTE, 2)).otherwise(F.col("raw"))
    normal = F.trim(F.regexp_replace(F.lower(content), r"[ \t]+", " "))
    return lines.select("message", "conversation", "place", "line", level.alias("level"), normal.alias("normal"))


def link(conversations: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Messages with an id of their own, and their passages: message, passage, level, lines, digest, original."""
    messages = conversations.select(
        F.monotonically_increasing_id().alias("message"),
        F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit("")).alias("conversation"),
        F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
        F.coalesce(F.col(turn).cast("long"), F.lit(_LAST_TURN)).alias("place"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    messages = write_through(messages, "chat-messages")
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    lines = _levels(quoting).where("level > 0 and normal <> ''")
    order = Window.partitionBy("message").orderBy("line")
    new = (F.col("line") != F.lag("line").over(order) + 1) | (F.col("level") != F.lag("level").over(order))
    lines = lines.withColumn("passage", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order)).withColumn("hash", F.xxhash64("normal"))
    lines = write_through(lines, "chat-quotes")
    wanted = lines.select("conversation", "hash").distinct()
    own = _levels(messages).where("level = 0 and normal <> ''").withColumn("hash", F.xxhash64("normal"))
    own = own.join(wanted, ["conversation", "hash"], "left_semi")
    origins = own.groupBy("conversation", "normal").agg(F.min(F.struct("place", "message")).alias("origin"))
    found = lines.join(origins, ["conversation", "normal"], "left")
    origin = F.when(F.col("origin.place") < F.col("place"), F.col("origin"))
    counted = found.groupBy("message", "conversation", "passage", "level", origin.alias("origin")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("line", "normal"))).alias("content")
    )
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct("n", (-F.col("origin.place")).alias("first"), "origin"))).alias("best")
    passages = counted.groupBy("message", "passage", "level").agg(
        F.sum("n").alias("lines"), best, F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.flatten(F.collect_list("content"))), lambda x: x["normal"])), 256).alias("digest"),
    )
    return messages, passages.select(
        "message", "passage", "level", "lines", "digest", F.col("best.n").alias("matched"),
        F.col("best.origin.message").alias("original"), F.col("best.origin.place").alias("original_place"),
    )


def format_chats(conversations: DataFrame, **columns) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to (turn), path, depth, n_passages, n_linked, max_level, content,
    formatted.  Sorted by conv_id and path, the formatted messages make up the conversation in reply order."""
    messages, passages = link(conversations, **columns)
    linked = F.col("original").isNotNull()
    rank = F.struct(-F.col("level"), "matched", -F.col("original_place"), "original", "original_place")
    replies = passages.groupBy("message").agg(
        F.count("*").alias("n_passages"), F.count(F.when(linked, 1)).alias("n_linked"), F.max("level").alias("max_level"),
        F.max(F.when(linked, rank)).alias("best"),
    )
    replies = replies.select("message", "n_passages", "n_linked", "max_level", F.col("best.original").alias("original"), F.col("best.original_place").alias("reply_place"))
    replies = write_through(replies, "chat-replies")
    # anchor: an earlier message above; steps: the places from there (excluded) down to the message
    chains = replies.where("original is not null").join(messages.select("message", "place"), "message")
    chains = chains.select("message", F.col("original").alias("anchor"), F.col("reply_place").alias("top"), F.array("place").alias("steps"))
    while True:
        chains = write_through(chains, "chat-chains")
        up = chains.select(F.col("message").alias("__m"), F.col("anchor").alias("__a"), F.col("top").alias("__t"), F.col("steps").alias("__s"))
        joined = chains.join(up, F.col("anchor") == F.col("__m"), "left")
        if joined.where("__m is not null").isEmpty():
            break
        chains = joined.select(
            "message", F.coalesce("__a", "anchor").alias("anchor"), F.coalesce("__t", "top").alias("top"),
            F.when(F.col("__m").isNotNull(), F.concat("__s", "steps")).otherwise(F.col("steps")).alias("steps"),
        )
    paths = chains.select("message", F.concat(F.array("top"), "steps").alias("path"))
    content = F.regexp_replace("text", _QUOTED_LINES, "")
    content = F.when(F.coalesce("n_passages", F.lit(0)) > 0, F.trim(F.regexp_replace(content, r"^\n+|\n+$", ""))).otherwise(F.col("text"))
    rows = messages.join(replies, "message", "left").join(paths, "message", "left")
    path = F.coalesce("path", F.array("place"))
    rows = rows.withColumn("content", content)
    return rows.select(
        "conv_id", "turn", "role",
        F.when(F.col("reply_place") != _LAST_TURN, F.col("reply_place")).alias("reply_to"),
        F.concat_ws("/", F.transform(path, lambda x: F.lpad(x.cast("string"), 19, "0"))).alias("path"),
        (F.size(path) - 1).alias("depth"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).alias("max_level"), "content",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "content", F.lit("\n<|end|>\n")).alias("formatted"),
    )
