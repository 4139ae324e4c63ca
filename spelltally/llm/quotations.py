"""Quotation linking, in DataFrame functions only.

Lines marked by > quote an earlier message; so many marks, so many levels. The lines of a
level up to a blank one are a passage. Quoted passages, normalised and hashed, are joined
to the unquoted passages of earlier messages, which gives each reply its parent. Following
parents to the first message of a thread gives conversations in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import let, quoted, stored, whole, without

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
LINE_END = r"\r\n|\r|\n"


def lines(text: Column) -> Column:
    """Array of (level, content) of the lines of a text."""
    return F.transform(
        F.split(text, LINE_END),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(line, MARKS, "").alias("content"),
        ),
    )


def passages(text: Column) -> Column:
    """Array of (level, hash): runs of lines of one level, up to a blank line.

    Before hashing, A-Z and other capitals are lower-cased and white space is made one
    space, so a passage that was wrapped anew keeps its hash.
    """

    def of_lines(marked: Column) -> Column:
        blank = lambda i: F.trim(F.get(marked, i)["content"]) == ""
        opens = F.filter(
            F.sequence(F.lit(0), F.size(marked) - 1),
            lambda i: ~blank(i)
            & ((i == 0) | F.coalesce(blank(i - 1) | (F.get(marked, i - 1)["level"] != marked[i]["level"]), F.lit(True))),
        )

        def cut(starts: Column) -> Column:
            def passage(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(marked))
                content = F.transform(F.slice(marked, start + 1, end - start), lambda line: line["content"])
                plain = F.trim(F.regexp_replace(F.lower(F.array_join(content, " ")), r"\s+", " "))
                return F.struct(marked[start]["level"].alias("level"), F.md5(plain).alias("hash"))

            return F.transform(starts, passage)

        return let(opens, cut)

    return let(lines(text), of_lines)


def body(text: Column) -> Column:
    """The unquoted lines, without blank ones at both ends."""
    own = F.transform(F.filter(lines(text), lambda line: line["level"] == 0), lambda line: line["content"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn and parent_turn of each message that quotes an earlier one of its conversation.

    A passage belongs to the first message that holds it unquoted. The parent is the message
    with most passages of the lowest matching level; of several the latest one.
    """
    found = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.explode(passages(whole())).alias("p")
    )
    found = stored(found.select("conv_id", "turn", "p.level", "p.hash"), "passages")
    originals = found.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    return (
        found.where("level > 0")
        .join(originals, ["conv_id", "hash"])
        .where("original < turn")
        .groupBy("conv_id", "turn", "level", "original")
        .agg(F.count(F.lit(1)).alias("number"))
        .groupBy("conv_id", "turn")
        .agg(F.max_by("original", F.struct(-F.col("level"), "number", "original")).alias("parent_turn"))
    )


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, thread_turn (the thread's first message) and depth of linked messages.

    Pointers double their reach each turn, so a thread of n messages takes log2 n turns;
    each is written and read again, and only messages that aren't there yet are joined.
    Parents are earlier, so there are no circles.
    """
    reach = stored(
        links.select(
            "conv_id", "turn", "parent_turn", F.col("parent_turn").alias("up"),
            F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open"),
        ),
        "threads",
    )
    while not reach.where("open").isEmpty():
        above = reach.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"))
        moved = reach.where("open").join(above, ["conv_id", "up"], "left").select(
            "conv_id", "turn", "parent_turn", F.coalesce("higher", "up").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("open"),
        )
        reach = stored(reach.where("NOT open").unionByName(moved), "threads")
    return reach.drop("open").withColumnRenamed("up", "thread_turn")


def linked(messages: DataFrame) -> DataFrame:
    """Add body, quote_levels, parent_turn, thread_turn and depth to each message.

    Ordered by conv_id, thread_turn, turn, a thread's messages stand together and replies
    after what they answer. A message that quotes nothing known starts a thread of depth 0,
    also one without conv_id or turn. A null text has an empty body; rows that repeat a
    conv_id and turn share their parent; columns named like a result are replaced; an empty
    input gives an empty result.
    """
    messages = without(messages, "body", "quote_levels", "parent_turn", "thread_turn", "depth")
    found = threads(parents(messages))
    levels = F.coalesce(F.array_max(F.transform(lines(whole()), lambda line: line["level"])), F.lit(0))
    return messages.join(found, ["conv_id", "turn"], "left").select(
        *(quoted(name) for name in messages.columns),
        body(whole()).alias("body"),
        levels.alias("quote_levels"),
        "parent_turn",
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def as_mail(messages: DataFrame) -> DataFrame:
    """Chat turns as mail: each message quotes the two turns before it, the older one deeper."""
    texts = messages.groupBy("conv_id", "turn").agg(F.min(whole()).alias("said"))
    mail = messages
    for back in (1, 2):
        before = texts.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("said").alias(f"_said{back}"))
        mail = mail.join(before, ["conv_id", "turn"], "left")
    marked = [
        F.regexp_replace(F.col(f"_said{back}"), r"(?m)^", "> " * back) for back in (2, 1)
    ]
    return mail.select(
        *(quoted(name) if name != "text" else F.concat_ws("\n", *marked, F.lit(""), whole()).alias("text") for name in messages.columns)
    )
