"""Quotations in messages linked to what they quote, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navspark.llm.shared import staged

_MARKS = r"^(?:[ \t]*>)+"
_WHITE = r"[ \t\r\n\f\x0B]+"
#: Lines that mail programs put over a quote.
ATTRIBUTION = r"^[ \t]*(?:On .*wrote:|Am .*schrieb.*:|Le .*a écrit ?:|El .*escribió:|-{2,} ?(?:Original|Forwarded) Message ?-{2,})[ \t]*$"
#: Messages in one row of a conversation.
PART = 256


def normalised(text: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), _WHITE, " "))


def _lines(messages: DataFrame) -> DataFrame:
    """(message, pos, level, body) of each line but attributions; level is the number of leading quote marks."""
    lines = messages.select("message", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))
    marks = F.regexp_extract("line", _MARKS, 0)
    found = lines.select("message", "pos", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("line", _MARKS, "").alias("body"))
    return found.where(~F.col("body").rlike(ATTRIBUTION))


def _runs(lines: DataFrame) -> DataFrame:
    """Maximal runs of lines of one level in one message: (message, run, level, first line, text, lines)."""
    order = Window.partitionBy("message").orderBy("pos")
    new = F.when(F.lag("level").over(order) == F.col("level"), 0).otherwise(1)
    numbered = lines.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    grouped = numbered.groupBy("message", "run", "level").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    return grouped.select("message", "run", "level", "pos", F.transform("parts", lambda p: p["body"]).alias("bodies"))


def _units(runs: DataFrame, quoted: bool) -> DataFrame:
    """(message, run, level, pos, rank, hash, size): a run as a whole (rank 0), its paragraphs (1) and its lines (2)."""
    whole = F.array_join("bodies", "\n")
    kinds = [(0, F.array(whole)), (1, F.split(whole, r"\n[ \t]*\n")), (2, F.col("bodies"))]
    # Texts are made distinct before they become structs, for which that takes quadratic time.
    units = F.concat(*(F.transform(F.array_distinct(F.transform(texts, normalised)), lambda t, r=rank: F.struct(F.lit(r).alias("rank"), t.alias("text"))) for rank, texts in kinds))
    found = runs.select("message", "run", "level", "pos", F.explode(units).alias("u")).where("u.text <> ''")
    return found.select("message", "run", "level", "pos", "u.rank", F.md5("u.text").alias("hash"), F.length("u.text").alias("size"))


def linked(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per message: conv_id, turn, role, text, n_quotes, n_linked, parent_conv, parent_turn, thread_conv, thread_turn, depth, position.

    A quote is a run of lines with the same number of leading ">" marks, nested
    quotes by their own level.  Its original is the message that says the
    normalised passage itself, unquoted: as its whole unquoted text, a paragraph
    or a line; where no message says all of it, the longest line that one says
    counts.  The earliest turn of the same conversation comes first, else the
    least (conv_id, turn) of all, and it must come before the quoting message.
    The parent is the original of the first linked quote of the lowest level.
    ``text`` is what the message says itself: of a message with quotes, these
    go, the lines that attribute them, and blank lines at the ends.
    ``thread_conv, thread_turn`` name the message at the root of the parents,
    ``depth`` the steps to it, ``position`` the place in the thread by
    (conv_id, turn, role, text), where every message follows the one that it
    answers; ``conversations`` makes rows of threads.

    Nulls: a null text says and quotes nothing and stays null; messages without
    conv_id or turn are not linked, name themselves and have position 0.  An
    empty table gives an empty result; very long messages are read whole.  Rows that share
    (conv_id, turn) are one message for links to it.  Repeated rows give
    repeated rows.  Other columns are ignored.

    Originals are first reduced to one row per passage hash and conversation,
    with partial minima before the shuffle, so a line that all messages share is
    one row.  The quoting side of these joins may be skewed (a passage that a
    third of all messages quote, a message that a third answer); it is the outer
    side of left joins that no operator takes the partitioning of, so adaptive
    execution splits it.
    """
    rows = messages.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    quoting = F.col("text").rlike("(?m)" + _MARKS)
    message = F.struct("conv_id", "turn", F.xxhash64("text").alias("key"))
    own = F.array_join(F.filter(F.split("text", r"\r?\n", -1), lambda x: ~x.rlike(_MARKS) & ~x.rlike(ATTRIBUTION)), "\n")
    clean = F.when(quoting, F.regexp_replace(own, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")).otherwise(F.col("text"))
    quoters = rows.where(quoting & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(message.alias("message"), "text").distinct()
    runs = _runs(_lines(quoters)).where("level > 0")
    if quoters.isEmpty():
        alone = F.lit(None).cast("bigint")
        return _placed(rows.select("conv_id", "turn", "role", "text", F.lit(0).cast("bigint").alias("n_quotes"), F.lit(0).cast("bigint").alias("n_linked"), alone.alias("parent_conv"), alone.alias("parent_turn"), F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.lit(0).cast("bigint").alias("depth")))
    runs = staged(runs, "quotes")
    units = _units(runs, True).withColumn("conv", F.col("message.conv_id"))

    saying = rows.where("conv_id is not null and turn is not null and text is not null").withColumn("said", clean).where("said <> ''")
    said = saying.select(F.struct("conv_id", "turn").alias("message"), F.lit(0).alias("run"), F.lit(0).alias("level"), F.lit(0).alias("pos"), F.split("said", r"\r?\n", -1).alias("bodies"))
    here = staged(_units(said, False).groupBy("hash", F.col("message.conv_id").alias("conv")).agg(F.min("message.turn").alias("here")), "said")
    first = here.groupBy("hash").agg(F.min(F.struct(F.col("conv").alias("conv_id"), F.col("here").alias("turn"))).alias("first"))
    place = units.join(here, ["hash", "conv"], "left").join(first, "hash", "left")
    me = F.struct("message.conv_id", "message.turn")
    origin = F.when(F.col("here") < F.col("message.turn"), F.struct(F.col("conv").alias("conv_id"), F.col("here").alias("turn"))).when(F.col("first") < me, F.col("first"))
    place = place.withColumn("origin", origin).where("origin is not null")
    best = place.groupBy("message", "run", "level", "pos").agg(F.min(F.struct("rank", (-F.col("size")).alias("size"), "origin")).alias("b"))
    parents = best.groupBy("message").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "pos", "b.origin")).alias("m"))
    counted = runs.groupBy("message").agg(F.count("*").alias("n_quotes"))
    found = staged(counted.join(parents, "message", "left").select("message", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.col("m.origin.conv_id").alias("parent_conv"), F.col("m.origin.turn").alias("parent_turn")), "parents")
    roots = _roots(found)
    joined = rows.withColumn("message", message).join(found, "message", "left").join(roots, ["conv_id", "turn"], "left")
    return _placed(joined.select(
        "conv_id", "turn", "role", clean.alias("text"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "parent_conv", "parent_turn",
        F.coalesce("thread_conv", "conv_id").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
    ))


def _placed(found: DataFrame) -> DataFrame:
    """``found`` with each message's position in its thread.

    All rows are sorted once, by ranges, so a thread of any length is many
    tasks.  A row's number in the whole is its number in its range and the
    sizes of those before; the number of a thread's first row is taken off.
    """
    order = ["thread_conv", "thread_turn", "conv_id", "turn", "role", "text"]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = staged(ranged.withColumn("range", F.shiftright(at, 33)).withColumn("row", at.bitwiseAND((1 << 33) - 1)), "placed")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    # A row per range is all that meets here.
    begins = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("begin"))
    first = ranged.groupBy("thread_conv", "thread_turn", "range").agg(F.min("row").alias("row")).join(F.broadcast(begins), "range")
    first = first.groupBy("thread_conv", "thread_turn").agg(F.min(F.col("begin") + F.col("row")).alias("first"))
    first = staged(first.where("thread_conv is not null and thread_turn is not null"), "first")
    numbered = ranged.join(F.broadcast(begins), "range").join(first, ["thread_conv", "thread_turn"], "left")
    position = F.coalesce(F.col("begin") + F.col("row") - F.col("first"), F.lit(0))
    return numbered.select(*found.columns, position.alias("position"))


def conversations(found: DataFrame) -> DataFrame:
    """Threads of ``linked`` messages: thread_conv, thread_turn, part, n_messages, messages.

    ``messages`` are (role, text) by position; a thread of more than PART
    messages is several rows, by ``part``.  Messages without conv_id or turn are
    conversations of their own.
    """
    lone = F.col("thread_conv").isNull() | F.col("thread_turn").isNull()
    message = F.struct("position", "role", "text")
    part = (F.col("position") / PART).cast("bigint").alias("part")
    threads = found.where(~lone).groupBy("thread_conv", "thread_turn", part).agg(F.array_sort(F.collect_list(message)).alias("all"))
    every = threads.unionByName(found.where(lone).select("thread_conv", "thread_turn", F.lit(0).cast("bigint").alias("part"), F.array(message).alias("all")))
    return every.select("thread_conv", "thread_turn", "part", F.size("all").alias("n_messages"), F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def _roots(found: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_conv, thread_turn, depth) of the linked messages, by pointer doubling.

    Messages that have reached their root take no part in later rounds, but as what others point to.
    """
    step = found.where("parent_conv is not null").groupBy("message.conv_id", "message.turn").agg(F.min(F.struct("parent_conv", "parent_turn")).alias("up"))
    active = staged(step.select("conv_id", "turn", "up.parent_conv", "up.parent_turn", F.lit(1).cast("bigint").alias("depth"), F.lit(False).alias("ended")), "steps")
    ended = active.where("ended")
    while not active.isEmpty():
        every = active.unionByName(ended)
        above = every.select(
            F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"), F.col("parent_conv").alias("next_conv"), F.col("parent_turn").alias("next_turn"),
            F.col("depth").alias("more"), F.col("ended").alias("last"),
        )
        joined = active.join(above, ["parent_conv", "parent_turn"], "left")
        moved = staged(
            joined.select(
                "conv_id", "turn", F.coalesce("next_conv", "parent_conv").alias("parent_conv"), F.coalesce("next_turn", "parent_turn").alias("parent_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("last", F.lit(True)).alias("ended"),
            ), "steps",
        )
        ended = ended.unionByName(moved.where("ended"))
        active = moved.where("not ended")
    return ended.select("conv_id", "turn", F.col("parent_conv").alias("thread_conv"), F.col("parent_turn").alias("thread_turn"), "depth")
