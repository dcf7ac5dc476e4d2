"""Quotation linking: conversations in reply order, without quoted text.

A line's quote level is the number of ``>`` in front of it. Quoted lines are normalised (case, punctuation and blanks) and
hashed, nested levels too; so is every message's own text, line by line, and so are whole passages on both sides: the runs
of lines of one level and their paragraphs, line breaks as blanks. A quoted line is linked to the latest earlier message of
the same conversation that says its run, else its paragraph, else the line alone; so a re-wrapped passage is found, and a
common line inside a passage goes to who said the passage. A message's parent is the one that most of its first-level
quoted lines link to (ties: the later one). Without links the parent is the previous message. Reply order is the parents'
tree, depth first: a message, then each reply to it, by turn, with all that hangs on it; without quotes that is the order
of the turns. The chat text is the messages in that order with their roles, quotes removed.

"Latest earlier" is an as-of lookup, not a join of all pairs: per (conversation, line) the turns are cut in buckets; a
window runs inside a bucket, and a small table of one row a bucket carries the last turn over. Turns, counts and links are
aggregated before they are shuffled, so a common line costs a row per turn. The place in the tree is a list ranking by
pointer doubling, of branching conversations only: rounds grow with the logarithm of the longest one. A conversation of any
length is cut in segments of SEGMENT messages: no row and no task holds it whole. DataFrame functions only.

Defined cases: a null text is an empty message; rows without conversation or turn are left out (they have no place in an
order); rows equal in conversation, turn, role and text are one message; two different messages of one turn are
ordered by role and text; a message of quotes alone stays, with empty text; a quote that nobody said is removed and links
nothing; empty tables work; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.llm.common import cut_lineage

BUCKET = 1024     # turns of one bucket
SEGMENT = 256     # messages of one chat row
QUOTE = r"^(?:[ \t]{0,3}>)+"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def unquoted(line: Column) -> Column:
    return F.regexp_replace(line, QUOTE, "")


def normalised(line: Column) -> Column:
    """Lower case, runs of anything but letters, digits and marks as one blank."""
    return F.trim(F.regexp_replace(F.lower(unquoted(line)), r"[^\p{L}\p{N}\p{M}]+", " "))


def messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with their lines."""
    return (conversations.where("conv_id is not null and turn is not null")
            .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .distinct().withColumn("lines", F.split("text", r"\r\n|\n|\r", -1)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def joined_runs(lines: Column, breaks: Callable[[Column, Column], Column]) -> Column:
    """Array of (first, end, text) of the runs of ``lines`` (level, line), cut where ``breaks(line, line before)`` holds."""
    def cut(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | breaks(F.get(x, i), F.get(x, i - 1)))
        return let(at, lambda s: F.transform(s, lambda first, k: let(
            F.coalesce(F.get(s, k + 1), F.size(x)),
            lambda end: F.struct(first.alias("first"), end.alias("end"),
                                 F.array_join(F.filter(F.slice(x, first + 1, end - first)["line"], lambda y: y != ""), " ").alias("text")))))
    return let(lines, cut)


def units(found: DataFrame) -> DataFrame:
    """(conv_id, turn, level, line, run, paragraph): hashes of every line that is not blank, and of the passages it lies in."""
    lines = F.transform("lines", lambda x: F.struct(quote_level(x).alias("level"), normalised(x).alias("line")))

    def placed(x: Column) -> Column:
        runs = joined_runs(x, lambda a, b: a["level"] != b["level"])
        parts = joined_runs(x, lambda a, b: (a["level"] != b["level"]) | ((a["line"] == "") != (b["line"] == "")))
        whole = F.flatten(F.transform(runs, lambda r: F.array_repeat(F.xxhash64(r["text"]), r["end"] - r["first"])))
        part = F.flatten(F.transform(parts, lambda r: F.array_repeat(F.xxhash64(r["text"]), r["end"] - r["first"])))
        return F.filter(F.arrays_zip(x.alias("x"), whole.alias("run"), part.alias("paragraph")), lambda y: y["x"]["line"] != "")

    each = found.select("conv_id", "turn", F.explode(let(lines, placed)).alias("u"))
    return each.select("conv_id", "turn", F.col("u.x.level").alias("level"), F.xxhash64("u.x.line").alias("line"),
                       F.col("u.run").alias("run"), F.col("u.paragraph").alias("paragraph"))


def said_and_quoted(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, said, quoted): a row for each distinct text, of a line or a passage, of a turn."""
    return (lines.select("conv_id", "turn", "level", F.explode(F.array_distinct(F.array("run", "paragraph", "line"))).alias("hash"))
            .groupBy("conv_id", "turn", "hash").agg(F.max(F.col("level") == 0).alias("said"), F.max(F.col("level") > 0).alias("quoted")))


def latest_before(rows: DataFrame, keys: list[str], mark: Column) -> DataFrame:
    """``rows`` (one a key and turn) with ``before``: the greatest smaller turn of the same keys whose row is marked."""
    bucketed = rows.withColumns({"__bucket": F.floor(F.col("turn") / BUCKET), "__turn": F.when(mark, F.col("turn"))})
    each = [*keys, "__bucket"]
    ends = bucketed.groupBy(*each).agg(F.max("__turn").alias("__last"))
    carried = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carry", F.last("__last", ignorenulls=True).over(carried)).select(*each, "__carry")
    inside = Window.partitionBy(*each).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return (bucketed.withColumn("__near", F.last("__turn", ignorenulls=True).over(inside))
            .join(ends, each, "left")
            .withColumn("before", F.coalesce("__near", "__carry")).drop("__bucket", "__turn", "__near", "__carry"))


def quote_links(found: DataFrame) -> DataFrame:
    """(conv_id, turn, level, line, before): every distinct quoted line of a turn, its least level of quoting, and the turn
    that said its passage, or else the line, if any."""
    lines = units(found)
    hits = latest_before(said_and_quoted(lines), ["conv_id", "hash"], F.col("said")).where("quoted").select("conv_id", "turn", "hash", "before")
    asked = (lines.where("level > 0").distinct()
             .select("conv_id", "turn", "level", "line", F.posexplode(F.array("run", "paragraph", "line")).alias("rank", "hash")))
    best = F.max(F.when(F.col("before").isNotNull(), F.struct(-F.col("rank"), "before")))
    return (asked.join(hits, ["conv_id", "turn", "hash"]).groupBy("conv_id", "turn", "line")
            .agg(F.min("level").alias("level"), best.alias("best"))
            .select("conv_id", "turn", "level", "line", F.col("best.before").alias("before")))


def parents(found: DataFrame) -> DataFrame:
    """(conv_id, turn, quoted, linked, parent_turn, previous_turn) of every turn."""
    links = quote_links(found)
    votes = links.groupBy("conv_id", "turn", "before").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("level") == 1).alias("direct"))
    by_turn = votes.groupBy("conv_id", "turn").agg(
        F.sum("lines").alias("quoted"), F.sum(F.when(F.col("before").isNotNull(), F.col("lines"))).alias("linked"),
        F.max(F.when(F.col("before").isNotNull(), F.struct("direct", "lines", "before"))).alias("best"))
    turns = latest_before(found.select("conv_id", "turn").distinct(), ["conv_id"], F.lit(True))
    return turns.join(by_turn, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("quoted", F.lit(0)).cast("long").alias("quoted"), F.coalesce("linked", F.lit(0)).cast("long").alias("linked"),
        F.coalesce("best.before", "before").alias("parent_turn"), F.col("before").alias("previous_turn"))


def tree_places(found: DataFrame, replies: DataFrame) -> DataFrame:
    """(conv_id, turn, first): messages before the turn in the depth-first order of its conversation's replies.

    Every turn is entered and left once. Before it is entered comes the end of the reply before it under the same parent,
    else the parent's entry; before it is left the end of its last reply, else its own entry. Sums along these pointers are
    doubled in length each round; no two rows point to the same place."""
    keys = ["conv_id", "turn"]
    sizes = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sibling = latest_before(replies.where("parent_turn is not null").select(*keys, "parent_turn"), ["conv_id", "parent_turn"], F.lit(True))
    last = replies.where("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.max(replies["turn"]).alias("last"))
    nodes = cut_lineage(
        replies.select(*keys, "parent_turn").join(sizes, keys).join(sibling.select(*keys, "before"), keys, "left").join(last, keys, "left"))
    enter = nodes.select(*keys, F.lit(0).alias("side"), F.coalesce("before", "parent_turn").alias("to"),
                         F.col("before").isNotNull().cast("int").alias("to_side"), F.col("n").alias("sum"))
    leave = nodes.select(*keys, F.lit(1).alias("side"), F.coalesce("last", "turn").alias("to"),
                         F.col("last").isNotNull().cast("int").alias("to_side"), F.lit(0).cast("long").alias("sum"))
    steps = cut_lineage(enter.union(leave))
    while not (open_ := steps.where(F.col("to").isNotNull())).isEmpty():
        up = steps.select("conv_id", F.col("turn").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("__to"),
                          F.col("to_side").alias("__side"), F.col("sum").alias("__sum"))
        moved = open_.join(up, ["conv_id", "to", "to_side"]).select(
            *keys, "side", F.col("__to").alias("to"), F.col("__side").alias("to_side"), (F.col("sum") + F.col("__sum")).alias("sum"))
        steps = cut_lineage(moved.union(steps.where(F.col("to").isNull())))
    return steps.where("side = 0").join(sizes, keys).select(*keys, (F.col("sum") - F.col("n")).alias("first"))


def positions(found: DataFrame) -> DataFrame:
    """``found`` with its place in the conversation by turn (messages of earlier buckets, then the place inside the bucket)
    and ``in_turn``, the place among the messages of the turn."""
    bucketed = found.withColumn("__bucket", F.floor(F.col("turn") / BUCKET))
    counts = bucketed.groupBy("conv_id", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy("conv_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "__bucket", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__above"))
    inside = Window.partitionBy("conv_id", "__bucket").orderBy("turn", "role", "text")
    same = Window.partitionBy("conv_id", "__bucket", "turn").orderBy("role", "text")
    return (bucketed.withColumn("__in", F.row_number().over(inside)).withColumn("in_turn", F.row_number().over(same) - 1).join(counts, ["conv_id", "__bucket"])
            .withColumn("position", F.col("__above") + F.col("__in") - 1).drop("__bucket", "__in", "__above"))


def linked_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, quoted, linked, parent_turn): all messages in reply order, quotes removed."""
    found = messages(conversations)
    own = F.filter("lines", lambda x: quote_level(x) == 0)
    text = F.trim(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"))
    placed = positions(found.select("conv_id", "turn", "role", "text", text.alias("own")))
    replies = cut_lineage(parents(found))
    branching = replies.where("parent_turn <> previous_turn").select("conv_id").distinct()
    if not branching.isEmpty():
        places = tree_places(found.join(branching, "conv_id", "left_semi"), replies.join(branching, "conv_id", "left_semi"))
        placed = placed.join(places, ["conv_id", "turn"], "left").withColumn(
            "position", F.coalesce(F.col("first") + F.col("in_turn"), "position"))
    return placed.join(replies, ["conv_id", "turn"]).select(
        "conv_id", "position", "turn", "role", F.regexp_replace("own", r"^[\s]+|[\s]+$", "").alias("text"), "quoted", "linked", "parent_turn")


def chats(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, n_messages, n_linked, parent_turns, chat): the conversation as text, in rows of at most ``segment``
    messages; ``parent_turns`` names the turn that each message answers, comma-joined in the same order (the first: none)."""
    rows = linked_messages(conversations).withColumn("segment", F.floor(F.col("position") / segment))
    one = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    return (rows.groupBy("conv_id", "segment").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("linked") > 0).alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("position", one.alias("line"), F.coalesce(F.col("parent_turn").cast("string"), F.lit("")).alias("parent")))).alias("__all"))
        .select("conv_id", "segment", "n_messages", "n_linked", F.array_join(F.col("__all.parent"), ",").alias("parent_turns"),
                F.array_join(F.col("__all.line"), "\n").alias("chat")))


def op8(conversations: DataFrame) -> DataFrame:
    """All conversations as chat rows; extra columns are ignored, the other cases are those of the module."""
    return chats(conversations.select("conv_id", "turn", "role", "text"))
