"""Spelling variants: words one edit apart, found by permuterm rotations.

Every word is marked with a terminator and rotated at every place. A rotation that starts behind a character ends
with that character; its prefix without it stands for "this word with that character open". Words of one length that
share such a prefix differ by a replacement there; a shorter word whose whole rotation is the prefix differs by the
insertion of the open character. So rotations, sorted by prefix, are scanned group by group. A group holds one word
for each character that can be open and at most one whole rotation, so its size is bounded by the alphabet, not by
the corpus. Of equal neighbouring characters only the first counts as inserted, so each pair meets in one group alone
and counts of neighbours are sums. A group gives each member the number of its neighbours and its best one (the
two best of the group suffice); ``neighbours`` emits the pairs themselves.

Roots follow the chain of forms by pointer doubling; a form is ``ratio`` times as frequent as its word, so
chains are as long as the logarithm of the largest count.

Defined cases: a null text has no words, a null id counts as an empty string in the checksum; equal rows count as often as they come; an
empty table gives an empty result; a word of any length is rotated whole; ties go to the smaller word in code point
order; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import cut_lineage

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
SLIPS = 199   # a run whose checksum this divides loses a character
END = "$"     # no letter, so it marks the end of a word


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, slips: int = SLIPS) -> DataFrame:
    """(word, n) over all documents. Runs shorter than a word are not matched at all; counts are combined in the task."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"([{LETTERS}]{{{min_chars},}})"), 1)
    rows = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    rows = rows.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    rows = rows.select("_run", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    slipped = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    word = F.when(F.col("_h") % slips == 0, slipped).otherwise(F.col("_run"))
    counts = rows.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= min_count) & (F.length("word") >= min_chars))


def rotations(words: DataFrame) -> DataFrame:
    """(key, kind, word, n): ``whole`` rotations, and those with an ``open`` character; ``first`` where the open character does not
    repeat the one before it."""
    w, size = F.col("word"), F.length("word")
    cut = F.explode(F.sequence(F.lit(0), size)).alias("_cut")
    rows = words.select("word", "n", cut)
    before = F.substring(w, F.lit(1), F.col("_cut"))
    whole = F.concat(F.substring(w, F.col("_cut") + 1, size), F.lit(END), before)
    # the rotation that starts behind character _cut + 1, without that character
    opened = F.concat(F.substring(w, F.col("_cut") + 2, size), F.lit(END), before)
    first = (F.col("_cut") == 0) | (F.substring(w, F.col("_cut"), F.lit(1)) != F.substring(w, F.col("_cut") + 1, F.lit(1)))
    entries = F.when(F.col("_cut") < size, F.array(
        F.struct(whole.alias("key"), F.lit("whole").alias("kind")),
        F.struct(opened.alias("key"), F.when(first, F.lit("first")).otherwise(F.lit("open")).alias("kind")))
    ).otherwise(F.array(F.struct(whole.alias("key"), F.lit("whole").alias("kind"))))
    return rows.select("word", "n", F.explode(entries).alias("_e")).select("_e.key", "_e.kind", "word", "n")


def _rank() -> Column:
    """Smaller is better: more frequent, then smaller in code point order."""
    return F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))


def best_neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): every word with the number of words one edit away, and the best of them."""
    group = Window.partitionBy("key")
    is_open, is_first, is_whole = F.col("kind") != "whole", F.col("kind") == "first", F.col("kind") == "whole"
    # sorted within the group: open ones first, the best ahead
    scan = group.orderBy(is_whole, "n_down", "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rotations(words).withColumn("n_down", -F.col("n")).withColumn("own", _rank())
    rows = rows.select(
        "word", "n", "kind", "own",
        F.count_if(is_open).over(scan).alias("n_open"), F.count_if(is_first).over(scan).alias("n_first"), F.count_if(is_whole).over(scan).alias("n_whole"),
        F.first("own").over(scan).alias("top"), F.nth_value("own", 2).over(scan).alias("next"),
        F.min(F.when(is_first, F.col("own"))).over(scan).alias("top_first"), F.min(F.when(is_whole, F.col("own"))).over(scan).alias("shorter"))
    other = F.when(F.col("n_open") > 1, F.when(F.col("own") == F.col("top"), F.col("next")).otherwise(F.col("top")))
    near = (F.when(is_whole, F.col("n_first")).when(is_first, F.col("n_open") - 1 + F.col("n_whole")).otherwise(F.col("n_open") - 1))
    best = F.when(is_whole, F.col("top_first")).when(is_first, F.least(other, F.col("shorter"))).otherwise(other)
    return rows.groupBy("word").agg(F.max("n").alias("n"), F.sum(near).cast("long").alias("n_near"), F.min(best).alias("best"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): every ordered pair of words one edit apart, once. A member meets the members of its groups, at
    most one for each letter of the alphabet and place."""
    rows = rotations(words)
    a = rows.select("key", F.col("kind").alias("kind_a"), "word")
    b = rows.select("key", F.col("kind").alias("kind_b"), F.col("word").alias("near"))
    both_open = (F.col("kind_a") != "whole") & (F.col("kind_b") != "whole") & (F.col("word") != F.col("near"))
    indel = ((F.col("kind_a") == "whole") & (F.col("kind_b") == "first")) | ((F.col("kind_a") == "first") & (F.col("kind_b") == "whole"))
    return a.join(b, "key").where(both_open | indel).select("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last word of the chain, by pointer doubling."""
    jumps = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = jumps.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moved = cut_lineage(jumps.join(onward, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        jumps = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return jumps


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n) of distinct words."""
    near = best_neighbours(words)
    taken = -F.col("best.minus") >= ratio * F.col("n")
    forms = cut_lineage(near.select("word", "n", "n_near", F.when(taken, F.col("best.word")).alias("form"),
                                    F.when(taken, -F.col("best.minus")).alias("form_n")))
    return forms.join(roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12(documents: DataFrame) -> DataFrame:
    """The contract's row of every word of all documents."""
    words = cut_lineage(word_counts(documents))
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
