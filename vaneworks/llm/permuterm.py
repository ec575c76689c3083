"""Spelling variants: words one edit apart, found among the sorted rotations of terminator-marked words (permuterm).

A word is marked at its end and rotated in every way. The rotation that ends in a character is, without it, the rest of the
word read from behind the character round to before it: words that differ in just that character share this prefix, and the
rotation of the word that lacks it is the prefix itself. So every rotation is placed under itself and under its prefix that
skips the last character; sorted by these, each range is a group of words one edit from each other, and one scan of it gives
each member its number of neighbours and the most frequent one. A group has at most one word for each letter and one more.

A replacement is found at its place alone. A deletion inside a run of one letter gives the same word at each place of the
run: it counts at the first.

Texts: maximal runs of ``LETTERS``, A-Z lower-cased. A null text has none, an empty one neither; a text of any length is read
whole, but its runs must fit into memory. A null doc_id reads as an empty one. Repeated rows count again. A table without
words gives an empty result. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaneworks.llm.common import drop_stored, stored, whole

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Ends a word; sorts below every letter and is none.
END = "$"
MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent.
RATIO = 10
#: One occurrence in so many, by hash, loses a code point (planted misspellings).
DAMAGED_ONE_IN = 31


def damaged(doc_id: Column, run: Column, one_in: int = DAMAGED_ONE_IN) -> Column:
    """The run, less one code point where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("bigint")).cast("int")
    return F.when(F.pmod(h, F.lit(one_in)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, one_in: int | None = None) -> DataFrame:
    """(word, n) of the words of all texts; ``one_in`` plants misspellings."""
    runs = F.regexp_extract_all(whole(F.col(text)), F.lit(f"({LETTERS})"), F.lit(1))
    # a run that is too short stays so, whatever is deleted from it
    found = docs.select(F.col(doc_id).alias("_id"), F.explode(F.filter(runs, lambda r: F.length(r) >= min_length)).alias("_run"))
    found = found.select("_id", lower_ascii(F.col("_run")).alias("_run"))
    word = damaged(F.col("_id"), F.col("_run"), one_in) if one_in else F.col("_run")
    counted = found.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, skips, first): each rotation of each marked word under itself and, but for the word itself, without its last character.

    ``first``: the skipped character is the first of a run of its like.
    """
    marked = F.concat("word", F.lit(END))
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("_p"))
    rotation = F.concat(F.substring(marked, F.col("_p") + 1, F.length(marked)), F.substring(marked, F.lit(1), F.col("_p")))
    turned = turned.withColumn("_rotation", rotation)
    here, before = F.substring(F.col("word"), F.col("_p"), F.lit(1)), F.substring(F.col("word"), F.col("_p") - 1, F.lit(1))
    whole_one = F.struct(F.col("_rotation").alias("prefix"), F.lit(False).alias("skips"), F.lit(False).alias("first"))
    shorter = F.struct(
        F.substring(F.col("_rotation"), F.lit(1), F.length("_rotation") - 1).alias("prefix"), F.lit(True).alias("skips"),
        ((F.col("_p") == 1) | (here != before)).alias("first"),
    )
    placed = turned.select("word", "n", F.explode(F.when(F.col("_p") > 0, F.array(whole_one, shorter)).otherwise(F.array(whole_one))).alias("_r"))
    return placed.select("word", "n", "_r.*")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of every word with a neighbour: their number, and the most frequent (of equal ones the smallest in code-point order)."""
    best_first = Window.partitionBy("prefix").orderBy(F.desc("n"), "word")
    group = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(best_first)
    best = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    other = F.when(place == 1, F.lead(best, 1).over(best_first)).otherwise(F.first(best).over(group))
    skipping, firsts = F.sum(F.col("skips").cast("int")).over(group), F.sum(F.col("first").cast("int")).over(group)
    lacking = F.sum((~F.col("skips")).cast("int")).over(group)
    near = F.when(F.col("skips"), skipping - 1 + F.when(F.col("first"), lacking).otherwise(0)).otherwise(firsts)
    scanned = rotations(words).select("word", other.alias("_best"), near.alias("_near")).where(F.col("_best").isNotNull())
    found = scanned.groupBy("word").agg(F.sum("_near").alias("n_near"), F.min("_best").alias("_best"))
    return found.select("word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the links word -> form, followed to the last. Each step is to a word ``ratio`` times as frequent, so few rounds of doubling are needed."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("_via"), F.col("root").alias("_next"))
        moved = stored(ways.join(on, F.col("root") == F.col("_via"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "ways")
        drop_stored(ways)
        ways = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return ways


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of (word, n): form (its most frequent neighbour, if ``ratio`` times as frequent), root (the last form), n, n_near, form_n."""
    if ratio < 2:
        raise ValueError("forms are followed upwards: the ratio must be above 1")
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = neighbours(words).withColumnRenamed("word", "_w")
    chosen = F.col("near_n") >= ratio * F.col("n")
    met = words.join(near, F.col("word") == F.col("_w"), "left").select(
        "word", F.when(chosen, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("near_n")).alias("form_n")
    )
    met = stored(met, "variants")
    drop_stored(words)
    ways = roots(met.where(F.col("form").isNotNull())).select(F.col("word").alias("_w"), "root")
    return met.join(ways, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
