"""Line dedup: windows of three consecutive lines that stood earlier in the corpus are removed.

Lines are compared with white space runs as one space and no white space at the ends; lines without a word are passed
over and stay. A window is three consecutive lines with words. Of each window the first occurrence (smallest doc_id,
then position) stays; later ones are removed, the positions that they cover merged. Windows are judged on the input.

Rows: a null ``text`` is empty, a null ``doc_id`` comes before all others. Rows with equal doc_id and text are one
document: neither removes the other. A document with fewer than three lines loses nothing. Further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.common import SPACES, has_word, let, text_key, upto, whole

LINES = 3
SALTS = 16


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACES, " "))


def _worded(split: Column) -> Column:
    """Positions of the lines that have a word."""
    return F.transform(F.filter(F.transform(split, lambda s, i: F.struct(i.alias("i"), has_word(s).alias("w"))), lambda e: e["w"]), lambda e: e["i"])


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = LINES) -> DataFrame:
    """One row per window: _id, _key, _at (its number in the document) and 128 bits of its lines."""
    bare = F.filter(F.transform(F.split(whole(F.col(text)), "\n"), _bare), lambda s: s != "")
    found = F.transform(
        upto(F.size("_bare") - (n - 1)),
        lambda i: F.struct(
            F.xxhash64(*[F.get(F.col("_bare"), i + k) for k in range(n)]).alias("h"),
            F.xxhash64(F.lit(n), *[F.get(F.col("_bare"), i + k) for k in range(n)]).alias("g"),
        ),
    )
    rows = docs.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), bare.alias("_bare"))
    rows = rows.select("_id", "_key", F.posexplode(found).alias("_at", "_w"))
    return rows.select("_id", "_key", "_at", F.col("_w.h").alias("_h"), F.col("_w.g").alias("_g"))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Windows that are not the first of their kind: _id, _key, _at, _first (i, k, a: where that is). A hot window meets its first occurrence in ``SALTS`` parts."""
    place = F.struct(F.col("_id").alias("i"), F.col("_key").alias("k"), F.col("_at").alias("a"))
    firsts = windows.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where(F.col("_n") > 1)
    firsts = firsts.select(F.col("_h").alias("_h2"), F.col("_g").alias("_g2"), "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s2"))
    spread = windows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int"))
    met = spread.join(firsts, (F.col("_h") == F.col("_h2")) & (F.col("_g") == F.col("_g2")) & (F.col("_salt") == F.col("_s2")))
    first = F.col("_id").eqNullSafe(F.col("_first.i")) & (F.col("_key") == F.col("_first.k")) & (F.col("_at") == F.col("_first.a"))
    return met.where(~first).select("_id", "_key", "_at", "_first")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = LINES, repeated: DataFrame | None = None) -> DataFrame:
    """``docs`` with the text that is left, and n_lines and n_removed; ``repeated``: their repeated windows, where these are known."""
    if repeated is None:
        repeated = repeated_windows(line_windows(docs, doc_id, text, n))
    gone = repeated.groupBy("_id", "_key").agg(F.collect_set("_at").alias("_gone"))
    gone = gone.withColumnsRenamed({"_id": "_gone_id", "_key": "_gone_key"})
    keyed = docs.withColumn("_key", text_key(F.col(text)))
    met = keyed.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left")

    def left(split: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform("_gone", lambda k: F.array(*[k + j for j in range(n)]))))
        lost = let(_worded(split), lambda at: F.transform(covered, lambda k: F.get(at, k)))
        keep = F.array_except(upto(F.size(split)), lost)
        return F.struct(F.array_join(F.transform(keep, lambda i: F.get(split, i)), "\n").alias("t"), (F.size(split) - F.size(keep)).alias("n"))

    split = F.split(whole(F.col(text)), "\n")
    done = met.withColumn("_left", F.when(F.col("_gone").isNotNull(), let(split, left)))
    n_lines = F.size(split)
    return done.select(
        *[F.when(F.col("_left").isNull(), F.col(text)).otherwise(F.col("_left.t")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        n_lines.cast("long").alias("n_lines"), F.coalesce("_left.n", F.lit(0)).cast("long").alias("n_removed"),
    )
