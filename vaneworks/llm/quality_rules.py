"""Quality rules: figures of each text, and the frequency of its lines across the documents of its host.

A line is compared lower-cased, with white space runs as one space and digits as 0. For each host it is counted in how
many different texts it stands; copies of a whole text count once. Lines in more texts than the limit are boilerplate and
are removed wherever they stand; with ``keep_first`` they stay where they stand first (smallest doc_id of the host), so
that of a group of near copies one document stays whole. A document that loses more than ``MAX_REMOVED_PERCENT`` of its
words is rejected.

Rows: nulls in ``text`` are empty texts, nulls in ``host`` are a host of their own, a null ``doc_id`` comes before all
others. Rows with equal doc_id and equal text are the same document, rows with equal doc_id and other text are not.
Further columns are left alone. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.common import SPACES, has_word, let, text_key, upto, whole, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A line may stand in that many texts of a host at least, and in this share (per thousand) of the host's texts.
MIN_LIMIT = 50
LIMIT_PER_MILLE = 5
MAX_REMOVED_PERCENT = 70
SALTS = 16
_SYMBOLS = r"[^#*$%&|<>]+"


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in the same text."""

    def covered(found: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = F.filter(
                s,
                lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)),
            )
            starts = F.array_sort(F.transform(same, lambda e: e["i"]))
            return let(starts, steps)

        def steps(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
            return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(pairs, of_sorted))

    def windows(h: Column) -> Column:
        return F.transform(upto(F.size(h) - (window - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    named = {"_tokens": words(F.col(text)), "_lines": F.filter(F.split(whole(F.col(text)), "\n"), has_word)}
    figures = {
        "n_words": F.size("_tokens").cast("long"),
        "word_chars": F.length(F.regexp_replace(whole(F.col(text)), SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole(F.col(text)), _SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_tokens")).cast("long"),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*figures, "base_failed")]
    out = docs.select(*kept, *[v.alias(k) for k, v in named.items()]).select(*kept, *[v.alias(k) for k, v in figures.items()])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per line that has a word: _id, _key, _host, _pos, _line (64 bits of the normalised line), _n (its words)."""
    rows = docs.select(
        F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), F.col(host).cast("string").alias("_host"),
        F.posexplode(F.split(whole(F.col(text)), "\n")).alias("_pos", "_raw"),
    ).where(has_word(F.col("_raw")))
    norm = F.regexp_replace(F.trim(F.regexp_replace(F.lower("_raw"), SPACES, " ")), "[0-9]", "0")
    return rows.select("_id", "_key", "_host", "_pos", norm.alias("_norm")).select(
        "_id", "_key", "_host", "_pos", F.xxhash64("_norm").alias("_line"),
        (F.length("_norm") - F.length(F.translate("_norm", " ", "")) + 1).cast("long").alias("_n"),
    )


def frequent_lines(lines: DataFrame, min_limit: int = MIN_LIMIT, per_mille: int = LIMIT_PER_MILLE) -> DataFrame:
    """The lines above the limit of their host: _host, _line, _texts, _first_id, _first_key (where ``keep_first`` lets the line stay)."""
    once = lines.groupBy("_host", "_line", "_key").agg(F.min("_id").alias("_id"), F.max(F.col("_id").isNull()).alias("_no_id"))
    first = F.min(F.struct(F.when(F.col("_no_id"), None).otherwise(F.col("_id")).alias("i"), F.col("_key").alias("k")))
    counts = once.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_texts"), first.alias("_first"))
    counts = counts.where(F.col("_texts") > min_limit)
    hosts = lines.select("_host", "_key").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_all")).withColumnRenamed("_host", "_of")
    return (
        counts.join(hosts, F.col("_host").eqNullSafe(F.col("_of")))
        .where(1000 * F.col("_texts") > per_mille * F.col("_all"))
        .select("_host", "_line", "_texts", F.col("_first.i").alias("_first_id"), F.col("_first.k").alias("_first_key"))
    )


def removed_lines(lines: DataFrame, frequent: DataFrame, keep_first: bool = False) -> DataFrame:
    """Per document with a line to remove: _id, _key, _gone (line positions), _gone_words. Rows of a hot line meet their limit in ``SALTS`` parts."""
    spread = lines.withColumn("_salt", F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int"))
    copies = frequent.select(
        F.col("_host").alias("_h2"), F.col("_line").alias("_l2"), "_first_id", "_first_key",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s2"),
    )
    met = spread.join(copies, F.col("_host").eqNullSafe(F.col("_h2")) & (F.col("_line") == F.col("_l2")) & (F.col("_salt") == F.col("_s2")))
    if keep_first:
        met = met.where(~(F.col("_id").eqNullSafe(F.col("_first_id")) & (F.col("_key") == F.col("_first_key"))))
    once = met.groupBy("_id", "_key", "_pos").agg(F.max("_n").alias("_n"))
    return once.groupBy("_id", "_key").agg(F.collect_list("_pos").alias("_gone"), F.sum("_n").alias("_gone_words"))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", keep_text: bool = False, keep_first: bool = False, **limits) -> DataFrame:
    """``docs`` with the figures, ``removed_words`` and the verdict ``kept``; with ``keep_text`` also ``clean_text``, without removed lines."""
    lines = line_rows(docs, doc_id, text, host)
    gone = removed_lines(lines, frequent_lines(lines, **limits), keep_first)
    gone = gone.withColumnsRenamed({"_id": "_gone_id", "_key": "_gone_key"})
    base = base_rules(docs.withColumn("_key", text_key(F.col(text))), text)
    if not keep_text:
        base = base.drop(text)
    met = base.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left")
    out = met.withColumn("removed_words", F.coalesce("_gone_words", F.lit(0)).cast("long"))
    depleted = 100 * F.col("removed_words") > MAX_REMOVED_PERCENT * F.col("n_words")
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted)
    if keep_text:
        split = F.split(whole(F.col(text)), "\n")
        rest = let(split, lambda s: F.array_join(F.transform(F.array_except(upto(F.size(s)), F.col("_gone")), lambda i: F.get(s, i)), "\n"))
        out = out.withColumn("clean_text", F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rest))
    return out.drop("_key", "_gone_id", "_gone_key", "_gone", "_gone_words")
