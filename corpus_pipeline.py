"""The corpus pipeline: raw documents to packed training sequences, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaneworks.llm import decontaminate, line_dedup, packing, part_enum, quality_rules
from vaneworks.llm.common import has_word, stored, table, text_key
from vaneworks.llm.queries import tokenizer_path

ORACLE_SQL = None

#: Near copies in the stages: sets of five-word shingles with a similarity of 0.8 or more (op9's own limits are its defaults).
SHINGLE = 5
THRESHOLD = 80


def _as_documents(docs: DataFrame, df: DataFrame, text: str = "text"):
    """The columns of ``docs`` with the given text; n_chars follows it."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null, empty and short ones among them; the others lose the lines above the limits of their host.

    A null source is a host of its own; equal rows are judged alike and all stay.
    """
    judged = quality_rules.quality(docs, keep_text=True, keep_first=True).where("kept")
    return _as_documents(docs, judged, "clean_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and so does a document without a word left of what it had.

    What is left of a document stays, however little; whether that is a near copy is the next stage's question. A document
    that lost nothing stays as it is, a null or empty one too; equal rows are one document and lose the same.
    """
    left = line_dedup.line_dedup(docs).where((F.col("n_removed") == 0) | has_word(F.col("text")))
    return _as_documents(docs, left)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, once; documents without words are left to the next stage.

    A document is a doc_id with a text: of rows that repeat both one stays, and texts that share a doc_id are told apart.
    """
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    texts = keyed.select(F.struct("doc_id", F.col("_key").alias("key")).alias("id"), "text")
    found = part_enum.similarity_components(texts, "id", shingle=SHINGLE, threshold=THRESHOLD).where("id = component_id")
    stay = found.select(F.col("id.doc_id").alias("_stay"), F.col("id.key").alias("_as")).distinct()
    left = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay")) & (F.col("_key") == F.col("_as")), "left_semi")
    return left.dropDuplicates(["doc_id", "_key"]).drop("_key")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none. Rows with equal doc_id and text go together."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("_id", "_key").distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty text is one piece, its end mark."""
    return packing.best_two_fit(packing.token_pieces(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
