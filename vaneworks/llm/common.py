"""What the operators of this folder share: word splitting, small array helpers, tables written between steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a class of a regular expression (same meaning in Java, Python and SQL engines).
SPACES = r"[\x20\x09-\x0D]+"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TRIMMED = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order: runs of other characters than ``SPACES``."""
    bare = F.regexp_replace(whole(text), _TRIMMED, "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body (or a lambda in it) reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """The integers 0 ... n-1, an empty array for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def text_key(text: Column) -> Column:
    """64 bits that tell the texts of rows with one id apart."""
    return F.xxhash64(whole(text))


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: so few rows that a worker's memory does not follow from the default of 10,000.

    A number that the session has been given is left as it is.
    """
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, lost executors repeat nothing before it."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    shared = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm/" in folder and folder.split("/llm/")[0].split(":")[-1].lstrip("/") == shared.split(":")[-1].lstrip("/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
