"""Scans and sinks.

Essays arrive as CSV (quoted, with newlines inside the text); everything between
the stages is Parquet with a declared schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, ArrayType, IntegerType, StringType, StructField, StructType

from gradeframe.constants import PARAGRAPH_SEPARATOR
from gradeframe.functions import text

ESSAY_SCHEMA = StructType(
    [StructField("essay_id", StringType()), StructField("full_text", StringType()), StructField("score", IntegerType())]
)
TEST_SCHEMA = StructType(ESSAY_SCHEMA.fields[:2])
#: Scans of fewer bytes for each core are dealt out over all cores.
SMALL_SCAN = 16 << 20
PROBABILITY_SCHEMA = StructType(
    [StructField("essay_id", StringType()), StructField("probs", ArrayType(DoubleType()))]
)


def read_essays(spark: SparkSession, path: str, scored: bool = True) -> DataFrame:
    """Essay CSV with a header; texts may hold newlines and doubled quotes. A file is one task: write large corpora in many."""
    schema = ESSAY_SCHEMA if scored else TEST_SCHEMA
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def spread(scan: DataFrame) -> DataFrame:
    """``scan`` dealt out over all cores if it is so small that its files may be fewer tasks than those.

    A file of one row group is one task, whatever it holds. Large scans have tasks enough and are left as they are,
    so nothing above ``SMALL_SCAN`` bytes a core is ever shuffled for it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(cores) if size < cores * SMALL_SCAN else scan


def with_paragraphs(essays: DataFrame, separator: str = PARAGRAPH_SEPARATOR) -> DataFrame:
    return essays.withColumn("paragraph", text.split_on(F.col("full_text"), separator))


def distinct_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed, lowercased, distinct words of a one-word-per-row column; blanks inside stay."""
    blank = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
    word: Column = F.lower(F.regexp_replace(column, f"^{blank}|{blank}$", ""))
    return lines.select(word.alias("word")).distinct()


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return distinct_words(spark.read.text(path))


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """Out-of-fold class probabilities made beforehand by another model."""
    return spark.read.schema(PROBABILITY_SCHEMA).parquet(path)


def attach_probabilities(features: DataFrame, probabilities: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Add one column per class, matched by ``essay_id``; the longest array tells their number."""
    if n_classes is None:
        n_classes = probabilities.agg(F.coalesce(F.max(F.size("probs")), F.lit(0))).first()[0]
    columns = [F.get("probs", F.lit(i)).alias(f"prob_{i}") for i in range(n_classes)]
    return features.join(probabilities.select("essay_id", *columns), "essay_id", "left")


def write_mart(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def write_by_fold(table: DataFrame, path: str) -> None:
    """One table with a folder per fold: fold i trains on ``fold <> i``.

    Every essay is stored once instead of once per fold and side.
    """
    table.write.mode("overwrite").partitionBy("fold").parquet(path)


def read_fold(spark: SparkSession, path: str, fold: int, held_out: bool) -> DataFrame:
    """Held-out or training side of a fold, by partition pruning."""
    side = F.col("fold") == fold if held_out else F.col("fold") != fold
    return spark.read.parquet(path).where(side)


def write_table(table: DataFrame, path: str) -> None:
    """Fitted vocabularies and ranked feature lists."""
    table.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_submission(scores: DataFrame, path: str) -> None:
    scores.select("essay_id", "score").write.mode("overwrite").csv(path, header=True)
