"""The test tables in the roles of essays, word list, score pairs and model outputs.

See FIXTURES.md. Every function reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.functions import scoring, text
from gradeframe.operators import boosting, ensemble, vectors
from gradeframe.sources import tables

# ``documents`` has no blank lines, so its paragraphs are its lines.
SEPARATOR = "\n"
#: Ten models of six classes read 60 of the 64 values of an embedding; the last four do not divide.
N_MODELS = 10
N_CLASSES = 6
BOOSTING_FEATURES = ["l_linenumber", "l_quantity", "l_extendedprice"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.least(F.lit(6), F.floor(F.col("n_chars") / 700) + 1).cast("int")
    return _read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("essay_id"), F.col("text").alias("full_text"), score.alias("score")
    )


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` scored 1 to 6 by their length."""
    return tables.spread(_documents(spark, sf_dir))


def essay_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays without their text, for numbering and class counts."""
    return _documents(spark, sf_dir).select("essay_id", "score")


def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of ``benchmark``, standing in for a dictionary file."""
    bare = text.strip_punct(text.clean(F.col("text")))
    lines = _read(spark, sf_dir, "benchmark").select(F.explode(text.split_on(bare, " ")).alias("value"))
    return tables.distinct_words(lines.where("value <> ''"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", "html")


def _line_id() -> list:
    quantity = F.col("l_quantity").cast("int")  # two lines of the smallest table differ in it alone
    return [F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity).alias("essay_id")]


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(essay_id, fold, y, raw, p)``: true score, raw prediction, rounded prediction."""
    raw = F.lit(1.0) + F.col("l_quantity") / 9
    return _read(spark, sf_dir, "lineitem").select(
        *_line_id(),
        F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"),
        F.least(F.lit(6), F.col("l_linenumber")).alias("y"),
        raw.alias("raw"),
        scoring.clip_round(raw).alias("p"),
    )


def continuous_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(essay_id, y, p)`` with predictions that leave the score range on both sides."""
    return _read(spark, sf_dir, "lineitem").select(
        *_line_id(),
        F.least(F.lit(6), F.col("l_linenumber")).cast("double").alias("y"),
        (F.col("l_quantity") / 7).alias("p"),
    )


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(essay_id, fold, y_pred)``: five centred predictions per row."""
    lines = _read(spark, sf_dir, "lineitem").select(
        *_line_id(), "l_quantity", "l_discount", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")
    )
    shift = (F.col("fold") - 2) * F.col("l_discount")
    return lines.select("essay_id", "fold", (F.col("l_quantity") / 9 - 2 + shift).alias("y_pred"))


def learner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(essay_id, first, second)``: predictions of two learners."""
    return _read(spark, sf_dir, "lineitem").select(
        *_line_id(), (F.col("l_quantity") / 9).alias("first"), F.col("l_linenumber").cast("double").alias("second")
    )


def model_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(essay_id, model, probs)``: softmax of the slices of ``embeddings``."""
    start = F.col("model") * N_CLASSES + 1
    logits = (
        _read(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").alias("essay_id"),
            "embedding",
            F.explode(F.sequence(F.lit(0), F.lit(N_MODELS - 1))).alias("model"),
        )
        .select("essay_id", "model", F.slice("embedding", start, F.lit(N_CLASSES)).alias("logits"))
    )
    return ensemble.softmax_probs(logits)


def boosting_rows(spark: SparkSession, sf_dir: str, names: list[str] = BOOSTING_FEATURES) -> DataFrame:
    """``(essay_id, score, features)``: a small learnable problem on ``lineitem``."""
    rows = _read(spark, sf_dir, "lineitem").select(
        *_line_id(),
        scoring.clip_round(F.col("l_quantity") / 9).alias("score"),
        *[F.col(c).cast("double").alias(c) for c in names],
    )
    return vectors.dense_vectors(rows, names, ["essay_id", "score"])


def round_predictions(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    """``(round, y, p)``: predictions that come nearer to the truth up to the third round."""
    off = (F.col("round") - 3) * (F.col("round") - 3) * F.pmod("l_orderkey", F.lit(3)) / 3
    return (
        _read(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_quantity", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
        .select(
            "round",
            scoring.clip_round(F.col("l_quantity") / 9).alias("y"),
            scoring.clip_round(F.col("l_quantity") / 9 + off).alias("p"),
        )
    )


def fixed_forests() -> list[boosting.Forest]:
    """Two small forests over ``BOOSTING_FEATURES``, as loaded from a store."""
    node = boosting.Node
    first = [node(1, 20.0, 1, 2), node(value=-0.5), node(0, 3.0, 3, 4), node(value=0.25), node(value=0.75)]
    second = [node(2, 30000.0, 1, 2), node(value=0.125), node(value=-0.25)]
    third = [node(1, 35.5, 1, 2), node(value=-1.0), node(value=1.5)]
    return [boosting.Forest("first", [first, second]), boosting.Forest("second", [third])]
