"""The corpus pipeline: stages over ``documents``, each one an operator of ``gradeframe.llm``.

Every stage works on all rows its predecessor kept. All but the last return the columns of
``documents``: toxic documents go, one document of each near-duplicate group stays,
documents that hold a benchmark window go, and secrets are masked in the text. The last
one packs the tokens of what is left.

Null and empty texts are not toxic, hold no benchmark window and no secret; the near-dedup stage links all texts
without words, so one of them stays. Rows with a null id pass like any other. Repeated rows are near copies of each
other. Columns beyond those of ``documents``, whatever their names, stay up to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeframe.llm import decontamination, packing, secrets, simhash, toxicity
from gradeframe.session import materialize, share_code


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels, categories = toxicity.document_labels(_table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, docs, labels, categories)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: No stage is one SQL statement; the tests compare each one with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written and read again as the next one's documents."""
    share_code(spark)
    rows = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = stage(spark, rows, sf_dir)
        if name != STAGES[-1][0]:
            rows = materialize(rows)
    return rows
