from pathlib import Path

import pytest

from gradeframe.operators import splits
from gradeframe.session import materialize, release, shared_dir, stored_tables
from gradeframe.sources import tables


def test_essay_csv_with_newlines_and_quotes(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text('essay_id,full_text,score\na1,"He said ""hi"".\n\nThen, left.",3\nb2,plain,6\n')
    rows = tables.with_paragraphs(tables.read_essays(spark, str(path))).orderBy("essay_id").collect()
    assert rows[0]["full_text"] == 'He said "hi".\n\nThen, left.'
    assert rows[0]["paragraph"] == ['He said "hi".', "Then, left."] and rows[0]["score"] == 3
    assert rows[1]["score"] == 6


def test_unscored_essays(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text("essay_id,full_text\nx,words here\n")
    assert tables.read_essays(spark, str(path), scored=False).columns == ["essay_id", "full_text"]


def test_vocabulary_is_trimmed_lowercased_and_distinct(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text(" Apple\napple\npear \n\na\t  b \n")
    assert {r["word"] for r in tables.read_vocabulary(spark, str(path)).collect()} == {"apple", "pear", "", "a\t  b"}


def test_probabilities_join_by_id(spark, tmp_path):
    path = str(tmp_path / "oof")
    tables.write_mart(
        spark.createDataFrame([("b", [0.1, 0.9]), ("a", [0.7, 0.3])], "essay_id string, probs array<double>"), path
    )
    features = spark.createDataFrame([("a",), ("b",), ("c",)], "essay_id string")
    joined = tables.attach_probabilities(features, tables.read_probabilities(spark, path))
    rows = {r["essay_id"]: (r["prob_0"], r["prob_1"]) for r in joined.collect()}
    assert rows == {"a": (0.7, 0.3), "b": (0.1, 0.9), "c": (None, None)}


def test_fold_table_stores_each_essay_once_and_prunes(spark, tmp_path):
    essays = spark.range(100).selectExpr("id AS essay_id", "CAST(id % 3 AS INT) AS score")
    path = str(tmp_path / "folds")
    tables.write_by_fold(splits.stratified_folds(essays), path)
    assert spark.read.parquet(path).count() == 100
    held_out, training = (tables.read_fold(spark, path, 1, side) for side in (True, False))
    assert held_out.count() + training.count() == 100
    assert "PartitionFilters: [isnotnull(fold" in held_out._jdf.queryExecution().executedPlan().toString()


def test_submission_file(spark, tmp_path):
    path = str(tmp_path / "submission")
    tables.write_submission(spark.createDataFrame([("a", 3)], "essay_id string, score int"), path)
    assert spark.read.csv(path, header=True).collect()[0].asDict() == {"essay_id": "a", "score": "3"}


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).selectExpr("id * 2 AS v")
    stored = materialize(df)
    assert sorted(r["v"] for r in stored.collect()) == list(range(0, 20, 2))
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        value = None

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.conf.value = "hdfs://x/checkpoints"
    assert shared_dir(Session()) == "hdfs://x/checkpoints/gradeframe/app"


def stored(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_stored_tables_go_with_their_scope(spark):
    before = stored(spark)
    with pytest.raises(ZeroDivisionError), stored_tables(spark):
        materialize(spark.range(3))
        with stored_tables(spark):
            kept = materialize(spark.range(4), keep=True)
            materialize(spark.range(5))
        assert kept.count() == 4 and len(stored(spark) - before) == 2
        1 / 0
    assert stored(spark) == before
    table = materialize(spark.range(2))
    release(table)
    assert stored(spark) == before


def test_only_small_scans_are_spread(spark, tmp_path, monkeypatch):
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    dealt = tables.spread(scan)
    assert dealt.count() == 50 and dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SMALL_SCAN", 0)
    assert "Exchange" not in tables.spread(scan)._jdf.queryExecution().executedPlan().toString()
