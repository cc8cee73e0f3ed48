"""The driver contract, and the cheap queries against their SQL twins."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import oracle_queries
from check_parity import compare

ROWS_ONLY = {"boosted_scores", "early_stopping", "boosted_importance", "cv_report", "scored_submission"}
# queries of optional modules have tests of their own
OWN = oracle_queries.all_queries()


@pytest.fixture(scope="module")
def duck(tiny_dir):
    connection = duckdb.connect()
    for path in sorted(Path(tiny_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_a_twin_or_is_listed():
    optional = contract.llm_queries.queries() if contract.llm_queries else {}
    assert set(contract.queries()) - set(optional) == set(OWN) | ROWS_ONLY


@pytest.mark.parametrize("name", sorted(OWN))
def test_parity(spark, duck, tiny_dir, name):
    result = contract.queries()[name](spark, tiny_dir).toPandas()
    assert compare(result, duck.execute(OWN[name]).df()) == "ok"


def test_entry(spark):
    df = contract.entry(spark)
    assert len(df.columns) == 104 and df.count() == 200


def test_cross_validation_gets_every_feature(spark, tiny_dir, monkeypatch):
    """Both vectorizers reach the models, under the production cap; only rounds are fewer."""
    asked = {}

    def caught(prepare, folds, learners, **settings):
        asked.update(settings, folds=list(folds), learners=[x.name for x in learners], names=prepare(0)[1])

    monkeypatch.setattr(contract.training, "cross_validate", caught)
    contract._cross_validated(spark, tiny_dir)
    blocks = {name.rsplit("_", 1)[0] for name in asked["names"][len(contract.features.ESSAY_FEATURES) :]}
    assert blocks == {"tfid", "tfid_cnt"}
    assert (asked["folds"], asked["learners"]) == ([0, 1, 2, 3, 4], ["first", "second"])
    assert set(asked) <= {"folds", "learners", "names", "selection_rounds", "parallelism"}
