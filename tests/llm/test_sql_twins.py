"""The registered queries that have a SQL twin, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from check_parity import compare
from gradeframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, tiny_dir, name):
    duck = duckdb.connect()
    for path in Path(tiny_dir).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = queries.queries()[name](spark, tiny_dir).toPandas()
    assert compare(found, duck.execute(queries.oracle_sql()[name]).df()) == "ok"


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in queries.queries()} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
