"""Connected components of links between integer ids, by alternating star steps.

Every node points to the smallest neighbour it knows; a large-star step links the larger
neighbours of a node to that smallest one, a small-star step the smaller ones. Links never
grow in number, and the steps needed grow with the logarithm of a component's size. Each
round is written to the shared folder, so that lineage stays short when executors are lost.

Links to itself or with a null end say nothing, repeated links count once. Without links there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links ``(a, b)`` with ``a > b`` after one star step."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    seen = both.join(least, "a")
    if large:
        made = seen.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return made.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every id in ``links`` (``a, b``); the component is its smallest id."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(ordered.filter(F.col("a") != F.col("b")).distinct())
    mark = None
    while True:
        now = materialize(_star(_star(now, large=True), large=False))
        # links only ever move to smaller ends: equal sums mean equal links
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast(T.DecimalType(38, 0)))).first()
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
