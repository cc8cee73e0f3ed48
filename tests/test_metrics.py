import math
import random

import pytest
from pyspark.sql import functions as F

import plain
from gradeframe.functions import scoring
from gradeframe.operators import boosting, ensemble, metrics, objective


def _pairs(spark, y, p, fold=None):
    fold = fold or [0] * len(y)
    return spark.createDataFrame(list(zip(fold, y, p)), "fold int, y int, p int")


def _random_labels(seed, labels, n=200):
    pick = random.Random(seed)
    y = [pick.choice(labels) for _ in range(n)]
    return y, [v if pick.random() < 0.5 else pick.choice(labels) for v in y]


@pytest.mark.parametrize("labels", [[1, 2, 3, 4, 5, 6], [1, 2, 5], [0, 1], [2, 6]])
def test_kappa_and_f1_match_plain(spark, labels):
    y, p = _random_labels(len(labels), labels)
    confusion = metrics.confusion_matrix(_pairs(spark, y, p))
    assert math.isclose(metrics.quadratic_weighted_kappa(confusion).first()["qwk"], plain.kappa(y, p))
    assert math.isclose(metrics.weighted_f1(confusion).first()["f1"], plain.weighted_f1(y, p))
    counts = {(r["y"], r["p"]): r["n"] for r in confusion.collect()}
    assert math.isclose(boosting.kappa_of_counts(counts), plain.kappa(y, p))


def test_kappa_uses_label_ranks(spark):
    """With 3 and 4 unused, 2 and 5 are neighbours."""
    y, p = [1, 2, 5, 5, 2, 1], [1, 5, 5, 2, 2, 2]
    confusion = metrics.confusion_matrix(_pairs(spark, y, p))
    assert math.isclose(metrics.quadratic_weighted_kappa(confusion).first()["qwk"], plain.kappa(y, p))
    as_ranks = {1: 1, 2: 2, 5: 3}
    moment = _pairs(spark, [as_ranks[v] for v in y], [as_ranks[v] for v in p]).agg(
        metrics.qwk_moment(F.col("y"), F.col("p")).alias("qwk")
    )
    assert math.isclose(moment.first()["qwk"], plain.kappa(y, p))


def test_kappa_of_identical_and_constant_labels(spark):
    same = metrics.confusion_matrix(_pairs(spark, [1, 2, 3], [1, 2, 3]))
    assert metrics.quadratic_weighted_kappa(same).first()["qwk"] == 1.0
    constant = metrics.confusion_matrix(_pairs(spark, [2, 2], [2, 2]))
    assert metrics.quadratic_weighted_kappa(constant).first()["qwk"] is None


def test_fold_report(spark):
    y, p = _random_labels(3, [1, 2, 3, 4])
    fold = [i % 3 for i in range(len(y))]
    report = {(r["scope"], r["fold"]): r for r in metrics.fold_report(_pairs(spark, y, p, fold)).collect()}
    per_fold = [([a for a, f in zip(y, fold) if f == i], [b for b, f in zip(p, fold) if f == i]) for i in range(3)]
    for i, (a, b) in enumerate(per_fold):
        assert math.isclose(report["fold", i]["qwk"], plain.kappa(a, b))
        assert math.isclose(report["fold", i]["f1"], plain.weighted_f1(a, b))
    assert math.isclose(report["mean", -1]["qwk"], sum(plain.kappa(a, b) for a, b in per_fold) / 3)
    assert math.isclose(report["pooled", -1]["f1"], plain.weighted_f1(y, p))


def test_gradient_matches_plain(spark):
    pick = random.Random(1)
    y = [float(pick.randint(1, 6)) for _ in range(50)]
    p = [pick.uniform(-1, 8) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(zip(y, p))), "i int, v struct<y double, p double>").select("i", "v.*")
    rows = objective.with_gradient(df).orderBy("i").collect()
    assert all(math.isclose(r["grad"], g, rel_tol=1e-9) for r, g in zip(rows, plain.gradient(y, p)))
    assert {r["hess"] for r in rows} == {1.0}


def test_gradient_is_the_derivative(spark):
    """Finite differences of n * error / spread, for predictions inside the range."""
    y, p = [1.0, 3.0, 6.0, 2.0], [1.5, 3.2, 4.9, 2.2]

    def loss(values):
        f = sum((a - b) ** 2 for a, b in zip(values, y)) / 2
        g = sum((a - 2.998) ** 2 + 1.092 for a in values) / 2
        return len(y) * f / g

    for i, g in enumerate(plain.gradient(y, p)):
        up, down = p.copy(), p.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert math.isclose((loss(up) - loss(down)) / 2e-6, g, rel_tol=1e-5)


def test_clip_round_is_half_to_even(spark):
    values = [0.2, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    out = [r["s"] for r in df.select("i", scoring.clip_round(F.col("v")).alias("s")).orderBy("i").collect()]
    assert out == [1, 2, 2, 4, 4, 6, 6, 6]


def test_softmax_and_probability_mean(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0, 1000.0]), (1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])], "essay_id int, logits array<double>"
    )
    probs = ensemble.softmax_probs(df)
    assert all(math.isclose(sum(r["probs"]), 1.0) for r in probs.collect())
    mean = {r["essay_id"]: r["probs"] for r in ensemble.prob_ensemble(probs).collect()}
    assert [round(v, 9) for v in mean[1]] == [round(v, 9) for v in (1 / 6, 1 / 6, 2 / 3)]
    eight = spark.createDataFrame([(1, [0.125] * 8)], "essay_id int, probs array<double>")
    assert ensemble.prob_ensemble(eight).first()["probs"] == [0.125] * 8


def test_blend_and_submission(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "essay_id int, a double, b double")
    assert math.isclose(df.select(scoring.blend(F.col("a"), F.col("b")).alias("s")).first()["s"], 1.24)
    folds = spark.createDataFrame([(1, 0, -5.0), (1, 1, -4.0), (2, 0, 1.0), (2, 1, 2.0)], "essay_id int, fold int, y_pred double")
    assert {r["essay_id"]: r["score"] for r in ensemble.submission(folds).collect()} == {1: 1, 2: 4}
