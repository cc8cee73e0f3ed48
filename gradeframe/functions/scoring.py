"""Numeric expressions on scores, targets and class logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeframe.constants import BLEND_WEIGHTS, SCORE_CENTRE, SCORE_MAX, SCORE_MIN


def clip(score: Column) -> Column:
    return F.least(F.lit(float(SCORE_MAX)), F.greatest(F.lit(float(SCORE_MIN)), score))


def clip_round(score: Column) -> Column:
    """Clip to the score range and round half to even."""
    return F.rint(clip(score)).cast("int")


def centred(score: Column) -> Column:
    return score.cast("double") - F.lit(SCORE_CENTRE)


def uncentred(score: Column) -> Column:
    return score + F.lit(SCORE_CENTRE)


def blend(first: Column, second: Column) -> Column:
    return F.lit(BLEND_WEIGHTS[0]) * first + F.lit(BLEND_WEIGHTS[1]) * second
