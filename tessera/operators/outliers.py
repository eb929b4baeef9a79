"""Rows held out of samples: those farthest from the mean, relative to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored(points: DataFrame, measures: list[str]) -> tuple[Column | None, int]:
    """The score of a row, none if no measure has a mean other than 0, and the number of rows."""
    stats = points.agg(F.count("*"), *[F.avg(m) for m in measures]).first()
    scores = [F.coalesce(F.pow((F.col(m) - mean) / mean, 2), F.lit(0.0)) for m, mean in zip(measures, stats[1:], strict=True) if mean]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0] if scores else None), stats[0]


def outliers(points: DataFrame, measures: list[str], share: float, row_id: str = "row_id") -> DataFrame:
    """row_id, score of the round(share * rows) rows with the largest max over measures of ((x - mean) / mean) ** 2 > 0."""
    score, rows = scored(points, measures)
    if score is None:
        return points.select(row_id, F.lit(0.0).alias("score")).limit(0)
    return points.select(row_id, score.alias("score")).where(F.col("score") > 0).orderBy(F.desc("score"), row_id).limit(int(share * rows + 0.5))


def held_out(points: DataFrame, measures: list[str], share: float, row_id: str = "row_id") -> Column:
    """Whether a row is among outliers(): a comparison with the last of them, so no join with their ids."""
    score, _ = scored(points, measures)
    last = None if score is None or share <= 0 else outliers(points, measures, share, row_id).orderBy("score", F.desc(row_id)).first()
    if last is None:
        return F.lit(False)
    return (score > last["score"]) | ((score == last["score"]) & (F.col(row_id) <= last[row_id]))
