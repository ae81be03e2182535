"""Scoring with fitted models and merging scores of several models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.columns import ID_COL, LABEL_COL, MATCH_COL, log10_score, require_new_column
from twinfold.operators.cohort import union_all
from twinfold.operators.clustering import assemble
from twinfold.operators.fits import FittedLinear
from twinfold.operators.ranking import exact_percentile

SCORE_COL = "prob_1"
VALUES = "_values"


def score_with(df: DataFrame, model: Model | FittedLinear, score_col: str = SCORE_COL) -> DataFrame:
    """Append the positive probability of a fitted classifier; its other output columns are dropped."""
    if isinstance(model, FittedLinear):
        return score_linear(df, {score_col: model})
    outputs = [model.getRawPredictionCol(), model.getProbabilityCol(), model.getPredictionCol()]
    scored = model.transform(df)
    return scored.withColumn(score_col, vector_to_array(F.col(model.getProbabilityCol()))[1]).drop(*outputs)


def score_linear(df: DataFrame, models: Mapping[str, FittedLinear], score: Callable[..., Column] = FittedLinear.probability) -> DataFrame:
    """Append a column per linear model of one vector column: its positive probability, or another ``score`` of it."""
    require_new_column(df, VALUES, *models)
    (features,) = {m.features_col for m in models.values()}
    values = df.withColumn(VALUES, vector_to_array(F.col(features)))
    return values.select(*df.columns, *[score(m, VALUES).alias(name) for name, m in models.items()])


def score_with_all(
    df: DataFrame, models: Sequence[Model | FittedLinear], prefix: str = "_score_"
) -> tuple[DataFrame, list[str]]:
    """Append one score column per model in a single pass over the rows."""
    names = [f"{prefix}{i}" for i in range(len(models))]
    if models and all(isinstance(m, FittedLinear) for m in models):
        return score_linear(df, dict(zip(names, models))), names
    columns = df.columns
    for i, model in enumerate(models):
        score = vector_to_array(F.col(model.getProbabilityCol()))[1].alias(names[i])
        df = model.transform(df).select(*columns, *names[:i], score)
    return df, names


def mean_score(df: DataFrame, models: Sequence[Model | FittedLinear], score_col: str = "avg_prob") -> DataFrame:
    """Mean positive probability over several models: the row-wise form of :func:`average_scores`."""
    scored, names = score_with_all(df, models)
    return scored.withColumn(score_col, reduce(add, [F.col(n) for n in names]) / len(names)).drop(*names)


def union_scores(tables: Mapping[int, DataFrame] | Sequence[DataFrame], model_col: str | None = None) -> DataFrame:
    """Bag union of score tables, optionally with the number of the table as a column."""
    items = list(tables.items()) if isinstance(tables, Mapping) else list(enumerate(tables))
    if model_col is None:
        return union_all([t for _, t in items])
    return union_all([t.withColumn(model_col, F.lit(i)) for i, t in items])


def average_scores(
    stacked: DataFrame,
    n_models: int,
    model_col: str = "model_id",
    id_col: str = ID_COL,
    label_col: str = LABEL_COL,
    score_col: str = SCORE_COL,
) -> DataFrame:
    """Mean score per row over ``n_models`` stacked score tables (one row per id in each).

    Ids missing from any of the tables are left out, as by joining the tables, but with one
    shuffle instead of one per table.
    """
    return (
        stacked.groupBy(id_col)
        .agg(
            F.max(F.when(F.col(model_col) == 0, F.col(label_col))).alias(label_col),
            F.avg(score_col).alias("avg_prob"),
            F.count(score_col).alias("_n"),
        )
        .filter(F.col("_n") == n_models)
        .drop("_n")
    )


def positive_score_cut(
    scored: DataFrame, share: float = 0.75, score_col: str = SCORE_COL, label_col: str = LABEL_COL
) -> float | None:
    """Exact percentile of the positives' scores."""
    return exact_percentile(scored.filter(F.col(label_col) == 1), score_col, share)


def second_stage_rows(
    scored: DataFrame, cut: float, score_col: str = SCORE_COL, log_col: str = "logprob_1"
) -> DataFrame:
    """Rows with a first-stage score of at least ``cut``, with log10 of the score appended."""
    return scored.filter(F.col(score_col) >= cut).withColumn(log_col, log10_score(F.col(score_col)))


def second_stage_features(
    scored: DataFrame,
    cut: float,
    score_col: str = SCORE_COL,
    features_col: str = "features",
    log_col: str = "logprob_1",
    keep: Sequence[str] = (MATCH_COL, ID_COL, LABEL_COL),
) -> DataFrame:
    """Second-stage table: the score's logarithm becomes the last feature."""
    rows = second_stage_rows(scored, cut, score_col, log_col).withColumnRenamed(features_col, "features1")
    return assemble(rows, ["features1", log_col], features_col, keep=keep)
