"""The call signatures that existing jobs use, on top of this library's operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from twinfold.operators.crossval import FoldCrossValidator as CrossValidatorWithStratificationID
from twinfold.operators.evaluator import PrecisionRecallEvaluator as BinaryClassificationEvaluatorWithPrecisionAtRecall
from twinfold.operators.folds import assign_folds

__all__ = [
    "AppendDataMatchingFoldIDs",
    "BinaryClassificationEvaluatorWithPrecisionAtRecall",
    "CrossValidatorWithStratificationID",
]


def AppendDataMatchingFoldIDs(
    data: DataFrame,
    nFolds: int,
    matchCol: str,
    foldCol: str = "foldID",
    colsToKeep: Sequence[str] | None = None,
    nDesiredPartitions: int | None = None,
) -> DataFrame:
    """:func:`twinfold.operators.folds.assign_folds` under its older argument names."""
    return assign_folds(data, nFolds, matchCol, foldCol, colsToKeep, nDesiredPartitions)
