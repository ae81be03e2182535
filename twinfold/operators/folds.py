"""Fold assignment that keeps every match group together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.columns import MATCH_COL, require_new_column
from twinfold.operators.ranking import hash_rank, with_row_index


def fold_table(
    ids: DataFrame, n_folds: int, match_col: str = MATCH_COL, fold_col: str = "foldID", seed: int = 42
) -> DataFrame:
    """One row per distinct match id with a fold id 0..n_folds-1; fold sizes differ by at most one."""
    if n_folds < 1:
        raise ValueError("n_folds must be at least 1")
    distinct = ids.select(match_col).filter(F.col(match_col).isNotNull()).distinct()
    ranked = hash_rank(distinct, match_col, seed, rank_col="_fold_rank")
    return ranked.select(match_col, F.pmod("_fold_rank", F.lit(n_folds)).cast("int").alias(fold_col))


def assign_folds(
    data: DataFrame,
    n_folds: int,
    match_col: str = MATCH_COL,
    fold_col: str = "foldID",
    cols_to_keep: Sequence[str] | None = None,
    n_partitions: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Append balanced, seeded fold ids; all rows of a match group get the same one.

    ``cols_to_keep`` keeps those columns and the match column, in their order in the data. Rows
    without a match id belong to no group and are left out, as by an inner join.
    """
    if cols_to_keep is not None:
        wanted = {*cols_to_keep, match_col}
        data = data.select([c for c in data.columns if c in wanted])
    require_new_column(data, fold_col)
    tagged = attach_folds(data, fold_table(data, n_folds, match_col, fold_col, seed), match_col)
    return tagged.coalesce(n_partitions) if n_partitions else tagged


def attach_folds(data: DataFrame, folds: DataFrame, match_col: str = MATCH_COL) -> DataFrame:
    """Join a fold table to the data.

    Left to Spark: it broadcasts the fold table when that is small enough, and otherwise splits
    the partition of a very large match group at run time.
    """
    return data.join(folds, match_col)


def round_robin_folds(
    data: DataFrame, n_folds: int, order_by: Sequence[str], fold_col: str = "foldID", row_key: Sequence[str] | None = None
) -> DataFrame:
    """Fold id of a row is its place in sort order modulo ``n_folds``; match groups are not kept together.

    With ``row_key``, columns that tell the rows apart, only keys are sorted (see :func:`with_row_index`).
    """
    require_new_column(data, fold_col)
    indexed = with_row_index(data, order_by, "_row_index", row_key)
    return indexed.withColumn(fold_col, F.pmod("_row_index", F.lit(n_folds)).cast("int")).drop("_row_index")


def validate_folds(data: DataFrame, fold_col: str = "foldID") -> int:
    """Number of folds; ids must be the integers 0..n-1, each of them present, none NULL."""
    kind = data.schema[fold_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"fold column {fold_col!r} must be an integer column, not {kind.simpleString()}")
    c = F.col(fold_col)
    seen = (
        data.groupBy(fold_col)
        .count()
        .agg(
            F.min(c).alias("low"),
            F.max(c).alias("high"),
            F.count(c).alias("n"),
            F.count(F.when(c.isNull(), 1)).alias("nulls"),
        )
        .first()
    )
    if seen.n == 0 or seen.nulls or seen.low != 0 or seen.high != seen.n - 1:
        raise ValueError(f"fold column {fold_col!r} must hold zero-based consecutive integers in every row")
    return seen.n


def held_out(data: DataFrame, fold: int, fold_col: str = "foldID") -> DataFrame:
    """Rows of one fold, without the fold column."""
    return data.filter(F.col(fold_col) == fold).drop(fold_col)


def remaining(data: DataFrame, fold: int, fold_col: str = "foldID") -> DataFrame:
    """Rows of all other folds, without the fold column."""
    return data.filter(F.col(fold_col) != fold).drop(fold_col)


def fold_summary(data: DataFrame, match_col: str = MATCH_COL, fold_col: str = "foldID") -> DataFrame:
    """Match groups, rows and cases per fold, and the number of groups found in more than one fold.

    Rows are first reduced to one per (group, fold), so no group is counted in one task.
    """
    per_group = data.groupBy(match_col, fold_col).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.col("label").cast("bigint")).alias("_cases")
    )
    return per_group.groupBy(fold_col).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("_rows").alias("n_rows"), F.sum("_cases").alias("n_cases")
    )
