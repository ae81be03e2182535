"""Selecting rows by their distance to a point or to a cluster centre."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.columns import (
    ID_COL,
    MATCH_COL,
    array_distance,
    euclidean_to,
    require_new_column,
    round_half_up,
)
from twinfold.operators.cohort import rows_of_cases, top_rows_of_cases
from twinfold.operators.ranking import smallest_fractions, top_n_per_group

DIST_COL = "dist"


def with_distance(
    df: DataFrame, columns: Sequence[str], centre: Sequence[float], dist_col: str = DIST_COL
) -> DataFrame:
    """Append the distance of the point ``columns`` to ``centre``."""
    require_new_column(df, dist_col)
    return df.withColumn(dist_col, euclidean_to(columns, centre))


def in_cluster_distance(
    columns: Sequence[str], cluster: Column, centres: Mapping[int, Sequence[float]]
) -> Column:
    """Distance to the centre of a row's own cluster, for a fixed handful of centres."""
    result = None
    for cluster_id, centre in centres.items():
        here = cluster == cluster_id
        d = euclidean_to(columns, centre)
        result = F.when(here, d) if result is None else result.when(here, d)
    return result


def with_in_cluster_distance(
    df: DataFrame,
    columns: Sequence[str],
    cluster_col: str,
    centres: Mapping[int, Sequence[float]],
    dist_col: str = DIST_COL,
) -> DataFrame:
    """Append the distance to the centre of each row's own cluster."""
    require_new_column(df, dist_col)
    return df.withColumn(dist_col, in_cluster_distance(columns, F.col(cluster_col), centres))


def nearest_centre(columns: Sequence[str], centres: Mapping[int, Sequence[float]]) -> Column:
    """Id of the nearest centre; the lowest id on ties."""
    options = [F.struct(euclidean_to(columns, c).alias("d"), F.lit(i).alias("id")) for i, c in centres.items()]
    return F.array_min(F.array(*options)).getField("id")


def array_centres(df: DataFrame, array_col: str, cluster_col: str, centre_col: str = "centre") -> DataFrame:
    """Mean point of every cluster of array rows: ``(cluster, centre)``, one row per cluster."""
    vectors = df.select(cluster_col, array_to_vector(F.col(array_col).cast("array<double>")).alias("_v"))
    means = vectors.groupBy(cluster_col).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(cluster_col, vector_to_array("_m").alias(centre_col))


def array_in_cluster_distance(
    df: DataFrame, array_col: str, cluster_col: str, centres: DataFrame, dist_col: str = DIST_COL
) -> DataFrame:
    """Append the distance of an array point to its cluster's centre, given as a table."""
    require_new_column(df, dist_col)
    joined = df.join(centres, cluster_col)
    return joined.withColumn(dist_col, array_distance(F.col(array_col), F.col("centre"))).drop("centre")


def cluster_shares(clustered: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Rows per cluster and their share of all rows."""
    counts = clustered.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())  # over one row per cluster
    return counts.withColumn("share", F.col("n_rows") / total)


def rows_per_group(
    df: DataFrame, share: float, match_col: str = MATCH_COL, cases: DataFrame | None = None
) -> int:
    """``round(rows / match groups * share)``, halves away from zero; only over the cases' groups when given."""
    groups = df.groupBy(match_col).agg(F.count(F.lit(1)).alias("n"))
    if cases is not None:
        groups = rows_of_cases(groups, cases, match_col)
    counts = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    return round_half_up(counts.rows / counts.groups * share) if counts.groups else 0


def nearest_per_group(
    df: DataFrame,
    columns: Sequence[str],
    centre: Sequence[float],
    share: float,
    match_col: str = MATCH_COL,
    id_col: str = ID_COL,
    dist_col: str = DIST_COL,
    cases: DataFrame | None = None,
) -> DataFrame:
    """Rows nearest to ``centre`` in each match group, with their distance.

    Every group keeps the same number: a ``share`` of the average group size. With ``cases`` only
    their match groups take part.
    """
    n = rows_per_group(df, share, match_col, cases)
    keyed = with_distance(df, columns, centre, dist_col)
    order = [dist_col, id_col]
    if cases is None:
        return top_n_per_group(keyed, n, match_col, order)
    return top_rows_of_cases(keyed, cases, n, match_col, order)


def nearest_overall_conditions(
    df: DataFrame,
    columns: Sequence[str],
    targets: Sequence[tuple[Sequence[float], float, str]],
    id_col: str = ID_COL,
    n_rows: int | None = None,
) -> list[Column]:
    """For each ``(centre, share, distance column)`` the condition on ``(distance, id)`` that holds for the given share
    of rows nearest to that centre. The cut-offs of all centres are found in the same passes."""
    require_new_column(df, *[name for _, _, name in targets])
    distances = [euclidean_to(columns, centre).alias(name) for centre, _, name in targets]
    keyed = df.select(id_col, *distances)
    return smallest_fractions(keyed, [([name, id_col], share) for _, share, name in targets], n_rows)


def nearest_overall_condition(
    df: DataFrame,
    columns: Sequence[str],
    centre: Sequence[float],
    share: float,
    id_col: str = ID_COL,
    dist_col: str = DIST_COL,
    n_rows: int | None = None,
) -> Column:
    """Condition on ``(dist, id)`` that holds for the given share of rows nearest to ``centre``."""
    return nearest_overall_conditions(df, columns, [(centre, share, dist_col)], id_col, n_rows)[0]


def nearest_overall(
    df: DataFrame,
    columns: Sequence[str],
    centre: Sequence[float],
    share: float,
    id_col: str = ID_COL,
    dist_col: str = DIST_COL,
) -> DataFrame:
    """The ``round(rows * share)`` rows nearest to ``centre``, with their distance.

    The cut-off is found from counts, so the rows are filtered in place and never sorted.
    """
    condition = nearest_overall_condition(df, columns, centre, share, id_col, dist_col)
    return with_distance(df, columns, centre, dist_col).filter(condition)
