"""K-means on flag columns and per-cluster selection of similar rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.columns import ID_COL, LABEL_COL, MATCH_COL, euclidean_to, require_new_column, round_half_up
from twinfold.operators.cohort import BROADCAST_IDS, complement_rows, union_all
from twinfold.operators.distance import (
    DIST_COL,
    nearest_overall_conditions,
    nearest_per_group,
    with_distance,
    with_in_cluster_distance,
)
from twinfold.operators.ranking import top_n_per_group
from twinfold.sources.grouped import SLICE_COL, GroupLayout

CLUSTER_COL = "cluster_id"
CLUSTER_FEATURES = "cluster_features"


def assemble(
    df: DataFrame,
    columns: Sequence[str],
    output_col: str = "features",
    keep: Sequence[str] = (MATCH_COL, LABEL_COL, ID_COL),
    handle_invalid: str = "error",
) -> DataFrame:
    """Feature vector of ``columns`` next to the id and label columns; the label becomes double."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol=output_col, handleInvalid=handle_invalid)
    vectors = assembler.transform(df).select(*keep, output_col)
    return vectors.withColumn(LABEL_COL, F.col(LABEL_COL).cast("double")) if LABEL_COL in keep else vectors


def centres_of(model: KMeansModel) -> dict[int, list[float]]:
    """Centres by cluster id. There may be fewer than the wanted k."""
    return {i: [float(x) for x in c] for i, c in enumerate(model.clusterCenters())}


def cluster_rows(
    df: DataFrame,
    columns: Sequence[str],
    k: int = 3,
    seed: int = 42,
    cluster_col: str = CLUSTER_COL,
    dist_col: str = DIST_COL,
) -> tuple[KMeansModel, DataFrame]:
    """Fit K-means and append each row's cluster and its distance to the cluster's centre."""
    require_new_column(df, cluster_col, dist_col, CLUSTER_FEATURES)
    assembled = VectorAssembler(inputCols=list(columns), outputCol=CLUSTER_FEATURES).transform(df)
    model = KMeans(featuresCol=CLUSTER_FEATURES, predictionCol=cluster_col, k=k, seed=seed).fit(
        assembled.select(CLUSTER_FEATURES)
    )
    clustered = model.transform(assembled).drop(CLUSTER_FEATURES)
    return model, with_in_cluster_distance(clustered, columns, cluster_col, centres_of(model), dist_col)


def similar_controls(
    controls: DataFrame,
    cases: DataFrame,
    columns: Sequence[str],
    centre: Sequence[float],
    share: float,
    match_col: str = MATCH_COL,
    id_col: str = ID_COL,
) -> DataFrame:
    """Controls of the given cases that are nearest to the centre of the cases' cluster."""
    chosen = nearest_per_group(
        controls, columns, centre, share, match_col, id_col, dist_col="_similar_dist", cases=cases
    )
    return chosen.select(controls.columns)


def similar_controls_by_cluster(
    controls: DataFrame,
    clustered: DataFrame,
    columns: Sequence[str],
    centres: Mapping[int, Sequence[float]],
    shares: Mapping[int, float],
    match_col: str = MATCH_COL,
    id_col: str = ID_COL,
    cluster_col: str = CLUSTER_COL,
    carry: Sequence[str] = (),
    layout: GroupLayout | None = None,
) -> DataFrame:
    """The controls that :func:`similar_controls` takes for every cluster, with the cluster, in one pass over them.

    ``clustered`` holds the cases with their cluster; a match id has one case. Each control gets its case's cluster and its
    distance to that centre. The number to keep per match group is counted for all clusters at once.

    ``carry`` names further columns of ``clustered`` that are the same for a match id and cluster; controls get them too.
    With the ``layout`` that ``controls`` are stored in, they are joined and ranked where they lie: only narrow rows and
    those of hot groups, cut in the map tasks, are shuffled.
    """
    require_new_column(controls, cluster_col, "_similar_dist", *carry)
    of_match = clustered.select(match_col, cluster_col, *carry).distinct()
    if of_match.count() <= BROADCAST_IDS:
        rows = controls.join(F.broadcast(of_match), match_col)
    else:
        rows = layout.attach(controls, of_match) if layout else controls.join(of_match, match_col)
    kept = [*[c for c in controls.columns if layout is None or c != SLICE_COL], cluster_col, *carry]
    dist = reduce(
        lambda rest, item: F.when(F.col(cluster_col) == item[0], euclidean_to(columns, item[1])).otherwise(rest),
        centres.items(),
        F.lit(None).cast("double"),
    )
    sizes = rows.groupBy(cluster_col, match_col).agg(F.count(F.lit(1)).alias("n")).groupBy(cluster_col)
    found = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups")).collect()
    keep = {r[cluster_col]: round_half_up(r["rows"] / r["groups"] * shares[r[cluster_col]]) for r in found}
    if not any(keep.values()):
        return rows.select(*kept).limit(0)
    keyed = rows.withColumn("_similar_dist", dist)
    wanted = reduce(lambda rest, item: F.when(F.col(cluster_col) == item[0], item[1]).otherwise(rest), keep.items(), F.lit(0))
    order = ["_similar_dist", id_col]

    def nearest(part: DataFrame, *group: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return part.withColumn("_place", place).filter(F.col("_place") <= wanted).select(*kept)

    def cut(part: DataFrame) -> DataFrame:
        # first the most that any cluster keeps, which cuts large groups in the map tasks, then each cluster's own number
        return nearest(top_n_per_group(part, max(keep.values()), match_col, order), match_col)

    if layout is None:
        return cut(keyed)
    hot, other = layout.hot_and_other(keyed)
    placed = nearest(other, match_col, SLICE_COL)  # a group that is not hot lies in one bucket
    return placed if hot is None else union_all([placed, cut(hot)])


def mark_near_by_cluster(
    test: DataFrame,
    columns: Sequence[str],
    centres: Mapping[int, Sequence[float]],
    shares: Mapping[int, float],
    id_col: str = ID_COL,
    near_col: str = "near",
    n_rows: int | None = None,
) -> dict[int, DataFrame]:
    """For every cluster in ``shares`` the test rows as :func:`mark_near` gives them.

    The cut-offs of all clusters are found in the same passes over the rows.
    """
    dist = "_near_dist"
    require_new_column(test, dist, near_col)
    targets = [(centres[c], share, f"{dist}_{c}") for c, share in shares.items()]
    conditions = nearest_overall_conditions(test, columns, targets, id_col, n_rows)
    return {
        cluster: with_distance(test, columns, centre, name).withColumn(near_col, condition).drop(name)
        for cluster, (centre, _, name), condition in zip(shares, targets, conditions)
    }


def mark_near(
    test: DataFrame,
    columns: Sequence[str],
    centre: Sequence[float],
    share: float,
    id_col: str = ID_COL,
    near_col: str = "near",
    n_rows: int | None = None,
) -> DataFrame:
    """Test rows with a boolean column: whether they are among the given share nearest to the centre.

    Every row has a value; rows without a distance come last and are rarely near.
    """
    return mark_near_by_cluster(test, columns, {0: centre}, {0: share}, id_col, near_col, n_rows)[0]


def split_test_rows(
    test: DataFrame, columns: Sequence[str], centre: Sequence[float], share: float, id_col: str = ID_COL
) -> tuple[DataFrame, DataFrame]:
    """Test rows near a cluster's centre, and all the others: together every row once."""
    marked = mark_near(test, columns, centre, share, id_col, "_near")
    return marked.filter("_near").drop("_near"), marked.filter("not _near").drop("_near")


def zero_far(scored: DataFrame, near_col: str = "near", score_col: str = "prob_1") -> DataFrame:
    """Scores of the near rows; every other row counts as negative, with score 0. One pass, no join."""
    return scored.withColumn(score_col, F.when(F.col(near_col), F.col(score_col)).otherwise(0.0))


def with_discarded(predictions: DataFrame, entire: DataFrame, id_col: str = ID_COL, score_col: str = "prob_1") -> DataFrame:
    """Predictions of the near rows plus every other test row with score 0, when only the near rows were scored."""
    rest = complement_rows(entire, predictions, id_col).withColumn(score_col, F.lit(0.0))
    return union_all([predictions, rest.select(predictions.columns)])
