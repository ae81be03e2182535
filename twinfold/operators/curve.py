"""Precision-recall curves and metrics, for one table or for many groups of rows at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.columns import LABEL_COL, positive_score, quantised
from twinfold.operators.ranking import quantile_bounds, running_totals

# The guard in the precision denominator and the tolerance for equally near recalls.
PRECISION_GUARD = 1e-12
RECALL_TIE = 1e-9
SCORE_DIGITS = 3
# The ten recalls at which models are compared.
STANDARD_RECALLS = (0.025, 0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.225, 0.25)


def score_counts(
    df: DataFrame,
    score_col: str = "prob_1",
    label_col: str = LABEL_COL,
    by: Sequence[str] = (),
    digits: int | None = SCORE_DIGITS,
) -> DataFrame:
    """Rows and positives per distinct (rounded) score: ``(by..., score, n_pos, n_rows)``.

    This is the only step that sees every row, and it is combined map-side: with rounded scores at
    most ``10**digits + 1`` rows per group leave each task, however many rows share a score.
    """
    score = quantised(positive_score(df, score_col), digits)
    return df.groupBy(*by, score.alias("score")).agg(
        F.sum(F.col(label_col).cast("bigint")).alias("n_pos"), F.count(F.lit(1)).alias("n_rows")
    )


def curve_from_counts(
    counts: DataFrame, by: Sequence[str] = (), with_rank: bool = False, bounds: Sequence[float] | None = None
) -> DataFrame:
    """True and false positives at each score threshold: ``(by..., score, tps, fps)``.

    ``tps`` counts the positives with a score of at least the threshold. ``with_rank`` adds the
    zero-based rank of the score, highest first.
    """
    sums = {"n_pos": "tps", "n_rows": "_seen"}
    if with_rank:
        counts, sums = counts.withColumn("_one", F.lit(1).cast("bigint")), {**sums, "_one": "_place"}
    totals = running_totals(counts, "score", sums, by, bounds=bounds)
    columns = [*by, "score", "tps", (F.col("_seen") - F.col("tps")).alias("fps")]
    if with_rank:
        columns.append((F.col("_place") - 1).cast("int").alias("rank"))
    return totals.select(*columns)


def _with_totals(df: DataFrame, by: Sequence[str], **totals: Column) -> DataFrame:
    """``df`` with aggregates over each ``by`` group as further columns.

    The aggregates combine map-side and are joined back, so a group of any number of rows never meets in one task, as it
    would in a window.
    """
    if not by:
        return df.withColumns({name: df.agg(total).scalar() for name, total in totals.items()})
    found = df.groupBy(*by).agg(*[t.alias(name) for name, t in totals.items()])
    found = found.withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = reduce(and_, [df[c].eqNullSafe(found[f"_k_{c}"]) for c in by])
    return df.join(found, same, "left").drop(*[f"_k_{c}" for c in by])


def score_curve(
    df: DataFrame,
    score_col: str = "prob_1",
    label_col: str = LABEL_COL,
    by: Sequence[str] = (),
    digits: int | None = SCORE_DIGITS,
    with_rank: bool = False,
) -> DataFrame:
    """Binary score curve of a scored table. ``digits=None`` keeps every distinct score as a threshold."""
    counts = score_counts(df, score_col, label_col, by, digits)
    bounds = quantile_bounds(df, positive_score(df, score_col)) if digits is None else None
    return curve_from_counts(counts, by, with_rank, bounds)


def pr_from_curve(curve: DataFrame, by: Sequence[str] = (), rounded: bool = False) -> DataFrame:
    """``(by..., precision, recall)``, with the point (1, 0) added to each group.

    Without positives every recall but the added one is NULL. With ``rounded`` a group has a bounded number of points, so
    its totals come from a window over the curve's own partitioning instead of a join.
    """
    tps, fps = F.col("tps"), F.col("fps")
    totals = {"_all": F.max("tps"), "_least": F.min(tps + fps)}
    if rounded and by:
        group = Window.partitionBy(*by)
        whole = curve.withColumns({name: total.over(group) for name, total in totals.items()})
    else:
        whole = _with_totals(curve, by, **totals)
    totals = whole.select(
        *by,
        (tps / (tps + fps + F.lit(PRECISION_GUARD))).alias("precision"),
        F.try_divide(tps, F.col("_all")).alias("recall"),
        # the threshold that selects the fewest rows carries the added point
        ((tps + fps) == F.col("_least")).alias("_first"),
    )
    added = F.struct(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    own = F.struct("precision", "recall")
    points = F.when(F.col("_first"), F.array(added, own)).otherwise(F.array(own))
    return totals.select(*by, F.explode(points).alias("_p")).select(*by, "_p.precision", "_p.recall")


def pr_curve(
    df: DataFrame,
    score_col: str = "prob_1",
    label_col: str = LABEL_COL,
    by: Sequence[str] = (),
    digits: int | None = SCORE_DIGITS,
) -> DataFrame:
    """Precision-recall curve of a scored table, on rounded scores or, with ``digits=None``, on every distinct one."""
    return pr_from_curve(score_curve(df, score_col, label_col, by, digits), by, rounded=digits is not None)


def precision_at_recalls(curve: DataFrame, recalls: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Precision at each wanted recall: ``(by..., recall, reached_recall, precision)``.

    Takes the curve point with the nearest recall; among equally near ones the smallest recall,
    then the largest precision.
    """
    # of the points that do not reach the recall, and of those beyond it, only the nearest can win
    reached, aggregates = F.col("recall"), []
    for i, r in enumerate(recalls):
        below = F.struct(reached.alias("at"), F.col("precision").alias("precision"))
        beyond = F.struct(reached.alias("at"), (-F.col("precision")).alias("less"))
        aggregates += [
            F.max(F.when(reached <= float(r), below)).alias(f"_below_{i}"),
            F.min(F.when(reached > float(r), beyond)).alias(f"_beyond_{i}"),
        ]
    found = []
    for i, r in enumerate(recalls):
        wanted, below, beyond = F.lit(float(r)), F.col(f"_below_{i}"), F.col(f"_beyond_{i}")
        lower = beyond.isNull() | (wanted - below["at"] < beyond["at"] - wanted + RECALL_TIE)
        nearest = F.when(below.isNotNull() & lower, below["at"]).otherwise(beyond["at"])
        precision = F.when(below.isNotNull() & lower, below["precision"]).otherwise(-beyond["less"])
        found.append(F.struct(wanted.alias("recall"), nearest.alias("reached_recall"), precision.alias("precision")))
    picked = curve.groupBy(*by).agg(*aggregates).select(*by, F.explode(F.array(*found)).alias("_p"))
    return picked.select(*by, "_p.recall", "_p.reached_recall", "_p.precision").filter("reached_recall is not null")


def areas_from_counts(
    counts: DataFrame, by: Sequence[str] = (), bounds: Sequence[float] | None = None
) -> DataFrame:
    """Area under the ROC and under the PR curve by the trapezoid rule: ``(by..., area_roc, area_pr)``.

    The PR curve starts at recall 0 with the precision of the highest score. A group without
    positives or without negatives has no ROC area (NULL).
    """
    totals = running_totals(counts, "score", {"n_pos": "_tp", "n_rows": "_seen"}, by, bounds=bounds)
    tp, seen, pos = F.col("_tp").cast("double"), F.col("_seen").cast("double"), F.col("n_pos").cast("double")
    rows = F.col("n_rows").cast("double")
    previous = F.when(seen > rows, (tp - pos) / (seen - rows)).otherwise(tp / seen)
    sums = totals.groupBy(*by).agg(
        F.sum((rows - pos) * (2 * tp - pos)).alias("_roc"),
        F.sum(pos * (tp / seen + previous)).alias("_pr"),
        F.sum(pos).alias("_p"),
        F.sum(rows - pos).alias("_n"),
    )
    return sums.select(
        *by,
        F.try_divide("_roc", 2 * F.col("_p") * F.col("_n")).alias("area_roc"),
        F.try_divide("_pr", 2 * F.col("_p")).alias("area_pr"),
    )


def areas(
    df: DataFrame, score_col: str = "prob_1", label_col: str = LABEL_COL, by: Sequence[str] = ()
) -> DataFrame:
    """Areas under the ROC and PR curves on unrounded scores, per group."""
    counts = score_counts(df, score_col, label_col, by, digits=None)
    return areas_from_counts(counts, by, quantile_bounds(df, positive_score(df, score_col)))


def metric_name(metric: str, recall: float | None = None) -> str:
    """Key of a metric in result lists."""
    return metric if recall is None else f"{metric} at recallValue {recall}"


def metrics_by_scope(
    df: DataFrame,
    recalls: Sequence[float],
    scopes: Sequence[Sequence[str]] = ((),),
    score_col: str = "prob_1",
    label_col: str = LABEL_COL,
    digits: int = SCORE_DIGITS,
) -> DataFrame:
    """Precision at each recall for several grouping levels, in long form.

    ``scopes`` lists the grouping columns of each level, such as ``[("fold", "cluster"), ("fold",), ()]``.
    The rows are counted once at the finest level; coarser levels add up those counts. Columns:
    ``scope``, one column per grouping column (NULL when not part of the level), ``recall``, ``value``.
    """
    keys: list[str] = []
    for scope in scopes:
        keys += [c for c in scope if c not in keys]
    finest = score_counts(df, score_col, label_col, keys, digits)
    # all levels at once: grouping sets over the counts, and one pass of the curve for every group of every level
    names = {_set_number(scope, keys): "+".join(scope) or "all" for scope in scopes}
    sets = [[*[F.col(c) for c in scope], F.col("score")] for scope in scopes]
    rolled = finest.groupingSets(sets, *keys, "score").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_rows").alias("n_rows"), F.grouping_id(*keys, "score").alias("_set")
    )
    by = ["_set", *keys]
    points = pr_from_curve(curve_from_counts(rolled, by), by, rounded=True)
    found = precision_at_recalls(points, recalls, by)
    scope = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("_set")]
    return found.select(scope.alias("scope"), *keys, "recall", F.col("precision").alias("value"))


def _set_number(scope: Sequence[str], keys: Sequence[str]) -> int:
    """Number by which Spark tells a grouping set: a bit for each key that it leaves out, the score's the lowest."""
    return sum(1 << (len(keys) - i) for i, c in enumerate(keys) if c not in scope)
