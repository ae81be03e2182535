"""Cluster the cases, train one classifier per cluster, evaluate over held-out folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.columns import ID_COL, LABEL_COL, MATCH_COL, flag_columns, label_as_double, predictor_columns
from twinfold.operators.clustering import (
    CLUSTER_COL,
    assemble,
    centres_of,
    cluster_rows,
    mark_near_by_cluster,
    similar_controls_by_cluster,
    zero_far,
)
from twinfold.operators.cohort import union_all
from twinfold.operators.crossval import CV_METRIC, FoldCrossValidator, mark_best
from twinfold.operators.curve import STANDARD_RECALLS, metrics_by_scope
from twinfold.operators.distance import DIST_COL, cluster_shares
from twinfold.operators.evaluator import AT_RECALL, PrecisionRecallEvaluator
from twinfold.operators.folds import attach_folds, fold_table
from twinfold.operators.scores import SCORE_COL, score_with
from twinfold.session import is_written, materialise, scratch_path
from twinfold.sources.grouped import SLICE_COL, GroupLayout, group_layout
from twinfold.sources.sinks import read_results, run_manifest, run_path, write_results
from twinfold.sources.tables import align_columns

EVAL_FOLD = "eval_fold"
CV_FOLD = "cv_fold"
PART = "_part"


@dataclass(frozen=True)
class ClusterFlowConfig:
    """Settings of the flow; the defaults are the full-size run (915 classifier fits)."""

    # The sizes and the parameter grid of the full study.
    n_clusters: int = 3
    n_eval_folds: int = 5
    n_cv_folds: int = 5
    lambdas: Sequence[float] = (0.01, 0.1, 1.0, 10.0)
    alphas: Sequence[float] = (0.0, 0.5, 1.0)
    recalls: Sequence[float] = STANDARD_RECALLS
    cv_recall: float = 0.05
    max_iter: int = 100_000
    seed: int = 42
    # classifier fits at a time within a cluster, and clusters at a time within a fold
    parallelism: int = 4
    cluster_threads: int = 3
    # "union" keeps a test row once per cluster in the fold and overall metrics, "max" its best score
    combine: str = "union"
    # fit on different rows with their numbers as weights; the models are the same
    compress: bool = False
    # format of the result tables: parquet or csv
    result_format: str = "parquet"


@dataclass(frozen=True)
class ClusterFlowResult:
    """Tables written by a run, and the folder they are in."""

    predictions: DataFrame
    metrics: DataFrame
    cv_metrics: DataFrame
    loops: DataFrame
    manifest: DataFrame
    out_dir: str


def study_rows(pos: DataFrame, neg: DataFrame, ss: DataFrame) -> DataFrame:
    """All three tables in one, each row with its part."""
    parts = {"pos": pos, "neg": neg, "ss": ss}
    return union_all([align_columns(df, pos).withColumn(PART, F.lit(p)) for p, df in parts.items()])


def tag_eval_folds(
    pos: DataFrame, neg: DataFrame, ss: DataFrame, n_folds: int, seed: int, layout: GroupLayout | None = None
) -> DataFrame:
    """All three tables with the evaluation fold of their match group, in one table.

    Scoring rows only count when their match group has a case. With a ``layout`` the rows come out placed in it.
    """
    rows = study_rows(pos, neg, ss)
    study = rows.filter(F.col(PART) != "ss")
    with_case = study.groupBy(MATCH_COL).agg((F.max(LABEL_COL) == 1).alias("_has_case"))
    groups = fold_table(with_case, n_folds, MATCH_COL, EVAL_FOLD, seed).join(with_case, MATCH_COL)
    tagged = layout.attach(layout.place(rows), groups) if layout else attach_folds(rows, groups)
    return tagged.filter((F.col(PART) != "ss") | F.col("_has_case")).drop("_has_case")


def cv_fold_table(clustered: DataFrame, clusters: Sequence[int], n_folds: int, seed: int) -> DataFrame:
    """Match id, cluster and cross-validation fold; the match ids of every cluster's cases are divided on their own.

    The controls of a cluster belong to the match groups of its cases, so these are all groups that it trains on.
    """
    own = {c: clustered.filter(F.col(CLUSTER_COL) == c) for c in clusters}
    return union_all(
        [fold_table(rows, n_folds, MATCH_COL, CV_FOLD, seed).withColumn(CLUSTER_COL, F.lit(c)) for c, rows in own.items()]
    )


def parameter_grid(classifier: LogisticRegression, config: ClusterFlowConfig) -> list:
    """Elastic-net grid: every lambda with every alpha."""
    return (
        ParamGridBuilder()
        .addGrid(classifier.regParam, list(config.lambdas))
        .addGrid(classifier.elasticNetParam, list(config.alphas))
        .build()
    )


def cluster_then_classify(
    pos: DataFrame,
    neg: DataFrame,
    ss: DataFrame,
    config: ClusterFlowConfig = ClusterFlowConfig(),
    out_dir: str | None = None,
) -> ClusterFlowResult:
    """Run the flow on case, control and scoring tables of one layout.

    The fold-tagged rows are written once, split by fold and bucketed by match group, so every later step reads only the
    folds it needs and no join or grouping on the match id moves them again. Predictions go to one table split by fold and cluster, and all metrics are computed
    from that table at the end.

    A run that ended early goes on when it is called again with the same folder, tables and settings: what fold and
    cluster have written is kept, the rest is computed. Other settings in a folder with results are refused. Results are
    written in ``config.result_format``.
    """
    spark = pos.sparkSession
    out = (out_dir or scratch_path(spark, "cluster-flow")).rstrip("/")
    pos, neg, ss = (label_as_double(align_columns(df, pos)) for df in (pos, neg, ss))
    predictors = predictor_columns(pos.columns)
    flags = flag_columns(predictors)
    manifest = run_manifest({"n_rows_pos": pos, "n_rows_neg": neg, "n_rows_ss": ss}, asdict(config))
    if is_written(spark, f"{out}/manifest"):
        if not manifest.exceptAll(spark.read.schema(manifest.schema).json(f"{out}/manifest")).isEmpty():
            raise ValueError(f"{out} holds results of other tables or settings")
    else:
        write_results(manifest, f"{out}/manifest", fmt="json", mode="overwrite")

    bad = pos.filter(~F.col(LABEL_COL).eqNullSafe(1.0)).limit(1).count()
    if bad:
        raise ValueError("every row of the case table must have label 1")
    layout = group_layout(study_rows(pos, neg, ss), f"{out}/state/layout")
    try:
        _all_folds(pos, neg, ss, layout, predictors, flags, config, out)
    finally:
        layout.forget()

    predictions = read_results(spark, f"{out}/predictions", config.result_format)
    write_results(flow_metrics(predictions, config), f"{out}/metrics", fmt=config.result_format, mode="overwrite")
    tables = [read_results(spark, f"{out}/{t}", config.result_format) for t in ("metrics", "cv_metrics", "loops")]
    return ClusterFlowResult(predictions, *tables, manifest, out)


def _all_folds(
    pos: DataFrame,
    neg: DataFrame,
    ss: DataFrame,
    layout: GroupLayout,
    predictors: Sequence[str],
    flags: Sequence[str],
    config: ClusterFlowConfig,
    out: str,
) -> None:
    """All evaluation folds with their clusters, apart from those that an earlier run has written."""
    spark = pos.sparkSession
    tagged = tag_eval_folds(pos, neg, ss, config.n_eval_folds, config.seed, layout)
    tagged = layout.store_once(tagged, f"{out}/state/eval-folds", (EVAL_FOLD,))
    test_sizes = {r[EVAL_FOLD]: r["count"] for r in tagged.groupBy(EVAL_FOLD).count().collect()}

    for fold in range(config.n_eval_folds):
        here = F.col(EVAL_FOLD) == fold
        train = tagged.filter(~here & (F.col(PART) != "ss")).drop(EVAL_FOLD)
        test = tagged.filter(here).drop(EVAL_FOLD, PART, SLICE_COL)
        cases = train.filter((F.col(LABEL_COL) == 1) & (F.col(PART) == "pos")).drop(PART)
        controls = train.filter(F.col(PART) == "neg").drop(PART)
        state = run_path(f"{out}/state/clusters", {"fold": fold})
        if not is_written(spark, f"{state}/centres"):  # written last
            model, clustered = cluster_rows(cases, flags, config.n_clusters, config.seed)
            layout.store(clustered, f"{state}/cases")
            found = spark.createDataFrame(sorted(centres_of(model).items()), "cluster int, centre array<double>")
            write_results(found, f"{state}/centres", mode="overwrite")
        clustered = layout.reopen(spark, f"{state}/cases")
        centres = {r["cluster"]: r["centre"] for r in spark.read.parquet(f"{state}/centres").collect()}
        shares = {r[CLUSTER_COL]: r for r in cluster_shares(clustered).collect()}

        left = [c for c in sorted(shares) if not is_written(spark, run_path(f"{out}/loops", {"fold": fold, "cluster": c}))]
        if not left:
            continue
        ratios = {c: r["share"] for c, r in shares.items()}
        # cases and controls get their cross-validation fold in the join that they need anyway
        of_match = materialise(cv_fold_table(clustered, sorted(shares), config.n_cv_folds, config.seed), "cv-folds")
        chosen = similar_controls_by_cluster(
            controls, of_match, flags, centres, ratios, carry=(CV_FOLD,), layout=layout
        )
        chosen = materialise(chosen, "similar-controls", (CLUSTER_COL,))
        # the cut-offs of all clusters come from the same passes over the fold's test rows
        marked = mark_near_by_cluster(test, flags, centres, {c: ratios[c] for c in left}, n_rows=test_sizes.get(fold, 0))

        def step(cluster: int) -> None:
            here = F.col(CLUSTER_COL) == cluster
            own = layout.attach(clustered.filter(here).drop(CLUSTER_COL, DIST_COL), of_match.filter(here).drop(CLUSTER_COL))
            own, near = own.drop(SLICE_COL), chosen.filter(here).drop(CLUSTER_COL)
            _one_cluster(own, near, marked[cluster], test_sizes.get(fold, 0), shares[cluster], fold, predictors, config, out)

        with ThreadPool(config.cluster_threads) as pool:
            pool.map(inheritable_thread_target(spark)(step), left, chunksize=1)


def _one_cluster(
    own: DataFrame,
    controls: DataFrame,
    test: DataFrame,
    n_test: int,
    share_row,
    fold: int,
    predictors: Sequence[str],
    config: ClusterFlowConfig,
    out: str,
) -> None:
    """Train the classifier of one cluster and write its predictions, grid metrics and row counts.

    ``own`` and ``controls`` have their cross-validation fold; ``test`` marks in its column ``near`` the rows that the
    classifier scores.
    """
    cluster, share = share_row[CLUSTER_COL], share_row["share"]
    key = {"fold": fold, "cluster": cluster}
    train = union_all([own, align_columns(controls, own)])
    train = materialise(assemble(train, predictors, keep=(MATCH_COL, LABEL_COL, ID_COL, CV_FOLD)), "train")
    n_train = train.count()
    classifier = LogisticRegression(
        maxIter=config.max_iter, featuresCol="features", labelCol=LABEL_COL, standardization=True
    )
    validator = FoldCrossValidator(
        estimator=classifier,
        estimatorParamMaps=parameter_grid(classifier, config),
        evaluator=PrecisionRecallEvaluator(
            rawPredictionCol="probability",
            labelCol=LABEL_COL,
            metricName=AT_RECALL,
            metricParams={"recallValue": config.cv_recall},
        ),
        stratifyCol=CV_FOLD,
        parallelism=config.parallelism,
        compressRows=config.compress,
    )
    fitted = validator.fit(train)
    how = {"fmt": config.result_format, "mode": "overwrite"}  # what a lost run left of this part goes
    write_results(mark_best(fitted.avgMetrics, CV_METRIC + AT_RECALL), run_path(f"{out}/cv_metrics", key), **how)

    # rows far from the centre count as negative: score 0
    vectors = assemble(test, predictors, keep=(MATCH_COL, LABEL_COL, ID_COL, "near"))
    scored = zero_far(score_with(vectors, fitted.bestModel))
    predictions = scored.select(ID_COL, MATCH_COL, LABEL_COL, "near", SCORE_COL)
    write_results(predictions, run_path(f"{out}/predictions", key), **how)

    counts = own.sparkSession.createDataFrame(
        [(share_row["n_rows"], share, n_train, n_test)], "n_cases bigint, share double, n_train bigint, n_test bigint"
    )
    write_results(counts, run_path(f"{out}/loops", key), **how)  # last: the part is done


def flow_metrics(predictions: DataFrame, config: ClusterFlowConfig) -> DataFrame:
    """Precision at each recall per fold and cluster, per fold, and overall."""
    fine, fold, everything = ("fold", "cluster"), ("fold",), ()
    if config.combine == "union":
        return metrics_by_scope(predictions, config.recalls, [fine, fold, everything])
    if config.combine != "max":
        raise ValueError(f"combine must be 'union' or 'max', not {config.combine!r}")
    best = predictions.groupBy("fold", ID_COL, MATCH_COL, LABEL_COL).agg(F.max(SCORE_COL).alias(SCORE_COL))
    per_cluster = metrics_by_scope(predictions, config.recalls, [fine])
    combined = metrics_by_scope(best, config.recalls, [fold, everything])
    return per_cluster.unionByName(combined.withColumn("cluster", F.lit(None).cast("int")))
