"""Two-stage logistic model: held-out first-stage scores select and enrich the second-stage rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.columns import ID_COL, LABEL_COL, MATCH_COL, label_as_double, predictor_columns
from twinfold.operators.clustering import assemble
from twinfold.operators.cohort import union_all
from twinfold.operators.curve import STANDARD_RECALLS, areas, metrics_by_scope
from twinfold.operators.fits import block_bytes, feature_count, fit_budget, fitting_partitions
from twinfold.operators.folds import fold_table
from twinfold.operators.joint_fits import MOST_COLUMNS, WantedFit, fit_together
from twinfold.operators.scores import (
    SCORE_COL,
    mean_score,
    positive_score_cut,
    score_with,
    score_with_all,
    second_stage_features,
)
from twinfold.plans.cleaning import clean_cohort
from twinfold.session import materialise, scratch_path
from twinfold.sources.grouped import SLICE_COL, GroupLayout, group_layout
from twinfold.sources.sinks import read_results, run_path, write_results
from twinfold.sources.tables import align_columns, read_cohort, read_exclusion_list

OUTER, INNER, PART = "sim", "_inner", "_part"
STUDY, REP = "test", "rep"


@dataclass(frozen=True)
class TwoStageConfig:
    """Settings of the flow; the defaults are the full-size run (30 classifier fits)."""

    n_outer: int = 5
    n_inner: int = 5
    positive_share: float = 0.75
    recalls: Sequence[float] = STANDARD_RECALLS
    max_iter: int = 100
    seed: int = 42
    # inner fits at a time within an outer fold, and outer folds at a time
    parallelism: int = 4
    outer_threads: int = 2
    # format of the result tables: parquet or csv
    result_format: str = "parquet"


@dataclass(frozen=True)
class TwoStageResult:
    """Tables written by a run, and the folder they are in."""

    first_stage: DataFrame
    second_stage: DataFrame
    areas: DataFrame
    precision: DataFrame
    out_dir: str


def fit_unpenalised(rows: DataFrame, config: TwoStageConfig) -> LogisticRegressionModel:
    """Unpenalised logistic regression with intercept."""
    return LogisticRegression(
        regParam=0.0, maxIter=config.max_iter, featuresCol="features", labelCol=LABEL_COL
    ).fit(rows)


def two_stage(
    pos: DataFrame,
    neg: DataFrame,
    ss: DataFrame,
    config: TwoStageConfig = TwoStageConfig(),
    out_dir: str | None = None,
    predictors: Sequence[str] | None = None,
) -> TwoStageResult:
    """Run the outer folds and write first-stage scores, second-stage scores and metrics.

    Outer folds divide the match ids of the cases. Controls whose match id has no case are always
    training rows, and scoring rows without one are not used.
    """
    spark = pos.sparkSession
    out = (out_dir or scratch_path(spark, "two-stage")).rstrip("/")
    names = list(predictors or predictor_columns(pos.columns))
    tables = {STUDY: pos, "controls": neg, REP: ss}
    vectors = [
        assemble(label_as_double(align_columns(df, pos)), names).withColumn(PART, F.lit(REP if p == REP else STUDY))
        for p, df in tables.items()
    ]
    outer = materialise(fold_table(pos, config.n_outer, MATCH_COL, OUTER, config.seed), "outer-folds")
    rows, place = union_all(vectors), scratch_path(spark, "two-stage-rows")
    layout = group_layout(rows, f"{place}/layout")
    tagged = layout.attach(layout.place(rows), outer, "left").fillna(-1, [OUTER])
    # by match group: the inner folds of every outer fold are attached without moving the rows again
    tagged = layout.store(tagged, f"{place}/rows", (OUTER,))

    def step(sim: int) -> DataFrame:
        return _outer_fold(tagged, outer, layout, sim, config, out).withColumn(OUTER, F.lit(sim))

    try:
        with ThreadPool(config.outer_threads) as pool:
            nested = union_all(pool.map(inheritable_thread_target(spark)(step), range(config.n_outer), chunksize=1))
    finally:
        layout.forget()

    fmt = config.result_format
    second = read_results(spark, f"{out}/second_stage", fmt)
    write_results(_stage_areas(nested, second), f"{out}/areas", fmt=fmt)
    precision = metrics_by_scope(second.filter(F.col("set") != "train"), config.recalls, [(OUTER,), ()])
    write_results(precision, f"{out}/precision", fmt=fmt)
    first, found, precision = (read_results(spark, f"{out}/{t}", fmt) for t in ("first_stage", "areas", "precision"))
    return TwoStageResult(first, second, found, precision, out)


def run_two_stage(
    spark: SparkSession,
    paths: tuple[str, str, str],
    exclusion_path: str | None,
    out_dir: str,
    layouts: tuple[str, str, str] = ("patient_id", "patient_id", "patient_id"),
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    config: TwoStageConfig | None = None,
    source_fmt: str | None = None,
) -> TwoStageResult:
    """The whole job from files to files: read the case, control and scoring tables, top-code their counts, bring the ids
    to one layout, leave the excluded columns out, and run both stages on the remaining predictors.

    The cleaned tables are written once to the shared folder, as Parquet, so that no fold reads the raw files again. Results are written below
    ``out_dir`` in the format of ``config``; without a ``config``, in ``fmt``.
    """
    config = config or TwoStageConfig(result_format=fmt)
    raw = [read_cohort(spark, p, schema, source_fmt or fmt) for p in paths]
    excluded = read_exclusion_list(spark, exclusion_path) if exclusion_path else []
    cleaned = clean_cohort(*raw, layouts, excluded)
    stored = [materialise(df, f"cleaned-{part}") for part, df in zip(("pos", "neg", "ss"), cleaned)]
    return two_stage(*stored, config, out_dir)


def inner_fold_table(outer: DataFrame, sim: int, n_inner: int, seed: int) -> DataFrame:
    """Inner folds of the match ids that are not in outer fold ``sim``."""
    return fold_table(outer.filter(F.col(OUTER) != sim), n_inner, MATCH_COL, INNER, seed + 1 + sim)


def held_out_scores(nested: DataFrame, fold_col: str = INNER, scores_col: str = "_scores") -> DataFrame:
    """Rows with the score of the one model, out of an array of all, that did not train on their fold."""
    rows = nested.filter(F.col(fold_col) >= 0)
    return rows.withColumn(SCORE_COL, F.element_at(scores_col, F.col(fold_col) + 1)).drop(scores_col)


def _stage_areas(nested: DataFrame, second: DataFrame) -> DataFrame:
    """Area under the PR curve per outer fold: first stage (mean over inner models) and second stage."""
    # the inner models on their own training rows
    fitted = nested.select(OUTER, LABEL_COL, INNER, F.posexplode("_scores").alias("_model", SCORE_COL)).filter(
        F.col(INNER) != F.col("_model")
    )
    mean = F.avg("area_pr").alias("area_pr")
    first = {
        "train": areas(fitted, by=[OUTER, "_model"]).groupBy(OUTER).agg(mean),
        "held_out": areas(held_out_scores(nested), by=[OUTER, INNER]).groupBy(OUTER).agg(mean),
    }
    tables = [df.select(OUTER, F.lit(1).alias("stage"), F.lit(n).alias("set"), "area_pr") for n, df in first.items()]
    final = areas(second.filter(F.col("set") != REP), by=[OUTER, "set"])
    return union_all([*tables, final.select(OUTER, F.lit(2).alias("stage"), "set", "area_pr")])


def inner_fold_rows(tagged: DataFrame, inner: DataFrame, layout: GroupLayout, sim: int) -> DataFrame:
    """Training rows of an outer fold with their inner fold, -1 without one; ``tagged`` is stored in ``layout``."""
    train = tagged.filter((F.col(OUTER) != sim) & (F.col(PART) == STUDY)).drop(OUTER, PART)
    return layout.attach(train, inner, "left").fillna(-1, [INNER]).drop(SLICE_COL)


def _outer_fold(
    tagged: DataFrame, outer: DataFrame, layout: GroupLayout, sim: int, config: TwoStageConfig, out: str
) -> DataFrame:
    """One outer fold: nested first stage, cut, second stage. Returns the training rows with all inner scores."""
    key = {OUTER: sim}
    inner = inner_fold_table(outer, sim, config.n_inner, config.seed)
    # the fits read the stored rows and keep their own blocks: no further copy in memory
    train = materialise(inner_fold_rows(tagged, inner, layout, sim), "inner-folds")
    n_rows, width = train.count(), feature_count(train, "features")
    budget, sized = fit_budget(tagged.sparkSession), fitting_partitions(train, n_rows, width)

    def fit_one(j: int) -> LogisticRegressionModel:
        with budget.block(block_bytes(n_rows, width)):  # shared by the outer folds that run at the same time
            return fit_unpenalised(sized.filter(F.col(INNER) != j), config)

    if 0 < width <= MOST_COLUMNS:
        # all inner models from the same passes over the stored rows; nothing is kept in memory
        wanted = [WantedFit(left_out=j) for j in range(config.n_inner)]
        models = fit_together(train, width, wanted, INNER, max_iter=config.max_iter)
    else:
        fit = inheritable_thread_target(tagged.sparkSession)(fit_one)
        with ThreadPool(min(config.parallelism, config.n_inner)) as pool:
            models = pool.map(fit, range(config.n_inner))
    # one pass: every training row with the score of every inner model
    scored, names = score_with_all(train, models)
    all_scores = F.array(*[F.col(n) for n in names])
    scored = materialise(scored.withColumn("_scores", all_scores).drop(*names), "first-stage")
    held_out = held_out_scores(scored)

    tested = materialise(
        mean_score(tagged.filter(F.col(OUTER) == sim).drop(OUTER, SLICE_COL), models, SCORE_COL), "first-stage-test"
    )

    columns = ["set", ID_COL, MATCH_COL, LABEL_COL, SCORE_COL]
    first = union_all(
        [
            held_out.withColumn("set", F.lit("train")).select(*columns),
            tested.withColumn("set", F.col(PART)).select(*columns),
        ]
    )
    write_results(first, run_path(f"{out}/first_stage", key), ["set"], config.result_format)

    cut = positive_score_cut(held_out, config.positive_share)
    if cut is None:
        raise ValueError(f"outer fold {sim} has no case among its training rows")
    train2 = second_stage_features(held_out.drop(INNER), cut)
    test2 = second_stage_features(tested, cut, keep=(MATCH_COL, ID_COL, LABEL_COL, PART))
    if width < MOST_COLUMNS:
        (model,) = fit_together(train2, width + 1, [WantedFit()], max_iter=config.max_iter)
    else:
        n_second = train2.count()
        with budget.block(block_bytes(n_second, width + 1)):
            model = fit_unpenalised(fitting_partitions(train2, n_second, width + 1), config)
    second = union_all(
        [
            score_with(train2, model).withColumn("set", F.lit("train")).select(*columns),
            score_with(test2, model).withColumn("set", F.col(PART)).select(*columns),
        ]
    )
    write_results(second, run_path(f"{out}/second_stage", key), ["set"], config.result_format)
    return scored
