"""Cross-validation on given fold ids, with a full table of metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.columns import positive_score_of
from twinfold.operators.cohort import union_all
from twinfold.operators.evaluator import DEFAULT_METRICS, PrecisionRecallEvaluator, metric_key
from twinfold.operators.fits import (
    WEIGHT_COL,
    FittedLinear,
    block_bytes,
    compressed,
    feature_count,
    fit_budget,
    fitting_partitions,
    weighted_penalty,
)
from twinfold.operators.folds import validate_folds
from twinfold.operators.joint_fits import MOST_COLUMNS, WantedFit, fit_together
from twinfold.operators.scores import score_linear

CV_METRIC = "metric for CV "


def average_fold_metrics(
    fold_metrics: DataFrame, metrics: Sequence[str], id_col: str = "paramSetID"
) -> DataFrame:
    """Mean over folds of each metric: one row per parameter set, one column per metric."""
    return fold_metrics.groupBy(id_col).pivot("metric", list(metrics)).agg(F.avg("value"))


def mark_best(table: DataFrame, metric_col: str, larger_better: bool = True, id_col: str = "paramSetID") -> DataFrame:
    """Append ``is_best``: the best metric value, the lowest id on ties. NaN and NULL never win."""
    value = F.col(f"`{metric_col}`")
    signed = value if larger_better else -value
    usable = F.when(value.isNotNull() & ~F.isnan(value), F.struct(signed, -F.col(id_col)))
    best = table.agg(F.max_by(F.col(id_col), usable).alias("_best"))
    joined = table.join(best, F.col(id_col) == F.col("_best"), "left")
    return joined.withColumn("is_best", F.col("_best").isNotNull()).drop("_best")


def _param_value(value: Any) -> str | float:
    return value if isinstance(value, str) else float(value)


def param_table(spark, param_maps: Sequence[Mapping[Param, Any]]) -> DataFrame:
    """One row per parameter set; text parameters stay text, all others become double."""
    names = [p.name for p in param_maps[0]]
    kinds = [T.StringType() if isinstance(v, str) else T.DoubleType() for v in param_maps[0].values()]
    fields = [T.StructField("paramSetID", T.IntegerType())]
    fields += [T.StructField(n, k) for n, k in zip(names, kinds)]
    rows = []
    for i, params in enumerate(param_maps):
        values = {p.name: _param_value(v) for p, v in params.items()}
        rows.append((i, *[values[n] for n in names]))
    return spark.createDataFrame(rows, T.StructType(fields))


def _columns_read(estimator: Estimator, dataset: DataFrame) -> list[str]:
    """Columns that the estimator's params name, such as features, label and weight; all columns when it has no
    features and label column of its own, as a pipeline."""
    if not (hasattr(estimator, "getFeaturesCol") and hasattr(estimator, "getLabelCol")):
        return dataset.columns
    named = {estimator.getOrDefault(p) for p in estimator.params if p.name.endswith("Col") and estimator.isDefined(p)}
    return [c for c in dataset.columns if c in named]


def _stack_scores(
    rows: DataFrame, models: Mapping[int, Model | FittedLinear], label: str, prediction: str, raw_col: str = ""
) -> DataFrame:
    """Every row once per model with that model's positive score, in one pass over the rows.

    Linear models give their log odds if ``prediction`` is the column ``raw_col``, and else their probability.
    """
    if all(isinstance(m, FittedLinear) for m in models.values()):
        kind = FittedLinear.margin if prediction == raw_col else FittedLinear.probability
        scored = score_linear(rows, {f"_score_{i}": m for i, m in models.items()}, kind)
    else:
        scored, names, kind = rows, rows.columns, None
        for index, model in models.items():
            transformed = model.transform(scored)
            kind = kind or transformed.schema[prediction].dataType
            name = f"_score_{index}"
            scored = transformed.select(*names, positive_score_of(prediction, kind).alias(name))
            names = [*names, name]
    scores = [F.struct(F.lit(i).alias("paramSetID"), F.col(f"_score_{i}").alias("score")) for i in models]
    return scored.select(label, F.explode(F.array(*scores)).alias("_s")).select(
        label, "_s.paramSetID", F.col("_s.score").alias(prediction)
    )


def _joint_grid(estimator: Estimator, param_maps: Sequence[Mapping[Param, Any]], evaluator, width: int) -> list[tuple[float, float]] | None:
    """Penalty and mix of every parameter set, if all can be fitted together: plain binary logistic regression with
    intercept on few columns, of which the evaluator reads the log odds or the probability."""
    if type(estimator) is not LogisticRegression or not isinstance(evaluator, PrecisionRecallEvaluator):
        return None
    bounds = ("lowerBoundsOnCoefficients", "upperBoundsOnCoefficients", "lowerBoundsOnIntercepts", "upperBoundsOnIntercepts")
    if any(estimator.isDefined(estimator.getParam(p)) for p in ("weightCol", *bounds)):
        return None
    plain = estimator.getFitIntercept() and estimator.getFamily() in ("auto", "binomial") and 0 < width <= MOST_COLUMNS
    scored = evaluator.getRawPredictionCol() in (estimator.getRawPredictionCol(), estimator.getProbabilityCol())
    if not (plain and scored and all({p.name for p in m} <= {"regParam", "elasticNetParam"} for m in param_maps)):
        return None
    sets = [estimator.copy({**m}) for m in param_maps]
    return [(e.getRegParam(), e.getElasticNetParam()) for e in sets]


class FoldCrossValidatorModel(CrossValidatorModel):
    """Best model, with ``avgMetrics`` as a DataFrame."""

    def __init__(self, bestModel: Model, avgMetrics: DataFrame, foldMetrics: DataFrame, bestIndex: int):
        super().__init__(bestModel)
        self.avgMetrics = avgMetrics
        self.foldMetrics = foldMetrics
        self.bestIndex = bestIndex

    def write(self):
        """Refused: the parent's writer holds neither the tables of metrics nor the fold column."""
        raise NotImplementedError("save bestModel and write avgMetrics as a table instead")

    def copy(self, extra: Mapping | None = None) -> FoldCrossValidatorModel:
        """Copy with a copied best model; the metric tables are shared."""
        return FoldCrossValidatorModel(
            self.bestModel.copy(extra), self.avgMetrics, self.foldMetrics, self.bestIndex
        )


class _Rows:
    """Different rows of features, label and fold with their numbers, and fits on them that equal fits on the rows one by
    one: the penalties are turned into those of weighted rows."""

    def __init__(self, data: DataFrame, estimator: Estimator, fold_col: str):
        if not (hasattr(estimator, "weightCol") and hasattr(estimator, "elasticNetParam")) or estimator.isDefined(estimator.weightCol):
            raise TypeError("compressRows needs a linear estimator without weights of its own")
        self._estimator, self._fold_col = estimator, fold_col
        self._keys = [estimator.getFeaturesCol(), estimator.getLabelCol()]
        self.rows = compressed(data, [*self._keys, fold_col])
        sums = self.rows.groupBy(fold_col).agg(F.sum(WEIGHT_COL).alias("w"), F.sum(F.col(WEIGHT_COL) ** 2).alias("s")).collect()
        self._sums = {r[fold_col]: (r["w"], r["s"]) for r in sums}

    def one_by_one(self, part: DataFrame) -> DataFrame:
        """The rows themselves, as many as there were; an array of their number per row unfolds in the same task."""
        return part.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(WEIGHT_COL).cast("int")))).drop("_copy", WEIGHT_COL)

    def fit(self, part: DataFrame, params: Mapping[Param, Any], left_out: int | None = None) -> Model:
        """Fit with the penalty that the rows one by one would have; the fold ``left_out`` is not in ``part``."""
        used = [v for k, v in self._sums.items() if k != left_out]
        weights, squares = sum(w for w, _ in used), sum(s for _, s in used)
        mine = self._estimator.copy({**params})
        mine = mine.copy({mine.weightCol: WEIGHT_COL})
        if mine.getOrDefault(mine.standardization):
            reg, alpha = weighted_penalty(mine.getRegParam(), mine.getElasticNetParam(), weights, squares)
            mine = mine.copy({mine.regParam: reg, mine.elasticNetParam: alpha})
        return mine.fit(part)

    def fits(self, fold: int, part: DataFrame, param_maps: Sequence[Mapping[Param, Any]]):
        """As ``fitMultiple``: an iterator of (index, model) that several threads may ask."""
        return _SharedFits(lambda i: self.fit(part, param_maps[i], fold), len(param_maps))


class _SharedFits:
    """Hands out indices under a lock and fits outside of it."""

    def __init__(self, fit_one, n: int):
        self._fit_one, self._left, self._lock = fit_one, iter(range(n)), Lock()

    def __next__(self) -> tuple[int, Model]:
        with self._lock:
            index = next(self._left)
        return index, self._fit_one(index)


class FoldCrossValidator(CrossValidator):
    """Cross-validator whose folds are given by a column of zero-based consecutive ids.

    >>> validator = FoldCrossValidator(
    ...     estimator=lr, estimatorParamMaps=grid, evaluator=evaluator, stratifyCol="foldID")  # doctest: +SKIP
    >>> model = validator.fit(data)  # doctest: +SKIP
    >>> model.avgMetrics.show()  # doctest: +SKIP
    """

    stratifyCol: Param[str] = Param(
        Params._dummy(), "stratifyCol", "column of fold ids", typeConverter=TypeConverters.toString
    )
    evaluateOtherMetrics: Param[bool] = Param(
        Params._dummy(), "evaluateOtherMetrics", "whether to report further metrics"
    )
    otherMetrics: Param[list] = Param(Params._dummy(), "otherMetrics", "further metrics to report")
    compressRows: Param[bool] = Param(
        Params._dummy(), "compressRows", "whether to fit on different rows with their numbers as weights"
    )

    @keyword_only
    def __init__(
        self,
        *,
        estimator: Estimator | None = None,
        estimatorParamMaps: list | None = None,
        evaluator=None,
        stratifyCol: str | None = None,
        evaluateOtherMetrics: bool = False,
        otherMetrics: list | None = None,
        compressRows: bool = False,
        parallelism: int = 1,
    ):
        values = self._input_kwargs
        super().__init__()
        if stratifyCol is None:
            raise ValueError("stratifyCol must be specified")
        self.bestIndex: int | None = None
        self._setDefault(evaluateOtherMetrics=False, otherMetrics=None, compressRows=False)
        self._apply(values)

    @keyword_only
    def setParams(
        self,
        *,
        estimator: Estimator | None = None,
        estimatorParamMaps: list | None = None,
        evaluator=None,
        stratifyCol: str | None = None,
        evaluateOtherMetrics: bool = False,
        otherMetrics: list | None = None,
        compressRows: bool = False,
        parallelism: int = 1,
    ) -> FoldCrossValidator:
        """Set several params at once."""
        return self._apply(self._input_kwargs)

    def _apply(self, values: Mapping[str, Any]) -> FoldCrossValidator:
        self._set(**{k: v for k, v in values.items() if v is not None})
        if self.getOrDefault(self.evaluateOtherMetrics):
            if not isinstance(self.getEvaluator(), PrecisionRecallEvaluator):
                raise TypeError("evaluateOtherMetrics needs a PrecisionRecallEvaluator")
        return self

    def _metric_specs(self) -> list[dict]:
        """Specifications whose metrics are reported next to the one that selects the model."""
        if not self.getOrDefault(self.evaluateOtherMetrics):
            return []
        return list(self.getOrDefault(self.otherMetrics) or DEFAULT_METRICS)

    def _fit(self, dataset: DataFrame) -> FoldCrossValidatorModel:
        fold_col = self.getOrDefault(self.stratifyCol)
        n_folds = validate_folds(dataset, fold_col)
        estimator, param_maps, evaluator = self.getEstimator(), self.getEstimatorParamMaps(), self.getEvaluator()
        data = dataset.select(*{**dict.fromkeys(_columns_read(estimator, dataset)), fold_col: None})
        spark = dataset.sparkSession
        whole = _Rows(data, estimator, fold_col) if self.getOrDefault(self.compressRows) else None
        if whole:
            data = whole.rows
        n_rows, width = data.count(), self._width(data)
        if width:
            data = fitting_partitions(data, n_rows, width)
        cached = not dataset.is_cached or bool(whole)
        if cached:
            data = data.persist(StorageLevel.MEMORY_AND_DISK)
        train = [data.filter(F.col(fold_col) != i).drop(fold_col) for i in range(n_folds)]
        validation = [data.filter(F.col(fold_col) == i).drop(fold_col) for i in range(n_folds)]
        grid = None if whole else _joint_grid(estimator, param_maps, evaluator, width)
        if whole:
            validation = [whole.one_by_one(part) for part in validation]
            fitted = [whole.fits(i, part, param_maps) for i, part in enumerate(train)]
        else:
            fitted = [estimator.fitMultiple(part, param_maps) for part in train]
        budget, size = fit_budget(spark), block_bytes(n_rows, width)

        def fit_within(fold: int):
            with budget.block(size):  # shared with the validators of all other threads
                return fold, *next(fitted[fold])

        fit_next = inheritable_thread_target(spark)(fit_within)
        try:
            # all folds and parameter sets wait in one queue, so a small grid keeps every thread busy too
            with ThreadPool(min(self.getParallelism(), n_folds * len(param_maps))) as pool:
                queue = sorted([*range(n_folds)] * len(param_maps))
                if grid:
                    with budget.block(size):
                        models = self._fit_jointly(data, fold_col, width, n_folds, grid)
                else:
                    models = {(fold, i): m for fold, i, m in pool.map(fit_next, queue, chunksize=1)}
                if isinstance(evaluator, PrecisionRecallEvaluator):
                    rows = self._grouped_metrics(models, validation)
                else:
                    rows = self._single_metrics(models, validation, pool)
        finally:
            if cached:
                data.unpersist()
        fold_metrics = spark.createDataFrame(rows, "fold int, paramSetID int, metric string, value double")
        main = CV_METRIC + evaluator.getMetricName()
        names = [main, *[metric_key(s) for s in self._metric_specs()]]
        table = param_table(spark, param_maps).join(average_fold_metrics(fold_metrics, names), "paramSetID")
        marked = mark_best(table, main, evaluator.isLargerBetter())
        best = marked.filter("is_best").select("paramSetID").first()
        self.bestIndex = best.paramSetID if best else 0
        with budget.block(size):
            if whole:
                best_model = whole.fit(data.drop(fold_col), param_maps[self.bestIndex])
            else:
                best_model = estimator.fit(fitting_partitions(dataset, n_rows, width) if width else dataset, param_maps[self.bestIndex])
        model = FoldCrossValidatorModel(best_model, table.orderBy("paramSetID"), fold_metrics, self.bestIndex)
        return self._copyValues(model)

    def _fit_jointly(
        self, data: DataFrame, fold_col: str, width: int, n_folds: int, grid: Sequence[tuple[float, float]]
    ) -> dict[tuple[int, int], FittedLinear]:
        """The models of all folds and parameter sets, from the same passes over the rows."""
        lr = self.getEstimator()
        keys = [(fold, i) for fold in range(n_folds) for i in range(len(grid))]
        models = fit_together(
            data, width, [WantedFit(*grid[i], fold) for fold, i in keys], fold_col,
            lr.getFeaturesCol(), lr.getLabelCol(), lr.getMaxIter(), lr.getStandardization(),
        )
        return dict(zip(keys, models))

    def _width(self, data: DataFrame) -> int:
        """Length of the feature vectors, 0 if the estimator has no features column of vectors."""
        estimator = self.getEstimator()
        name = estimator.getFeaturesCol() if hasattr(estimator, "getFeaturesCol") else None
        if name not in data.columns or data.schema[name].dataType.typeName() != "vectorudt":
            return 0
        return feature_count(data, name)

    def _single_metrics(
        self, models: Mapping[tuple[int, int], Model], validation: Sequence[DataFrame], pool: ThreadPool
    ) -> list[tuple[int, int, str, float]]:
        """``(fold, paramSetID, metric, value)`` by one evaluator call per model."""
        evaluator, param_maps = self.getEvaluator(), self.getEstimatorParamMaps()
        main = CV_METRIC + evaluator.getMetricName()

        def one(key: tuple[int, int]) -> tuple[int, int, str, float]:
            fold, index = key
            scored = models[key].transform(validation[fold], param_maps[index])
            return fold, index, main, float(evaluator.evaluate(scored))

        return pool.map(inheritable_thread_target(validation[0].sparkSession)(one), list(models))

    def _grouped_metrics(
        self, models: Mapping[tuple[int, int], Model | FittedLinear], validation: Sequence[DataFrame]
    ) -> list[tuple[int, int, str, float]]:
        """The same rows from one table of all validation scores, evaluated per fold and parameter set."""
        evaluator = self.getEvaluator()
        label, prediction = evaluator.getLabelCol(), evaluator.getRawPredictionCol()
        estimator = self.getEstimator()
        raw_col = estimator.getRawPredictionCol() if hasattr(estimator, "getRawPredictionCol") else ""
        stacked = union_all(
            [
                _stack_scores(rows, {i: m for (f, i), m in models.items() if f == fold}, label, prediction, raw_col)
                .withColumn("fold", F.lit(fold))
                for fold, rows in enumerate(validation)
            ]
        )
        main = evaluator.getMetricName()
        spec: dict[str, Any] = {"metricName": main}
        if not main.startswith("area"):
            spec["metricParams"] = evaluator.getMetricValue()
        wanted = [(CV_METRIC + main, spec), *[(metric_key(s), s) for s in self._metric_specs()]]
        unique = {metric_key(s): s for _, s in wanted}
        # areas read the scores a second time: keep them rather than score again
        keep = any(name.startswith("area") for name in unique)
        if keep:
            stacked.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = evaluator.evaluate_groups(stacked, ["fold", "paramSetID"], list(unique.values())).collect()
        finally:
            if keep:
                stacked.unpersist()
        values = {(r.fold, r.paramSetID, r.metric): r.value for r in found}
        return [
            (fold, index, name, math.nan if (v := values.get((fold, index, metric_key(s)))) is None else float(v))
            for fold, index in models
            for name, s in wanted
        ]

    def write(self):
        """Refused: the parent's reader cannot restore the fold column."""
        raise NotImplementedError("build the validator anew; its parts can be saved")

    def getBestModelParams(self) -> dict[str, Any] | str:
        """Parameters chosen by the last ``fit``."""
        if self.bestIndex is None:
            return "Cross-validation has not run yet."
        return {p.name: v for p, v in self.getEstimatorParamMaps()[self.bestIndex].items()}

    def copy(self, extra: Mapping | None = None) -> FoldCrossValidator:
        """Copy with copied estimator and evaluator, as the parent class does."""
        other = super().copy(extra)
        other.bestIndex = self.bestIndex
        return other
