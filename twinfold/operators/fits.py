"""Running many model fits side by side: bounded memory, partitions that suit the data, and certificates of the results."""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES_PER_VALUE = 8
PARTITION_BYTES = 16 << 20
WEIGHT_COL = "row_weight"


class FitBudget:
    """Lets fits of all thread pools of a process run as long as their estimated blocks fit into ``total_bytes`` together.

    A fit that is larger than the whole budget runs alone.
    """

    def __init__(self, total_bytes: int):
        self.total_bytes = total_bytes
        self.in_use = self.most_in_use = 0
        self._change = threading.Condition()

    @contextmanager
    def block(self, estimated_bytes: int) -> Iterator[None]:
        """Wait until a fit of this size may run, and count it while it does."""
        size = min(max(1, estimated_bytes), self.total_bytes)
        with self._change:
            self._change.wait_for(lambda: self.in_use + size <= self.total_bytes)
            self.in_use += size
            self.most_in_use = max(self.most_in_use, self.in_use)
        try:
            yield
        finally:
            with self._change:
                self.in_use -= size
                self._change.notify_all()


def memory_bytes(text: str) -> int:
    """Bytes of a memory setting such as ``4g``."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    text = text.strip().lower().removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text[-1:] in units else int(text)


_budgets: dict[int, FitBudget] = {}
_lock = threading.Lock()


def fit_budget(spark: SparkSession, share: float = 0.3) -> FitBudget:
    """The budget that all validators of a session share: ``share`` of the memory of its executors (locally the driver)."""
    context = spark.sparkContext
    with _lock:
        if id(context) not in _budgets:
            local = context.master.startswith("local[") or context.master == "local"
            setting = "spark.driver.memory" if local else "spark.executor.memory"
            each = memory_bytes(context.getConf().get(setting, "1g"))
            executors = 1 if local else max(1, int(context.getConf().get("spark.executor.instances", "1")))
            _budgets[id(context)] = FitBudget(int(share * each * executors))
        return _budgets[id(context)]


def block_bytes(rows: int, features: int) -> int:
    """Estimated size of the blocks of a fit: features, label and weight of every row."""
    return rows * (features + 2) * BYTES_PER_VALUE


def fitting_partitions(df: DataFrame, rows: int, features: int) -> DataFrame:
    """``df`` in no more partitions than its size asks for: every step of a fit runs a task per partition."""
    return df.coalesce(max(1, math.ceil(block_bytes(rows, features) / PARTITION_BYTES)))


def compressed(df: DataFrame, keys: Sequence[str], weight_col: str = WEIGHT_COL) -> DataFrame:
    """One row per different combination of ``keys`` (features, label, fold), with the number of rows as its weight.

    A loss that adds up over rows is the same. Rows are combined map-side.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(weight_col))


def weighted_penalty(reg: float, alpha: float, weights: float, squares: float) -> tuple[float, float]:
    """Penalty and mix for weighted rows that equal ``reg`` and ``alpha`` on the rows one by one.

    Spark scales columns by a deviation whose divisor is the number of rows less one, and for weighted rows the sum of
    weights less the sum of their squares over that sum. All columns are scaled by the same factor between the two, which
    the linear part of the penalty takes once and the square part twice.
    """
    if reg == 0:
        return reg, alpha
    factor = math.sqrt((weights - 1) / (weights - squares / weights)) if weights > squares / weights else 1.0
    linear, square = reg * alpha / factor, reg * (1 - alpha) / factor**2
    return linear + square, linear / (linear + square)


@dataclass(frozen=True)
class FittedLinear:
    """Penalty, mix, coefficients and intercept of one logistic model, and the column of vectors that it reads."""

    reg: float
    alpha: float
    coefficients: tuple[float, ...]
    intercept: float
    features_col: str = "features"

    def margin(self, values: str) -> Column:
        """Log odds of a row whose feature vector is the array column ``values``."""
        return F.expr(self._margin_sql(values))

    def probability(self, values: str) -> Column:
        """Positive probability of such a row."""
        return F.expr(f"1D / (1D + exp(-({self._margin_sql(values)})))")

    def _margin_sql(self, values: str) -> str:
        # as text: many models of many columns take one call each to build
        start = f"{self.intercept!r}D" if math.isfinite(self.intercept) else f"double('{self.intercept}')"
        return " + ".join([start, *[f"{w!r}D * `{values}`[{j}]" for j, w in enumerate(self.coefficients) if w]])


def fit_grid(df: DataFrame, columns: Sequence[str], grid: Sequence[tuple[float, float]], label_col: str = "label", **params) -> list[FittedLinear]:
    """Elastic-net logistic models of a grid of (penalty, mix) on plain columns, ``label_col`` being 0 or 1."""
    from twinfold.operators.clustering import assemble

    vectors = assemble(df, columns, keep=(label_col,)).persist()
    try:
        made = []
        for reg, alpha in grid:
            model = LogisticRegression(labelCol=label_col, regParam=reg, elasticNetParam=alpha, **params).fit(vectors)
            made.append(FittedLinear(reg, alpha, tuple(map(float, model.coefficients)), float(model.intercept)))
        return made
    finally:
        vectors.unpersist()


def elastic_net_certificate(
    df: DataFrame, columns: Sequence[str], models: Sequence[FittedLinear], label_col: str = "label", tolerance: float = 1e-4
) -> DataFrame:
    """``paramSetID, feature, deviation, gap, optimal`` of every model and column, the intercept's feature being ``''``.

    A model of standardised columns is optimal if and only if the slope of the mean log loss meets the penalty at every
    coefficient: equal and opposite to the penalty's slope where the coefficient is not 0, at most the linear penalty in
    size where it is. ``gap`` is how far that fails. The slopes of all models come from one aggregation; columns without
    deviation have no coefficient and no slope. ``optimal`` allows ``tolerance``, as the fits end by a tolerance too.
    """
    y = F.col(label_col).cast("double")
    n = F.count(F.lit(1)).cast("double")
    spread = [F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_d{j}") for j, c in enumerate(columns)]
    slopes = []
    for m, model in enumerate(models):
        margin = F.lit(model.intercept)
        for c, w in zip(columns, model.coefficients):
            margin = margin + F.lit(w) * F.col(c)
        off = 1 / (1 + F.exp(-margin)) - y
        slopes.append((F.sum(off) / n).alias(f"_s{m}_"))
        slopes += [(F.sum(off * F.col(c)) / n).alias(f"_s{m}_{j}") for j, c in enumerate(columns)]
    sums = df.agg(*spread, *slopes)
    rows = []
    for m, model in enumerate(models):
        rows.append(F.struct(F.lit(m).alias("paramSetID"), F.lit("").alias("feature"), F.lit(None).cast("double").alias("deviation"), F.abs(F.col(f"_s{m}_")).alias("gap")))
        for j, (c, w) in enumerate(zip(columns, model.coefficients)):
            d = F.col(f"_d{j}")
            slope = F.col(f"_s{m}_{j}") / d + F.lit(model.reg * (1 - model.alpha) * w) * d
            linear = model.reg * model.alpha
            gap = F.abs(slope + math.copysign(linear, w)) if w else F.greatest(F.abs(slope) - linear, F.lit(0.0))
            gap = F.when(d > 0, gap).otherwise(F.lit(abs(w)))
            rows.append(F.struct(F.lit(m).alias("paramSetID"), F.lit(c).alias("feature"), d.alias("deviation"), gap.alias("gap")))
    found = sums.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    return found.withColumn("optimal", F.col("gap") <= tolerance)


def kmeans_certificate(clustered: DataFrame, columns: Sequence[str], centres: dict[int, Sequence[float]], cluster_col: str, tolerance: float = 1e-3) -> DataFrame:
    """``cluster, n_rows, share, nearest, mean_gap, fixed`` of every cluster, from one aggregation over the assignment.

    A K-means result is a fixed point if every row is with its nearest centre and every centre is the mean of its rows:
    ``nearest`` counts the rows for which the first holds, ``mean_gap`` is the largest distance of a centre's coordinate
    from the mean. ``fixed`` allows ``tolerance``, as the fit ends by one too.
    """
    def distance(centre: Sequence[float]):
        return sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(columns, centre)), F.lit(0.0))

    own = F.lit(None).cast("double")
    for k, centre in centres.items():
        own = F.when(F.col(cluster_col) == k, distance(centre)).otherwise(own)
    away = [distance(c) for c in centres.values()]
    least = F.least(*away) if len(away) > 1 else away[0]
    per = clustered.groupBy(F.col(cluster_col).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(own <= least + 1e-9).alias("nearest"), *[F.avg(c).alias(f"_m{j}") for j, c in enumerate(columns)]
    )
    gap = F.lit(None).cast("double")
    for k, centre in centres.items():
        off = [F.abs(F.col(f"_m{j}") - float(x)) for j, x in enumerate(centre)]
        gap = F.when(F.col("cluster") == k, F.greatest(*off) if len(off) > 1 else off[0]).otherwise(gap)
    share = F.col("n_rows") / per.agg(F.sum("n_rows")).scalar()
    found = per.select("cluster", "n_rows", share.alias("share"), "nearest", gap.alias("mean_gap"))
    return found.withColumn("fixed", (F.col("nearest") == F.col("n_rows")) & (F.col("mean_gap") <= tolerance))


def feature_count(df: DataFrame, features_col: str) -> int:
    """Length of the feature vectors; 0 for an empty table."""
    first = df.select(F.size(vector_to_array(features_col)).alias("n")).first()
    return first["n"] if first else 0
