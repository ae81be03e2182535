"""Evaluator for areas under curves and precision at given recalls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark import keyword_only
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.columns import positive_score
from twinfold.operators.curve import areas, metric_name, pr_curve, precision_at_recalls

# Metric names and the default metric list.
AREA_ROC = "areaUnderROC"
AREA_PR = "areaUnderPR"
AT_RECALL = "precisionAtGivenRecall"
AT_RECALLS = "precisionAtGivenMultipleRecalls"
DEFAULT_METRICS = (
    {"metricName": AREA_ROC},
    {"metricName": AREA_PR},
    {"metricName": AT_RECALL, "metricParams": {"recallValue": 0.05}},
)


def metric_key(spec: Mapping[str, Any]) -> str:
    """Result key of one metric specification."""
    return metric_name(spec["metricName"], spec.get("metricParams", {}).get("recallValue"))


class PrecisionRecallEvaluator(
    Evaluator, HasLabelCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Binary evaluator with areas under the ROC and PR curves and precision at given recalls.

    The prediction column holds a two-element vector (negative, positive) or the positive score.

    >>> at_tenth = PrecisionRecallEvaluator(metricName="precisionAtGivenRecall", metricParams={"recallValue": 0.1})
    >>> at_tenth.isLargerBetter()
    True
    """

    metricName: Param[str] = Param(
        Params._dummy(),
        "metricName",
        f"metric to evaluate ({AREA_ROC}|{AREA_PR}|{AT_RECALL}|{AT_RECALLS})",
        typeConverter=TypeConverters.toString,
    )
    metricParams: Param[dict] = Param(
        Params._dummy(), "metricParams", "settings of the metric: recallValue or recallValues"
    )

    @keyword_only
    def __init__(
        self,
        *,
        rawPredictionCol: str = "rawPrediction",
        labelCol: str = "label",
        metricName: str = AREA_ROC,
        metricParams: dict | None = None,
    ):
        super().__init__()
        self._setDefault(
            rawPredictionCol="rawPrediction",
            labelCol="label",
            metricName=AREA_ROC,
            metricParams={"recallValue": 0.6},
        )
        self._apply(self._input_kwargs)

    def _apply(self, values: Mapping[str, Any]) -> PrecisionRecallEvaluator:
        name = values.get("metricName")
        if name is not None and name not in (AREA_ROC, AREA_PR, AT_RECALL, AT_RECALLS):
            raise ValueError(f"invalid metricName {name!r}")
        return self._set(**{k: v for k, v in values.items() if v is not None})

    @keyword_only
    def setParams(
        self,
        *,
        rawPredictionCol: str = "rawPrediction",
        labelCol: str = "label",
        metricName: str = AREA_ROC,
        metricParams: dict | None = None,
    ) -> PrecisionRecallEvaluator:
        """Set several params at once."""
        return self._apply(self._input_kwargs)

    def setMetricName(self, value: str) -> PrecisionRecallEvaluator:
        """Set the metric."""
        return self._apply({"metricName": value})

    def getMetricName(self) -> str:
        """Current metric."""
        return self.getOrDefault(self.metricName)

    def setMetricParams(self, value: dict) -> PrecisionRecallEvaluator:
        """Set the settings of the metric."""
        return self._set(metricParams=value)

    def getMetricValue(self) -> dict:
        """Settings of the metric."""
        return self.getOrDefault(self.metricParams)

    getMetricParams = getMetricValue

    def setLabelCol(self, value: str) -> PrecisionRecallEvaluator:
        """Set the label column."""
        return self._set(labelCol=value)

    def setRawPredictionCol(self, value: str) -> PrecisionRecallEvaluator:
        """Set the prediction column."""
        return self._set(rawPredictionCol=value)

    def isLargerBetter(self) -> bool:
        """All metrics improve upwards."""
        return True

    def evaluate(self, dataset: DataFrame, params: Mapping | None = None) -> Any:
        """Value of the metric; a list of values for precision at several recalls.

        ``params`` overrides settings for this call, keyed by param or by param name.
        """
        if params is None:
            return self._evaluate(dataset)
        if not isinstance(params, Mapping):
            raise ValueError(f"params must be a param map, not {type(params)}")
        named = {(k.name if isinstance(k, Param) else k): v for k, v in params.items()}
        if named.get("metricName") in (AT_RECALL, AT_RECALLS) and "metricParams" not in named:
            raise ValueError(f"{named['metricName']!r} needs 'metricParams' in the same call")
        return self.copy()._apply(named)._evaluate(dataset)

    def _evaluate(self, dataset: DataFrame) -> Any:
        name, settings = self.getMetricName(), self.getMetricValue()
        if name in (AREA_ROC, AREA_PR):
            return self._area(dataset, name)
        key = "recallValue" if name == AT_RECALL else "recallValues"
        if key not in settings:
            raise ValueError(f"{name!r} needs {key!r} in metricParams")
        if name == AT_RECALL:
            return self._at_recalls(dataset, [settings[key]])[0]
        return self._at_recalls(dataset, list(settings[key]))

    def _scored(self, dataset: DataFrame, *keep: str) -> DataFrame:
        score = positive_score(dataset, self.getRawPredictionCol())
        return dataset.select(*keep, score.alias("_score"), F.col(self.getLabelCol()).cast("double").alias("_label"))

    def _area(self, dataset: DataFrame, name: str) -> float:
        exact = BinaryClassificationEvaluator(
            rawPredictionCol="_score", labelCol="_label", metricName=name, numBins=0
        )
        return exact.evaluate(self._scored(dataset))

    def _at_recalls(self, dataset: DataFrame, recalls: Sequence[float]) -> list[float | None]:
        found = precision_at_recalls(self.curve(dataset), sorted({float(r) for r in recalls})).collect()
        by_recall = {row.recall: row.precision for row in found}
        return [by_recall.get(float(r)) for r in recalls]

    def curve(self, dataset: DataFrame) -> DataFrame:
        """Precision-recall curve of the dataset on rounded scores."""
        return pr_curve(self._scored(dataset), "_score", "_label")

    def evaluateWithSeveralMetrics(
        self, dataset: DataFrame, metricSets: Sequence[Mapping] | None = None
    ) -> list[dict[str, float]]:
        """One ``{key: value}`` per metric specification, in the given order.

        All precisions come from one curve.
        """
        specs = list(DEFAULT_METRICS if metricSets is None else metricSets)
        recalls = [s["metricParams"]["recallValue"] for s in specs if s["metricName"] == AT_RECALL]
        precisions = dict(zip(recalls, self._at_recalls(dataset, recalls))) if recalls else {}
        results = []
        for spec in specs:
            if spec["metricName"] == AT_RECALL:
                value = precisions[spec["metricParams"]["recallValue"]]
            else:
                value = self.evaluate(dataset, spec)
            results.append({metric_key(spec): value})
        return results

    def evaluate_groups(
        self, dataset: DataFrame, by: Sequence[str], metricSets: Sequence[Mapping] | None = None
    ) -> DataFrame:
        """The same metrics for every group of rows, as ``(by..., metric, value)``."""
        specs = list(DEFAULT_METRICS if metricSets is None else metricSets)
        scored = self._scored(dataset, *by)
        tables = []
        recalls = sorted({float(s["metricParams"]["recallValue"]) for s in specs if s["metricName"] == AT_RECALL})
        if recalls:
            keys = {
                float(s["metricParams"]["recallValue"]): metric_key(s) for s in specs if s["metricName"] == AT_RECALL
            }
            names = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
            found = precision_at_recalls(pr_curve(scored, "_score", "_label", by), recalls, by)
            tables.append(found.select(*by, names[F.col("recall")].alias("metric"), F.col("precision").alias("value")))
        wanted = {AREA_ROC: "area_roc", AREA_PR: "area_pr"}
        plain = [s["metricName"] for s in specs if s["metricName"] in wanted]
        if plain:
            pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(wanted[m]).alias("value")) for m in plain])
            table = areas(scored, "_score", "_label", by)
            tables.append(table.select(*by, F.explode(pairs).alias("_m")).select(*by, "_m.metric", "_m.value"))
        result = tables[0]
        for table in tables[1:]:
            result = result.unionByName(table)
        return result
