"""Curves, areas and the evaluator, against hand values and brute force."""

import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors

from twinfold.operators import curve as C
from twinfold.operators.evaluator import PrecisionRecallEvaluator
from twinfold.operators.ranking import quantile_bounds

# The seven scored rows by which evaluators of this kind are commonly shown.
SEVEN = [(0.1, 0.0), (0.1, 1.0), (0.4, 0.0), (0.6, 0.0), (0.6, 1.0), (0.6, 1.0), (0.8, 1.0)]


def scored(spark, rows):
    return spark.createDataFrame([(float(s), float(y)) for s, y in rows], "prob_1 double, label double")


def brute_curve(rows, digits=3):
    points = {}
    for s in {round(x, digits) for x, _ in rows}:
        chosen = [y for x, y in rows if round(x, digits) >= s]
        points[s] = (sum(1 for y in chosen if y == 1), sum(1 for y in chosen if y != 1))
    return points


def brute_at_recall(rows, recall):
    curve = brute_curve(rows)
    most = max(t for t, _ in curve.values())
    points = [(1.0, 0.0)] + [(t / (t + f + 1e-12), t / most if most else None) for t, f in curve.values()]
    points = [(p, r) for p, r in points if r is not None]
    least = min(abs(r - recall) for _, r in points)
    near = [(r, -p) for p, r in points if abs(abs(r - recall) - least) < 1e-9]
    return -min(near)[1]


@pytest.fixture(scope="module")
def seven(spark):
    return spark.createDataFrame([(Vectors.dense([1 - s, s]), y) for s, y in SEVEN], ["raw", "label"])


def test_seven_row_example(spark, seven):
    ev = PrecisionRecallEvaluator(
        rawPredictionCol="raw", metricName="precisionAtGivenRecall", metricParams={"recallValue": 1}
    )
    assert ev.evaluate(seven) == pytest.approx(4 / 7)
    assert ev.evaluate(seven, {ev.metricName: "areaUnderPR"}) == pytest.approx(0.8339, abs=1e-4)
    assert ev.evaluate(seven, {"metricName": "areaUnderROC"}) == pytest.approx(0.7083, abs=1e-4)
    assert ev.isLargerBetter()


def test_several_metrics_keep_order(seven):
    ev = PrecisionRecallEvaluator(rawPredictionCol="raw")
    specs = [
        {"metricName": "precisionAtGivenRecall", "metricParams": {"recallValue": 0.9}},
        {"metricName": "areaUnderPR"},
        {"metricName": "precisionAtGivenRecall", "metricParams": {"recallValue": 0.25}},
    ]
    got = ev.evaluateWithSeveralMetrics(seven, specs)
    assert [list(g)[0] for g in got] == [
        "precisionAtGivenRecall at recallValue 0.9",
        "areaUnderPR",
        "precisionAtGivenRecall at recallValue 0.25",
    ]
    assert list(got[0].values())[0] == pytest.approx(brute_at_recall(SEVEN, 0.9))
    assert list(got[2].values())[0] == pytest.approx(brute_at_recall(SEVEN, 0.25))
    default = ev.evaluateWithSeveralMetrics(seven)
    assert [list(g)[0] for g in default] == [
        "areaUnderROC",
        "areaUnderPR",
        "precisionAtGivenRecall at recallValue 0.05",
    ]


def test_multiple_recalls_and_param_errors(seven):
    ev = PrecisionRecallEvaluator(rawPredictionCol="raw")
    many = {"metricName": "precisionAtGivenMultipleRecalls", "metricParams": {"recallValues": [1, 0.25, 1]}}
    assert ev.evaluate(seven, many) == pytest.approx([4 / 7, 1.0, 4 / 7])
    with pytest.raises(ValueError):
        ev.evaluate(seven, {"metricName": "precisionAtGivenRecall"})
    with pytest.raises(ValueError):
        ev.evaluate(seven, {"metricName": "precisionAtGivenRecall", "metricParams": {}})
    with pytest.raises(ValueError):
        ev.evaluate(seven, {"metricName": "precisionAtGivenMultipleRecalls", "metricParams": {"recallValue": 1}})
    with pytest.raises(ValueError):
        ev.evaluate(seven, ["areaUnderPR"])
    with pytest.raises(ValueError):
        PrecisionRecallEvaluator(metricName="accuracy")
    with pytest.raises(ValueError):
        PrecisionRecallEvaluator(
            rawPredictionCol="raw", metricName="precisionAtGivenRecall", metricParams={"x": 1}
        ).evaluate(seven)


def test_setters_and_getters(seven):
    ev = PrecisionRecallEvaluator().setRawPredictionCol("raw")
    ev.setParams(metricName="precisionAtGivenRecall", metricParams={"recallValue": 1}, rawPredictionCol="raw")
    assert ev.getMetricName() == "precisionAtGivenRecall" and ev.getMetricValue() == {"recallValue": 1}
    assert ev.evaluate(seven) == pytest.approx(4 / 7)
    ev.setMetricName("areaUnderROC").setMetricParams({"recallValue": 0.5})
    assert ev.evaluate(seven) == pytest.approx(0.7083, abs=1e-4)
    assert ev.copy().getMetricName() == "areaUnderROC"


@pytest.mark.parametrize("seed", range(4))
def test_curve_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([rng.random(), rng.randint(0, 9) / 10]), rng.random() < 0.3) for _ in range(60)]
    df = scored(spark, rows)
    got = {r.score: (r.tps, r.fps) for r in C.score_curve(df).collect()}
    want = brute_curve(rows)
    assert {round(s, 3): v for s, v in got.items()} == want
    recalls = [0.025, 0.1, 0.5, 0.77, 1.0]
    found = C.precision_at_recalls(C.pr_curve(df), recalls).collect()
    for row in found:
        assert row.precision == pytest.approx(brute_at_recall(rows, row.recall))
    assert len(found) == len(recalls)


def test_unrounded_curve_with_buckets_equals_single_window(spark):
    rng = random.Random(7)
    rows = [(rng.random() ** 4, rng.random() < 0.3) for _ in range(3000)] + [(0.5, 1)] * 1500
    df = scored(spark, rows)
    counts = C.score_counts(df, digits=None)
    plain = {r.score: (r.tps, r.fps) for r in C.score_curve(df, digits=None).collect()}
    bounds = quantile_bounds(df, "prob_1", one_task_rows=100)
    assert len(bounds) > 100
    bucketed = C.curve_from_counts(counts, bounds=bounds)
    assert {r.score: (r.tps, r.fps) for r in bucketed.collect()} == plain and len(plain) > 2500
    assert "ReusedExchange" in bucketed._jdf.queryExecution().executedPlan().toString()
    want, got = C.areas(df).first(), C.areas_from_counts(counts, bounds=bounds).first()
    assert got.area_pr == pytest.approx(want.area_pr) and got.area_roc == pytest.approx(want.area_roc)


def test_ranks_are_dense_from_the_top(spark):
    got = C.score_curve(scored(spark, SEVEN), with_rank=True).collect()
    assert {r.score: r["rank"] for r in got} == {0.8: 0, 0.6: 1, 0.4: 2, 0.1: 3}


@pytest.mark.parametrize("by", [(), ("g",)])
def test_areas_equal_the_built_in_ones(spark, by):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 2), float(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g int, prob_1 double, label double")
    groups = {(): df} if not by else {(g,): df.filter(f"g = {g}") for g in (0, 1)}
    got = {tuple(r[c] for c in by): r for r in C.areas(df, by=by).collect()}
    for key, part in groups.items():
        for name, column in [("areaUnderROC", "area_roc"), ("areaUnderPR", "area_pr")]:
            want = BinaryClassificationEvaluator(rawPredictionCol="prob_1", metricName=name, numBins=0).evaluate(part)
            assert got[key][column] == pytest.approx(want, abs=1e-12)


def test_edge_cases(spark):
    none = scored(spark, [(0.2, 0), (0.7, 0)])
    curve = C.pr_curve(none).collect()
    assert sorted((r.precision, r.recall) for r in curve if r.recall is not None) == [(1.0, 0.0)]
    assert [r.precision for r in C.precision_at_recalls(C.pr_curve(none), [0.3]).collect()] == [1.0]
    everything = scored(spark, [(0.2, 1), (0.7, 1)])
    assert {r.recall for r in C.pr_curve(everything).collect()} == {0.0, 0.5, 1.0}
    one = scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0)])
    assert sorted((r.precision, r.recall) for r in C.pr_curve(one).collect()) == [
        (pytest.approx(1 / 3), 1.0),
        (1.0, 0.0),
    ]
    # recalls 0 and 1 are equally near 0.5: the smaller recall wins
    assert C.precision_at_recalls(C.pr_curve(one), [0.5]).first().precision == 1.0
    assert C.areas(none).first().area_roc is None


def test_scopes_add_up(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 2), rng.randint(0, 1), rng.random(), float(rng.random() < 0.3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "fold int, cluster int, prob_1 double, label double")
    table = C.metrics_by_scope(df, [0.1, 0.6], [("fold", "cluster"), ("fold",), ()]).collect()
    assert len(table) == (6 + 3 + 1) * 2
    for row in table:
        part = [
            (s, y)
            for f, c, s, y in rows
            if (row.fold is None or f == row.fold) and (row.cluster is None or c == row.cluster)
        ]
        assert row.value == pytest.approx(brute_at_recall(part, row.recall))


def test_grouped_metrics_equal_single_ones(spark):
    rng = random.Random(9)
    rows = [(g, rng.random(), float(rng.random() < 0.4)) for g in (0, 1) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, prob_1 double, label double")
    ev = PrecisionRecallEvaluator(rawPredictionCol="prob_1")
    got = {(r.g, r.metric): r.value for r in ev.evaluate_groups(df, ["g"]).collect()}
    for g in (0, 1):
        for entry in ev.evaluateWithSeveralMetrics(df.filter(f"g = {g}")):
            (name, value), = entry.items()
            assert got[g, name] == pytest.approx(value) and not math.isnan(value)


def test_unrounded_curves_gather_no_group_in_one_task(spark):
    df = scored(spark, [(i / 997, i % 3 == 0) for i in range(900)])
    curve = C.precision_at_recalls(C.pr_from_curve(C.curve_from_counts(C.score_counts(df, digits=None))), [0.1, 0.5])
    plan = C.pr_from_curve(spark.range(5).selectExpr("id AS tps", "id AS fps", "id / 7 AS score"))
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert curve.count() == 2
