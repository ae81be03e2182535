"""Clustering, score merging, cross-validation and the two whole flows."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from twinfold.operators import clustering as G
from twinfold.operators import crossval as V
from twinfold.operators import distance as D
from twinfold.operators import scores as S
from twinfold.operators.evaluator import PrecisionRecallEvaluator
from twinfold.plans.cluster_flow import ClusterFlowConfig, cluster_then_classify, flow_metrics
from twinfold.plans.two_stage import TwoStageConfig, two_stage

FLAGS = ["A_FLAG", "B_FLAG"]


def people(seed=1, groups=40, controls=4, scoring=3):
    rng = random.Random(seed)
    rows, pid = [], 0

    def person(match, label):
        nonlocal pid
        pid += 1
        lift = 0.5 if label else 0.0
        return (match, float(label), pid, int(rng.random() < 0.3 + lift), int(rng.random() < 0.5), rng.random() + lift)

    pos = [person(m, 1) for m in range(groups)]
    neg = [person(m, 0) for m in range(groups) for _ in range(controls)]
    ss = [person(m, 0) for m in range(groups + 5) for _ in range(scoring)]
    return pos, neg, ss


SCHEMA = "matched_positive_id int, label double, patid int, A_FLAG int, B_FLAG int, AGE double"


@pytest.fixture(scope="module")
def cohort(spark):
    return tuple(spark.createDataFrame(t, SCHEMA) for t in people())


def test_kmeans_assigns_the_nearest_centre(cohort):
    pos = cohort[0]
    model, clustered = G.cluster_rows(pos, FLAGS, k=3, seed=5)
    centres = G.centres_of(model)
    for row in clustered.collect():
        dists = {i: math.dist((row.A_FLAG, row.B_FLAG), c) for i, c in centres.items()}
        assert row.dist == pytest.approx(min(dists.values())) == pytest.approx(dists[row.cluster_id])
    shares = D.cluster_shares(clustered).collect()
    assert sum(r.n_rows for r in shares) == 40 and sum(r.share for r in shares) == pytest.approx(1)
    with pytest.raises(ValueError):
        G.cluster_rows(clustered, FLAGS)


def test_fewer_points_than_clusters(spark):
    pos = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "patid int, A_FLAG int, B_FLAG int")
    model, clustered = G.cluster_rows(pos, FLAGS, k=3)
    assert clustered.count() == 2 and len(G.centres_of(model)) >= 1


@pytest.mark.parametrize("share", [0.25, 0.375, 1.0])
def test_similar_controls(cohort, share):
    pos, neg, _ = cohort
    cases = pos.filter("matched_positive_id < 7")
    centre = [0.2, 0.9]
    got = {r.patid for r in G.similar_controls(neg, cases, FLAGS, centre, share).collect()}
    n = math.floor(4 * share + 0.5)
    want = set()
    for m in range(7):
        group = [r for r in people()[1] if r[0] == m]
        want |= {p for _, p in sorted((math.dist(r[3:5], centre), r[2]) for r in group)[:n]}
    assert got == want


def test_test_rows_split_and_discarded(cohort):
    ss = cohort[2]
    near, rest = G.split_test_rows(ss, FLAGS, [1.0, 0.0], 0.3)
    want = sorted((math.dist(r[3:5], (1.0, 0.0)), r[2]) for r in people()[2])
    k = math.floor(len(want) * 0.3 + 0.5)
    assert {r.patid for r in near.collect()} == {p for _, p in want[:k]}
    assert {r.patid for r in rest.collect()} == {p for _, p in want[k:]}
    whole = G.with_discarded(near.withColumn("prob_1", F.lit(0.5)), ss)
    assert whole.count() == ss.count() and whole.filter("prob_1 = 0").count() == rest.count()


def test_score_averages(spark):
    tables = {m: spark.createDataFrame([(i, 1.0, 0.1 * (m + 1) * i) for i in range(m, 5)], "patid int, label double, prob_1 double") for m in range(3)}
    merged = S.average_scores(S.union_scores(tables, "model_id"), 3)
    assert {r.patid: round(r.avg_prob, 9) for r in merged.collect()} == {i: round(0.2 * i, 9) for i in (2, 3, 4)}
    assert S.union_scores(list(tables.values())).count() == 12


def test_mean_score_equals_averaged_tables(cohort):
    pos, neg, _ = cohort
    rows = G.assemble(pos.unionByName(neg), ["A_FLAG", "AGE"])
    models = [LogisticRegression(regParam=r).fit(rows) for r in (0.0, 0.1)]
    stacked = S.union_scores({i: S.score_with(rows, m) for i, m in enumerate(models)}, "model_id")
    want = {r.patid: r.avg_prob for r in S.average_scores(stacked, 2).collect()}
    got = {r.patid: r.avg_prob for r in S.mean_score(rows, models).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_second_stage(spark):
    rows = [(i, 1.0, i, Vectors.dense([float(i)]), i / 10) for i in range(1, 10)]
    df = spark.createDataFrame(rows, ["matched_positive_id", "label", "patid", "features", "prob_1"])
    cut = S.positive_score_cut(df)
    assert cut == pytest.approx(np.percentile([r[4] for r in rows], 75))
    got = {r.patid: list(r.features) for r in S.second_stage_features(df, cut).collect()}
    assert got == {i: [float(i), pytest.approx(math.log10(i / 10))] for i in (7, 8, 9)}


def manual_cv(data, est, grid, evaluator, folds):
    """Mean metric per parameter set, by plain loops."""
    table = []
    for params in grid:
        values = []
        for i in folds:
            model = est.fit(data.filter(F.col("foldID") != i), params)
            values.append(evaluator.evaluate(model.transform(data.filter(F.col("foldID") == i))))
        table.append(float(np.mean(values)))
    return table


@pytest.fixture(scope="module")
def regression(spark):
    rng = random.Random(6)
    rows = [(Vectors.dense([rng.random(), rng.random()]), rng.random(), i % 3) for i in range(60)]
    return spark.createDataFrame([(x, float(x[0] * 2 + y), f) for x, y, f in rows], ["features", "y", "foldID"]).cache()


def test_cv_with_a_metric_that_gets_smaller(regression):
    lr = LinearRegression(featuresCol="features", labelCol="y")
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0, 0.01]).addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    evaluator = RegressionEvaluator(predictionCol="prediction", labelCol="y")
    cv = V.FoldCrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=evaluator, stratifyCol="foldID", parallelism=4)
    model = cv.fit(regression)
    got = [r["metric for CV rmse"] for r in model.avgMetrics.collect()]
    assert got == pytest.approx(manual_cv(regression, lr, grid, evaluator, range(3)))
    assert cv.bestIndex == int(np.argmin(got)) and cv.getBestModelParams()["regParam"] == 0.01


def test_cv_with_text_parameters(regression):
    rf = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=3, seed=1)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, [2, 4]).addGrid(rf.featureSubsetStrategy, ["sqrt", "1"]).build()
    cv = V.FoldCrossValidator(
        estimator=rf,
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(labelCol="y"),
        stratifyCol="foldID",
        parallelism=4,
    )
    rows = cv.fit(regression).avgMetrics.collect()
    assert {(r.maxDepth, r.featureSubsetStrategy) for r in rows} == {(d, s) for d in (2.0, 4.0) for s in ("sqrt", "1")}


def test_cv_with_other_metrics(cohort):
    pos, neg, _ = cohort
    rows = G.assemble(pos.unionByName(neg), ["A_FLAG", "B_FLAG", "AGE"]).withColumn("foldID", F.col("matched_positive_id") % 3).cache()
    lr = LogisticRegression()
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 1.0]).build()
    evaluator = PrecisionRecallEvaluator(rawPredictionCol="probability")
    others = [{"metricName": "precisionAtGivenRecall", "metricParams": {"recallValue": r}} for r in (0.05, 0.5)]
    cv = V.FoldCrossValidator(
        estimator=lr,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        stratifyCol="foldID",
        evaluateOtherMetrics=True,
        otherMetrics=others,
        parallelism=4,
    )
    table = cv.fit(rows).avgMetrics
    names = ["precisionAtGivenRecall at recallValue 0.05", "precisionAtGivenRecall at recallValue 0.5"]
    assert table.columns == ["paramSetID", "regParam", "metric for CV areaUnderROC", *names]
    got = table.collect()
    assert [r["metric for CV areaUnderROC"] for r in got] == pytest.approx(manual_cv(rows, lr, grid, evaluator, range(3)))
    half = evaluator.copy().setMetricName("precisionAtGivenRecall").setMetricParams({"recallValue": 0.5})
    assert [r[names[1]] for r in got] == pytest.approx(manual_cv(rows, lr, grid, half, range(3)))


def test_cv_refuses_bad_input(spark, cohort):
    with pytest.raises(ValueError):
        V.FoldCrossValidator()
    with pytest.raises(TypeError):
        V.FoldCrossValidator(stratifyCol="f", evaluator=RegressionEvaluator(), evaluateOtherMetrics=True)
    lr = LogisticRegression()
    cv = V.FoldCrossValidator(
        estimator=lr, estimatorParamMaps=[{}], evaluator=PrecisionRecallEvaluator(), stratifyCol="patid"
    )
    with pytest.raises(ValueError):
        cv.fit(G.assemble(cohort[0], ["AGE"]))


def test_best_row_ignores_missing_values_and_prefers_low_ids(spark):
    table = spark.createDataFrame([(0, float("nan")), (1, 0.5), (2, 0.5), (3, None)], "paramSetID int, `m x` double")
    assert [r.is_best for r in V.mark_best(table, "m x").orderBy("paramSetID").collect()] == [False, True, False, False]
    smaller = V.mark_best(table, "m x", larger_better=False).filter("is_best").collect()
    assert [r.paramSetID for r in smaller] == [1]


def test_cluster_flow(cohort, tmp_path):
    config = ClusterFlowConfig(
        n_clusters=2, n_eval_folds=2, n_cv_folds=2, lambdas=(0.1,), alphas=(0.0, 0.5), recalls=(0.1, 0.5), max_iter=20
    )
    result = cluster_then_classify(*cohort, config, str(tmp_path / "run"))
    rows = result.predictions.collect()
    # every row of a held-out group once per cluster; scoring rows of groups without a case stay out
    per_cluster = {}
    for r in rows:
        per_cluster.setdefault((r.fold, r.cluster), []).append(r)
    clusters = {f: sum(1 for k in per_cluster if k[0] == f) for f in (0, 1)}
    assert all(1 <= n <= 2 for n in clusters.values())
    ids = {f: {r.patid for r in rows if r.fold == f} for f in (0, 1)}
    assert len(ids[0] | ids[1]) == 40 * (1 + 4 + 3) and not ids[0] & ids[1]
    loops = {(r.fold, r.cluster): r for r in result.loops.collect()}
    for key, members in per_cluster.items():
        near = [r for r in members if r.near]
        assert len(near) == math.floor(len(members) * loops[key].share + 0.5)
        assert all(r.prob_1 == 0.0 for r in members if not r.near) and all(0 < r.prob_1 < 1 for r in near)
        assert loops[key].n_test == len(members)
    assert {r.scope for r in result.metrics.collect()} == {"fold+cluster", "fold", "all"}
    assert result.cv_metrics.filter("is_best").count() == len(per_cluster)
    assert {r.name: r.value for r in result.manifest.collect()}["n_rows_neg"] == "160"
    best = flow_metrics(result.predictions, ClusterFlowConfig(recalls=(0.1,), combine="max"))
    assert best.filter("scope = 'all'").count() == 1
    with pytest.raises(ValueError):
        flow_metrics(result.predictions, ClusterFlowConfig(combine="first"))


def test_two_stage_flow(cohort, tmp_path):
    pos, neg, ss = cohort
    orphan = neg.limit(1).withColumn("matched_positive_id", F.lit(999)).withColumn("patid", F.lit(9999))
    result = two_stage(
        pos, neg.unionByName(orphan), ss, TwoStageConfig(n_outer=2, n_inner=2, recalls=(0.1,)), str(tmp_path / "run")
    )
    first = result.first_stage.collect()
    ids = {(r.sim, r.set): [x.patid for x in first if (x.sim, x.set) == (r.sim, r.set)] for r in first}
    assert set(ids) == {(s, p) for s in (0, 1) for p in ("train", "test", "rep")}
    for sim in (0, 1):
        train, test = set(ids[sim, "train"]), set(ids[sim, "test"])
        # every study row once, either held out in an inner fold or in the outer test fold
        assert len(train | test) == 200 and not train & test and len(ids[sim, "train"]) == len(train)
    assert 9999 not in {r.patid for r in first}
    second = result.second_stage.collect()
    assert second and all(0 <= r.prob_1 <= 1 for r in second)
    for sim in (0, 1):
        cut = np.percentile([r.prob_1 for r in first if (r.sim, r.set) == (sim, "train") and r.label == 1], 75)
        for part in ("train", "test", "rep"):
            want = {r.patid for r in first if (r.sim, r.set) == (sim, part) and r.prob_1 >= cut}
            assert {r.patid for r in second if (r.sim, r.set) == (sim, part)} == want
    assert {(r.stage, r.set) for r in result.areas.collect()} >= {(1, "train"), (1, "held_out"), (2, "train")}
    assert result.precision.filter("scope = 'all'").count() == 1


def test_validator_keeps_weights_and_refuses_to_be_saved(spark, tmp_path):
    rng = random.Random(21)
    rows = []
    for i in range(240):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((Vectors.dense([x, z]), float(x + rng.gauss(0, 1) > 0.4), i % 3, rng.choice([0.5, 1.0, 4.0]), f"t{i}"))
    data = spark.createDataFrame(rows, ["features", "label", "foldID", "weight", "text"])
    lr = LogisticRegression(weightCol="weight", maxIter=30)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.3, 3.0]).build()
    evaluator = BinaryClassificationEvaluator()
    cv = V.FoldCrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=evaluator, stratifyCol="foldID", parallelism=4)
    assert isinstance(cv.getBestModelParams(), str)
    model = cv.fit(data)
    want = manual_cv(data, lr, grid, evaluator, range(3))
    table = model.avgMetrics.collect()
    assert [r["metric for CV areaUnderROC"] for r in table] == pytest.approx(want)
    assert model.bestIndex == want.index(max(want)) == cv.bestIndex == model.copy().bestIndex
    refit = lr.fit(data, grid[model.bestIndex])
    assert model.bestModel.coefficients.toArray() == pytest.approx(refit.coefficients.toArray(), abs=1e-6)
    for thing in (model, cv):
        with pytest.raises(NotImplementedError):
            thing.write()
