"""Fits side by side: compression, budget, certificates, resumed flows."""

import random
import threading
import time
from pathlib import Path

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from twinfold.operators import clustering, crossval, curve, fits
from twinfold.operators.evaluator import PrecisionRecallEvaluator
from twinfold.plans import cluster_flow
from twinfold.plans.cluster_flow import ClusterFlowConfig, cluster_then_classify

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def repeated(spark):
    rng, rows = random.Random(5), []
    for i in range(900):
        a, b, c = rng.randint(0, 3), rng.randint(0, 1), 10 * rng.randint(0, 2)
        rows.append((Vectors.dense([a, b, c]), float(rng.random() < 0.15 + 0.2 * b + 0.1 * a), i % 3, a, b, c))
    return spark.createDataFrame(rows, ["features", "label", "foldID", *NAMES]).cache()


def validator(compress, parallelism=3):
    lr = LogisticRegression(maxIter=5000, tol=1e-11)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.02, 0.3]).addGrid(lr.elasticNetParam, [0.0, 0.5, 1.0]).build()
    return crossval.FoldCrossValidator(
        estimator=lr, estimatorParamMaps=grid, evaluator=PrecisionRecallEvaluator(rawPredictionCol="probability"),
        stratifyCol="foldID", compressRows=compress, parallelism=parallelism,
    )


def test_weighted_rows_give_the_same_models(repeated):
    lr = LogisticRegression(maxIter=5000, tol=1e-12)
    whole = crossval._Rows(repeated.select("features", "label", "foldID"), lr, "foldID")
    assert whole.rows.count() < 200
    for reg, alpha in ((0.0, 0.0), (0.05, 0.0), (0.05, 0.4), (0.02, 1.0)):
        params = {lr.regParam: reg, lr.elasticNetParam: alpha}
        one_by_one = lr.fit(repeated, params)
        together = whole.fit(whole.rows.drop("foldID"), params)
        assert together.coefficients.toArray() == pytest.approx(one_by_one.coefficients.toArray(), abs=1e-6)
        assert together.intercept == pytest.approx(one_by_one.intercept, abs=1e-6)


def test_compressed_cross_validation_chooses_alike(repeated):
    plain, packed = validator(False).fit(repeated), validator(True).fit(repeated)
    assert plain.bestIndex == packed.bestIndex
    theirs, ours = ({(r.fold, r.paramSetID, r.metric): r.value for r in m.foldMetrics.collect()} for m in (plain, packed))
    assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(theirs[k], abs=1e-6) for k in ours)
    assert packed.bestModel.coefficients.toArray() == pytest.approx(plain.bestModel.coefficients.toArray(), abs=1e-6)


def test_compression_refuses_other_estimators(spark, repeated):
    weighted = LogisticRegression(weightCol="a")
    with pytest.raises(TypeError):
        crossval._Rows(repeated, weighted, "foldID")


def test_budget_bounds_what_runs_together():
    budget, seen = fits.FitBudget(100), []

    def work(size):
        with budget.block(size):
            seen.append(budget.in_use)
            time.sleep(0.01)

    threads = [threading.Thread(target=work, args=(size,)) for size in [30, 45, 60, 500, 10] * 6]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(seen) == 30 and max(seen) <= 100 == budget.total_bytes and budget.most_in_use <= 100 and budget.in_use == 0


def test_validators_share_one_budget(spark, repeated, monkeypatch):
    size = fits.block_bytes(900, 3)
    budget = fits.FitBudget(2 * size + 1)
    monkeypatch.setattr(crossval, "fit_budget", lambda spark: budget)
    both = [threading.Thread(target=lambda: validator(False, parallelism=6).fit(repeated)) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert size <= budget.most_in_use <= 2 * size and budget.in_use == 0


def test_partitions_follow_the_size(spark):
    df = spark.range(1000).repartition(40)
    assert fits.fitting_partitions(df, 1000, 10).rdd.getNumPartitions() == 1
    assert fits.fitting_partitions(df, 10**7, 100).rdd.getNumPartitions() == 40
    assert fits.memory_bytes("2g") == 2 << 30 and fits.memory_bytes("512MB") == 512 << 20


def test_certificate_tells_optimal_models_from_others(repeated):
    grid = [(0.0, 0.0), (0.05, 0.0), (0.05, 0.5), (0.03, 1.0)]
    rows = repeated.select("label", *NAMES).withColumns({"matched_positive_id": F.lit(1), "patid": F.lit(1), "same": F.lit(2)})
    models = fits.fit_grid(rows, [*NAMES, "same"], grid, maxIter=5000, tol=1e-12)
    found = fits.elastic_net_certificate(rows, [*NAMES, "same"], models).collect()
    assert len(found) == 4 * 5 and all(r.optimal for r in found)
    assert any(w == 0 for m in models for w in m.coefficients[:3])
    for m in models:
        moved = fits.FittedLinear(m.reg, m.alpha, (m.coefficients[0] + 0.05, *m.coefficients[1:]), m.intercept)
        assert not all(r.optimal for r in fits.elastic_net_certificate(rows, [*NAMES, "same"], [moved]).collect())


def test_kmeans_certificate(spark):
    rng = random.Random(3)
    rows = [(x + rng.gauss(0, 0.1), y + rng.gauss(0, 0.1)) for x, y in [(0, 0), (5, 0), (0, 5)] for _ in range(30)]
    model, clustered = clustering.cluster_rows(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], 3, 1)
    centres = clustering.centres_of(model)
    found = fits.kmeans_certificate(clustered, ["x", "y"], centres, "cluster_id").collect()
    assert all(r.fixed for r in found) and sum(r.share for r in found) == pytest.approx(1)
    moved = {k: [v[0] + 3, v[1]] for k, v in centres.items()}
    assert not all(r.fixed for r in fits.kmeans_certificate(clustered, ["x", "y"], moved, "cluster_id").collect())


def people():
    rng, pos, neg, ss = random.Random(2), [], [], []
    for g in range(24):
        for kind, out, n in ((1.0, pos, 1), (0.0, neg, 4), (0.0, ss, 3)):
            for _ in range(n):
                row_id = 1 + len(pos) + len(neg) + len(ss)
                out.append((row_id, g, kind, rng.randint(30, 80) + 8 * int(kind), int(rng.random() < 0.3 + 0.4 * kind), rng.randint(0, 1)))
    return pos, neg, ss


FLOW = ClusterFlowConfig(n_clusters=2, n_eval_folds=2, n_cv_folds=2, lambdas=(0.1,), alphas=(0.0, 0.5), recalls=(0.1,), max_iter=20)


@pytest.fixture(scope="module")
def tables(spark):
    schema = "patid bigint, matched_positive_id bigint, label double, AGE int, A_FLAG int, B_FLAG int"
    return [spark.createDataFrame(rows, schema) for rows in people()]


def written(out):
    return {str(f.relative_to(out)): f.stat().st_mtime_ns for f in Path(out).rglob("part-*") if "metrics" not in f.parts[-2]}


def test_a_stopped_flow_goes_on_where_it_was(tables, tmp_path, monkeypatch):
    whole = cluster_then_classify(*tables, FLOW, str(tmp_path / "whole"))
    one, calls = cluster_flow._one_cluster, []

    def stops(*args):
        calls.append(args[6])
        if len(calls) == 3:
            raise RuntimeError("lost")
        one(*args)

    out = str(tmp_path / "run")
    monkeypatch.setattr(cluster_flow, "_one_cluster", stops)
    with pytest.raises(RuntimeError):
        cluster_then_classify(*tables, FLOW, out)
    done = {k: v for k, v in written(out).items() if k.startswith(("loops", "predictions", "state"))}
    assert any(k.startswith("loops") for k in done)
    monkeypatch.setattr(cluster_flow, "_one_cluster", one)
    again = cluster_then_classify(*tables, FLOW, out)
    after = written(out)
    parts = {str(Path(k).parent).removeprefix("loops/") for k in done if k.startswith("loops")}
    assert all(after[k] == done[k] for k in done if any(p in k for p in parts) or k.startswith("state"))
    rows = [sorted(map(tuple, r.predictions.select("fold", "cluster", "patid", F.round("prob_1", 9)).collect())) for r in (whole, again)]
    assert rows[0] == rows[1]
    with pytest.raises(ValueError):
        cluster_then_classify(*tables, ClusterFlowConfig(n_clusters=2), out)


def test_compressed_flow_and_csv_results(tables, tmp_path):
    from dataclasses import replace

    plain = cluster_then_classify(*tables, FLOW, str(tmp_path / "plain"))
    other = cluster_then_classify(*tables, replace(FLOW, compress=True, result_format="csv"), str(tmp_path / "csv"))
    theirs, ours = ({(r.fold, r.cluster, r.patid): r.prob_1 for r in x.predictions.collect()} for x in (plain, other))
    assert ours.keys() == theirs.keys() and all(ours[k] == pytest.approx(theirs[k], abs=1e-3) for k in ours)
    assert list(Path(tmp_path / "csv" / "metrics").glob("*.csv"))


def test_all_levels_come_from_one_pass(spark, tables):
    rows = tables[1].selectExpr("AGE / 100.0D AS prob_1", "cast(A_FLAG AS double) AS label", "B_FLAG AS fold", "patid % 2 AS cluster")
    found = curve.metrics_by_scope(rows, [0.1, 0.5], [("fold", "cluster"), ("fold",), ()])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("LogicalRDD") == 1 and "Join" not in plan
    for scope in ((), ("fold",)):
        own = curve.precision_at_recalls(curve.pr_curve(rows, by=scope), [0.1, 0.5], scope)
        name = "+".join(scope) or "all"
        wanted = sorted(map(tuple, own.select(*scope, "recall", "precision").collect()))
        assert sorted(map(tuple, found.filter(F.col("scope") == name).select(*scope, "recall", "value").collect())) == wanted
