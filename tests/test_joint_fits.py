"""Models fitted together: Spark's optimum, few passes over the rows whatever their number."""

import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from twinfold.operators import crossval, joint_fits
from twinfold.operators.evaluator import PrecisionRecallEvaluator
from twinfold.operators.joint_fits import WantedFit, fit_together
from twinfold.operators.scores import score_with, score_with_all


@pytest.fixture(scope="module")
def rows(spark):
    rng, found = random.Random(9), []
    for i in range(600):
        a, b, c = rng.gauss(50, 9), rng.randint(0, 1), rng.random()
        y = float(rng.random() < 1 / (1 + math.exp(3 - 0.05 * a - b)))
        found.append((Vectors.dense([a, a + rng.gauss(0, 2), b, c, 7.0]), y, i % 3))
    return spark.createDataFrame(found, ["features", "label", "foldID"]).repartition(3).cache()


def test_equal_to_fits_one_by_one(rows):
    rows = rows.coalesce(1).cache()
    lr = LogisticRegression(maxIter=200, tol=1e-9)
    for standard, wanted in (
        (True, [WantedFit(), WantedFit(0.1, 0.0), WantedFit(0.03, 0.5, 0), WantedFit(0.05, 1.0, 2)]),
        (False, [WantedFit(0.03, 0.5, 1), WantedFit(10.0, 1.0)]),
    ):
        models = fit_together(rows, 5, wanted, "foldID", standardization=standard)
        for w, m in zip(wanted, models):
            part = rows if w.left_out is None else rows.filter(F.col("foldID") != w.left_out)
            one = lr.copy({lr.regParam: w.reg, lr.elasticNetParam: w.alpha, lr.standardization: standard}).fit(part)
            assert m.coefficients == pytest.approx(tuple(one.coefficients), abs=1e-4)
            assert m.intercept == pytest.approx(one.intercept, abs=5e-3)
            assert m.coefficients[4] == 0
    models = fit_together(rows, 5, [WantedFit(), WantedFit(0.1, 0.0)])
    mine, names = score_with_all(rows, models[:2])
    theirs = score_with(rows, lr.fit(rows))
    assert sorted(r[names[0]] for r in mine.collect()) == pytest.approx(sorted(r.prob_1 for r in theirs.collect()), abs=1e-4)


def test_cells_copies_and_single_labels(spark):
    data = [(Vectors.dense([float(k == j) for k in range(3)]), float(i % (j + 2) == 0), j % 2) for j in range(3) for i in range(12)]
    cells = spark.createDataFrame([*data, (Vectors.dense([0.0, 0.0, 0.0]), 1.0, 0)], ["features", "label", "foldID"])
    (model,) = fit_together(cells.filter("foldID >= 0"), 3, [WantedFit()], "foldID")
    found = score_with(cells, model).groupBy("features").agg(F.avg("label").alias("y"), F.avg("prob_1").alias("p")).collect()
    assert all(r.p == pytest.approx(r.y, abs=1e-3) for r in found)
    one = cells.withColumn("label", F.lit(1.0))
    assert {r.prob_1 for r in score_with(one, fit_together(one, 3, [WantedFit()])[0]).collect()} == {1.0}
    with pytest.raises(ValueError):
        fit_together(cells.withColumn("label", F.lit(2.0)), 3, [WantedFit()])
    with pytest.raises(ValueError):
        fit_together(cells.filter("foldID = 0"), 3, [WantedFit(left_out=0)], "foldID")


def test_passes_read_blocks_of_rows(rows, monkeypatch):
    seen, add_up = [], joint_fits._add_up
    monkeypatch.setattr(joint_fits, "_add_up", lambda df, *args: seen.append(df.count()) or add_up(df, *args))
    wanted = [WantedFit(), WantedFit(0.1, 0.0, 1)]
    models = fit_together(rows, 5, wanted, "foldID")
    assert max(seen) <= 3  # one for each partition, not one for each of the 600 rows
    monkeypatch.setattr(joint_fits, "BLOCK_BYTES", 8 * 7 * 50)
    for small, one in zip(fit_together(rows, 5, wanted, "foldID"), models):
        assert max(seen) >= 12 and small.coefficients == pytest.approx(one.coefficients, abs=1e-7)


def test_a_grid_takes_a_few_passes(rows, monkeypatch):
    passes, fits, add_up, fit = [], [], joint_fits._add_up, LogisticRegression._fit
    monkeypatch.setattr(joint_fits, "_add_up", lambda *args: passes.append(1) or add_up(*args))
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, data: fits.append(1) or fit(self, data))
    lr = LogisticRegression(maxIter=200)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    validator = crossval.FoldCrossValidator(
        estimator=lr, estimatorParamMaps=grid, evaluator=PrecisionRecallEvaluator(rawPredictionCol="probability"),
        stratifyCol="foldID", parallelism=4,
    )
    found = validator.fit(rows)
    assert found.foldMetrics.count() == 12 and len(passes) <= 15 and len(fits) == 1
    monkeypatch.setattr(crossval, "_joint_grid", lambda *args: None)
    single = validator.fit(rows)
    theirs, ours = ({(r.fold, r.paramSetID): r.value for r in m.foldMetrics.collect()} for m in (single, found))
    assert all(ours[k] == pytest.approx(theirs[k], abs=2e-3) for k in theirs)


def test_the_two_stage_flow_fits_inner_folds_together(spark, monkeypatch, tmp_path):
    from twinfold.plans import two_stage as plan

    rng, parts = random.Random(4), ([], [], [])
    for g in range(20):
        for label, part, n in ((1.0, 0, 1), (0.0, 1, 4), (0.0, 2, 2)):
            for _ in range(n):
                parts[part].append((1 + sum(map(len, parts)), g, label, rng.randint(30, 80) + 6 * int(label), rng.randint(0, 1)))
    tables = [spark.createDataFrame(p, "patid bigint, matched_positive_id bigint, label double, AGE int, A_FLAG int") for p in parts]
    calls, fit = [], plan.fit_together
    monkeypatch.setattr(plan, "fit_together", lambda *args, **kw: calls.append(len(args[2])) or fit(*args, **kw))
    monkeypatch.setattr(plan, "fit_unpenalised", lambda *args: pytest.fail("fitted one by one"))
    plan.two_stage(*tables, plan.TwoStageConfig(n_outer=2, n_inner=2, recalls=(0.1,)), str(tmp_path / "run"))
    assert sorted(calls) == [1, 1, 2, 2]
