"""Fold invariants, cohort selection, joins with hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from twinfold.operators import cohort as C
from twinfold.operators import folds as K


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(m, int(j == 0), m * 10 + j, 0.5 * j) for m in range(5) for j in range(4)]
    return spark.createDataFrame(rows, "matched_positive_id int, label int, patid int, features double").cache()


def groups_per_fold(df):
    return sorted(r.n for r in df.groupBy("foldID").agg(F.countDistinct("matched_positive_id").alias("n")).collect())


@pytest.mark.parametrize("n, sizes", [(2, [2, 3]), (5, [1] * 5), (3, [1, 2, 2]), (1, [5]), (7, [1] * 5)])
def test_folds_are_balanced_and_keep_groups_together(toy, n, sizes):
    tagged = K.assign_folds(toy, n, cols_to_keep=["label", "features"])
    assert tagged.columns == ["matched_positive_id", "label", "features", "foldID"]
    assert groups_per_fold(tagged) == sizes
    per_group = tagged.groupBy("matched_positive_id").agg(F.countDistinct("foldID").alias("n")).collect()
    assert [r.n for r in per_group] == [1] * 5
    assert tagged.count() == toy.count()


def test_four_groups_in_two_folds(toy):
    assert groups_per_fold(K.assign_folds(toy.filter("matched_positive_id != 0"), 2)) == [2, 2]


def test_folds_are_seeded(toy):
    def of(seed):
        return {(r.patid, r.foldID) for r in K.assign_folds(toy.repartition(3), 2, seed=seed).collect()}

    assert of(1) == of(1)
    assert len({frozenset(of(s)) for s in range(6)}) > 1


def test_existing_fold_column_is_refused(toy):
    with pytest.raises(ValueError):
        K.assign_folds(toy.withColumn("foldID", F.lit(1)), 2)
    with pytest.raises(ValueError):
        K.assign_folds(toy, 0)


def test_fold_validation(spark, toy):
    assert K.validate_folds(K.assign_folds(toy, 3)) == 3
    for bad in ([0, 2], [1, 2], [0, None], [-1, 0]):
        with pytest.raises(ValueError):
            K.validate_folds(spark.createDataFrame([(b,) for b in bad], "foldID int"))
    with pytest.raises(ValueError):
        K.validate_folds(spark.createDataFrame([(0.0,)], "foldID double"))
    with pytest.raises(ValueError):
        K.validate_folds(spark.createDataFrame([], "foldID int"))


def test_split_and_summary(toy):
    tagged = K.assign_folds(toy, 2)
    held, rest = K.held_out(tagged, 0), K.remaining(tagged, 0)
    assert held.count() + rest.count() == 20 and "foldID" not in held.columns
    summary = K.fold_summary(tagged).collect()
    assert sum(r.n_groups for r in summary) == 5 and sum(r.n_cases for r in summary) == 5


def test_round_robin_ignores_groups(toy):
    tagged = K.round_robin_folds(toy, 3, ["patid"])
    ordered = [r.foldID for r in tagged.orderBy("patid").collect()]
    assert ordered == [i % 3 for i in range(20)]


def test_hot_match_group_is_split_at_run_time(spark):
    """Half of all rows share one match id: the join splits its partition and the result is whole."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 40000, 1, 8).select(
            F.col("id").alias("patid"),
            F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500).cast("bigint").alias("matched_positive_id"),
            F.md5(F.col("id").cast("string")).alias("text"),
        )
        folds = K.fold_table(rows, 5)
        tagged = K.attach_folds(rows, folds)
        assert len(tagged.collect()) == 40000
        assert "skew=true" in tagged._jdf.queryExecution().executedPlan().toString()
        kept = C.rows_of_cases(rows, rows.filter("patid = 14"))
        assert len(kept.collect()) == rows.filter("matched_positive_id = 7").count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    pos = [(m, 1.0, m) for m in range(60)]
    neg = [(0 if rng.random() < 0.4 else rng.randint(0, 70), 0.0, 1000 + i) for i in range(800)]
    ss = [(rng.randint(0, 70), 0.0, 5000 + i) for i in range(900)]
    schema = "matched_positive_id int, label double, patid int"
    return [spark.createDataFrame(t, schema) for t in (pos, neg, ss)], (pos, neg, ss)


def first_rows(rows, cases, n):
    groups = {}
    for m, y, p in rows:
        if m in cases:
            groups.setdefault(m, []).append((y, p))
    return {p for g in groups.values() for _, p in sorted(g)[:n]}


@pytest.mark.parametrize("most", [0, 500_000])
def test_undersampling(tables, monkeypatch, most):
    """The same rows come out whether the sampled match ids are broadcast or joined."""
    monkeypatch.setattr(C, "BROADCAST_IDS", most)
    dfs, (_, neg, ss) = tables
    cases, controls, scoring = C.undersample_cohort(*dfs, ratio=0.4, neg_ratio=5, ss_ratio=10, seed=1)
    ids = {r.matched_positive_id for r in cases.collect()}
    assert 10 < len(ids) < 40
    assert {r.patid for r in controls.collect()} == first_rows(neg, ids, 5)
    assert {r.patid for r in scoring.collect()} == first_rows(ss, ids, 10)
    assert controls.columns == dfs[1].columns


def test_undersampling_refuses_repeated_case_ids(tables):
    (pos, neg, ss), _ = tables
    with pytest.raises(ValueError):
        C.undersample_cohort(pos.unionByName(pos), neg, ss, ratio=1.0)


def test_sampling_methods(tables):
    pos = tables[0][0]
    assert C.sample_rows(pos, 0.5, seed=3).collect() == C.sample_rows(pos.repartition(5), 0.5, seed=3).sort("patid").collect()
    assert 0 < C.sample_rows(pos, 0.5, method="bernoulli").count() < 60
    with pytest.raises(ValueError):
        C.sample_rows(pos, 0.5, method="other")


def test_joins_and_complements(spark, tables):
    (pos, neg, ss), _ = tables
    two = pos.filter("patid in (3, 4)")
    twice = two.unionByName(two)
    single, double = C.rows_of_cases(neg, twice).count(), C.rows_per_case(neg, twice).count()
    assert single == neg.filter("matched_positive_id in (3, 4)").count() and double == 2 * single
    assert C.complement_rows(pos, two).count() == 58 and C.rows_by_id(pos, two).count() == 2
    repeated = pos.unionByName(pos)
    assert C.complement_rows(repeated, two).count() == 116
    assert C.distinct_difference(repeated, two).count() == 58
    assert C.only_label(pos.unionByName(neg)).count() == 60


def test_test_set_assembly(tables):
    (pos, neg, ss), (_, neg_rows, ss_rows) = tables
    tagged = K.assign_folds(C.union_all([pos, neg]), 3)
    held = K.held_out(tagged, 0)
    ids = {r.matched_positive_id for r in held.collect()}
    case_ids = ids & set(range(60))
    want = {p for p in range(60) if p in ids}
    want |= {p for m, _, p in neg_rows if m in ids} | {p for m, _, p in ss_rows if m in case_ids}
    got = C.assemble_test_set(pos, neg, ss, held)
    assert {r.patid for r in got.collect()} == want and got.count() == len(want)
