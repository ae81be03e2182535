"""Global and per-group ranking against brute force, with ties, hot values and small task bounds."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions.columns import round_half_up
from twinfold.operators import ranking as R


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(11)
    # a third of the rows share one distance
    rows = [(i, rng.choice([0.5, rng.random(), rng.random()]), f"p{rng.randint(0, 10**6):07d}-{i}") for i in range(900)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "patid bigint, dist double, name string").repartition(8).cache()


@pytest.mark.parametrize(
    "k, bound", [(k, b) for b in (60, 10_000) for k in (1, 299, 450, 900)] + [(301, 7)]
)
def test_kth_key(points, k, bound):
    rows, df = points
    want = sorted((d, p) for p, d, _ in rows)[k - 1]
    assert R.kth_key(df, ["dist", "patid"], k, one_task_rows=bound) == want


def test_kth_key_of_text_ids(points):
    rows, df = points
    assert R.kth_key(df, ["dist", "name"], 333, one_task_rows=50) == sorted((d, n) for _, d, n in rows)[332]
    with pytest.raises(ValueError):
        R.kth_key(df, ["dist", "name"], 901)


@pytest.mark.parametrize("share", [0.0, 0.001, 0.3333, 0.37, 1.0])
def test_smallest_fraction(points, share):
    rows, df = points
    k = round_half_up(len(rows) * share)
    got = {r.patid for r in df.filter(R.smallest_fraction(df, ["dist", "patid"], share)).collect()}
    assert got == {p for _, p in sorted((d, p) for p, d, _ in rows)[:k]}


def test_rounding_goes_away_from_zero():
    assert [round_half_up(x) for x in (0.5, 1.5, 2.5, 2.4999, 0.49999999999999994)] == [1, 2, 3, 2, 0]


@pytest.mark.parametrize("share", [0.0, 0.75, 0.913, 1.0])
@pytest.mark.parametrize("bound", [40, 10_000])
def test_exact_percentile(points, share, bound):
    rows, df = points
    want = float(np.percentile([d for _, d, _ in rows], share * 100))
    assert R.exact_percentile(df, "dist", share, one_task_rows=bound) == pytest.approx(want, abs=1e-15)


def test_percentile_of_nothing(points):
    assert R.exact_percentile(points[1].filter("dist > 5"), "dist", 0.5) is None


def test_hash_rank_equals_a_global_sort(points):
    rows, df = points
    order = sorted((hashlib.md5(f"42:{p}".encode()).hexdigest(), p) for p, _, _ in rows)
    want = {p: i for i, (_, p) in enumerate(order)}
    ranked = R.hash_rank(df.select("patid"), "patid", 42)
    assert {r.patid: r["rank"] for r in ranked.collect()} == want


def test_row_index_equals_a_global_sort(points):
    rows, df = points
    want = {p: i for i, (_, p) in enumerate(sorted((-d, p) for p, d, _ in rows))}
    indexed = R.with_row_index(df, [F.desc("dist"), "patid"])
    assert {r.patid: r["index"] for r in indexed.collect()} == want


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return action(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("bound", [7, 60, 10_000])
def test_many_ranks_of_several_keys(points, bound):
    rows, df = points
    df = df.withColumn("far", 3 - F.col("dist")).withColumn("flat", F.lit(0.25))
    lists = {
        "dist": sorted((d, p) for p, d, _ in rows),
        "far": sorted((3 - d, p) for p, d, _ in rows),
        "flat": sorted((0.25, p) for p, _, _ in rows),
    }
    wanted = [(c, k) for c in lists for k in (1, 300, 301, 450, 900)]
    got = R.kth_keys(df, [([c, "patid"], k) for c, k in wanted], one_task_rows=bound)
    assert got == [lists[c][k - 1] for c, k in wanted]
    assert R.kth_keys(df, []) == []
    with pytest.raises(ValueError):
        R.kth_keys(df, [(["dist", "patid"], 1), (["name", "patid"], 1)])


def test_passes_do_not_grow_with_the_number_of_ranks(spark, monkeypatch):
    df = spark.range(60_000).selectExpr("id AS patid", "double(id * 7919 % 60013) AS a", "double(id * 104729 % 60013) AS b")
    df = df.repartition(8).cache()
    df.count()
    rounds = []
    tagged = R._tagged_keys
    monkeypatch.setattr(R, "_tagged_keys", lambda rows, picks: rounds.append(len(picks)) or tagged(rows, picks))
    one, jobs_of_one = jobs_of(spark, "one-rank", lambda: R.kth_keys(df, [(["a", "patid"], 30_000)], 60_000, 9000))
    of_one = len(rounds)
    rounds.clear()
    wanted = [([c, "patid"], k) for c in ("a", "b") for k in (20_000, 30_000, 40_000)]
    many, jobs_of_many = jobs_of(spark, "six-ranks", lambda: R.kth_keys(df, wanted, 60_000, 9000))
    assert many[1] == one[0] and rounds[0] == len(wanted)
    assert len(rounds) <= of_one + 1 and jobs_of_many / len(rounds) <= jobs_of_one / of_one + 1


def test_both_neighbours_of_a_percentile_come_from_one_search(points, monkeypatch):
    calls = []
    search = R.kth_keys
    monkeypatch.setattr(R, "kth_keys", lambda df, wanted, *args: calls.append(len(wanted)) or search(df, wanted, *args))
    R.exact_percentile(points[1], "dist", 0.7531, one_task_rows=40)
    assert calls == [2]


def test_smallest_fractions(points):
    rows, df = points
    df = df.withColumn("far", 3 - F.col("dist"))
    wanted = [(["dist", "patid"], 0.3), (["far", "patid"], 0.41), (["far", "patid"], 0.0), (["dist", "patid"], 1.0)]
    sizes = [df.filter(c).count() for c in R.smallest_fractions(df, wanted)]
    assert sizes == [270, 369, 0, 900]


def test_row_index_by_key_sorts_and_stores_keys_only(spark, points, monkeypatch):
    rows, df = points
    stored = []
    keep = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name: stored.append(df) or keep(df, name))
    indexed = R.with_row_index(df, [F.desc("dist"), "patid"], row_key=["patid"])
    assert indexed.columns == R.with_row_index(df, [F.desc("dist"), "patid"]).columns
    want = {p: (i, n) for i, (_, p, n) in enumerate(sorted((-d, p, n) for p, d, n in rows))}
    assert {r.patid: (r["index"], r["name"]) for r in indexed.collect()} == want
    assert stored[0].columns == ["_k0", "_mid"] and "name" in stored[1].columns
    sorts = [line for line in stored[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort" in line]
    assert sorts and not any("name" in line for line in sorts)


def test_row_index_by_key_keeps_null_keys_and_refuses_repeats(spark):
    df = spark.createDataFrame([(None, 3.0), (1, 2.0), (2, None), (4, 2.0)], "a int, v double")
    got = R.with_row_index(df, [F.asc_nulls_last("v"), "a"], row_key=["a"])
    assert {r.a: r["index"] for r in got.collect()} == {1: 0, 4: 1, None: 2, 2: 3}
    assert R.with_row_index(df.limit(0), ["v"], row_key=["a"]).count() == 0
    with pytest.raises(ValueError):
        R.with_row_index(df.unionByName(df.limit(1)), ["v"], row_key=["a"])


@pytest.mark.parametrize("n", [1, 3, 1200])
def test_top_n_per_group_with_a_hot_group(spark, n):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 40), rng.randint(0, 5), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g bigint, d int, patid bigint")
    groups = {}
    for g, d, i in rows:
        groups.setdefault(g, []).append((d, i))
    want = {i for members in groups.values() for _, i in sorted(members)[:n]}
    got = R.top_n_per_group(df, n, "g", ["d", "patid"])
    assert {r.patid for r in got.collect()} == want and got.columns == df.columns


def test_small_limits_are_applied_before_the_shuffle(points):
    df = points[1].withColumn("g", F.col("patid") % 5)
    plan = R.top_n_per_group(df, 3, "g", ["dist", "patid"])._jdf.queryExecution().toString()
    assert "row_number(), 3, Partial" in plan


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_in_buckets(spark, descending):
    rng = random.Random(2)
    values = [(g, v, rng.randint(0, 9)) for g in ("a", None) for v in {round(rng.random() ** 3, 4) for _ in range(500)}]
    df = spark.createDataFrame(values, "g string, v double, n int")
    got = R.running_totals(df, "v", {"n": "t"}, ["g"], descending, bounds=R.quantile_bounds(df, "v", 16, 0))
    for row in got.collect():
        upto = [n for g, v, n in values if g == row.g and (v >= row.v if descending else v <= row.v)]
        assert row.t == sum(upto)
    assert got.count() == len(values)


def test_both_ranking_branches_share_one_shuffle(spark):
    ids = spark.range(5000).select((F.col("id") % 700).alias("patid"))
    ranked = R.hash_rank(ids.distinct(), "patid", 1)
    ranked.collect()
    assert "ReusedExchange" in ranked._jdf.queryExecution().executedPlan().toString()


def test_quantile_bounds_are_bounded(points):
    assert R.quantile_bounds(points[1], "dist", 8) == []
    bounds = R.quantile_bounds(points[1], "dist", 8, one_task_rows=100)
    assert len(bounds) < 16 * 8 and len(bounds) < 4 * points[1].count() // 100 and bounds == sorted(set(bounds)) and all(math.isfinite(b) for b in bounds)


def test_missing_and_repeated_keys_give_the_same_at_every_size(spark):
    rng = random.Random(8)
    values = [None if i % 7 == 0 else math.nan if i % 11 == 0 else float(rng.randint(0, 9)) for i in range(700)]
    df = spark.createDataFrame([(v, i % 50) for i, v in enumerate(values)], "dist double, patid int").cache()

    def place(v):
        return (2, 0) if v is None else (1, 0) if math.isnan(v) else (0, v)

    want = sorted(((v, i % 50) for i, v in enumerate(values)), key=lambda r: (place(r[0]), r[1]))
    for k in (1, 200, 480, 590, 650, 700):
        for bound in (5, 60, 10_000):
            got = R.kth_key(df, ["dist", "patid"], k, one_task_rows=bound)
            assert (place(got[0]), got[1]) == (place(want[k - 1][0]), want[k - 1][1])
    same = spark.range(200).selectExpr("1.5D AS dist", "7 AS patid")
    assert R.kth_key(same, ["dist", "patid"], 90, one_task_rows=50) == (1.5, 7)
    near = R.smallest_fraction(df, ["dist", "patid"], 0.95)
    assert df.filter(near).count() + df.filter(~near).count() == 700


def test_percentile_and_bounds_with_nan(spark):
    df = spark.range(1, 1001).selectExpr("if(id % 4 = 0, double('NaN'), double(id % 300)) AS v").cache()
    for share in (0.0, 0.31, 0.6, 1.0):
        small, large = (R.exact_percentile(df, "v", share, one_task_rows=n) for n in (10_000, 30))
        assert small == large or (math.isnan(small) and math.isnan(large))
    bounds = R.quantile_bounds(df, "v", one_task_rows=30)
    assert bounds and not any(map(math.isnan, bounds)) and len(bounds) < 16 * 256
