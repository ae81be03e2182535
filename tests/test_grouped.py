"""Tables stored by match group: right rows, no wide row moved again, large groups split, reopened in a later run."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinfold.operators import clustering, folds
from twinfold.plans import two_stage
from twinfold.sources.grouped import SLICE_COL, group_layout

WIDE = {"A_FLAG", "B_FLAG", "features"}


def nodes(plan):
    """All nodes of a physical plan, those of adaptive parts included."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def moved(df):
    """Columns of every shuffle in the plan."""
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]
    return [{n.output().apply(i).name() for i in range(n.output().size())} for n in found]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    ids = [None] * 40 + [7] * 300 + [rng.randrange(100, 160) for _ in range(260)]
    data = [(i, m, float(i % 9 == 0), rng.randint(0, 1), rng.randint(0, 1)) for i, m in enumerate(ids)]
    schema = "patid bigint, matched_positive_id bigint, label double, A_FLAG int, B_FLAG int"
    return spark.createDataFrame(data, schema)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def layout(rows, tmp_path):
    found = group_layout(rows, f"{tmp_path}/layout", n_buckets=8)
    yield found
    found.forget()


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_large_groups_are_sliced_and_nothing_is_lost(rows, layout, tmp_path):
    assert {tuple(r) for r in layout.hot.collect()} == {(7, 4)}  # 600 rows, 75 a bucket
    stored = layout.store(layout.place(rows), f"{tmp_path}/rows")
    assert as_rows(stored, *rows.columns) == as_rows(rows, *rows.columns)
    sizes = Counter((r.matched_positive_id, r[SLICE_COL]) for r in stored.collect())
    hot = {k: n for k, n in sizes.items() if k[0] == 7}
    assert set(hot) == {(7, i) for i in (1, 2, 3, 4)} and max(hot.values()) < 110
    assert all(s == 0 for m, s in sizes if m != 7)


def test_a_group_of_rows_without_an_id_is_sliced_too(rows, tmp_path):
    layout = group_layout(rows, f"{tmp_path}/layout", n_buckets=60)
    assert {r[0] for r in layout.hot.collect()} >= {None, 7} and layout.n_hot < 60
    placed = layout.place(rows)
    assert placed.filter(f"matched_positive_id IS NULL AND {SLICE_COL} = 0").count() == 0
    tagged = layout.attach(placed, folds.fold_table(rows, 3), "left")
    assert tagged.count() == rows.count() and tagged.filter("foldID IS NULL").count() == 40


def test_empty_and_tiny_tables(rows, tmp_path):
    for name, part, hot in (("empty", rows.limit(0), 0), ("one", rows.filter("patid = 50"), 0)):
        layout = group_layout(part, f"{tmp_path}/{name}", n_buckets=4)
        stored = layout.store(layout.place(part), f"{tmp_path}/{name}-rows")
        assert layout.n_hot == hot and stored.count() == part.count()
        layout.forget()


def test_a_clashing_column_is_refused(rows, layout):
    with pytest.raises(ValueError):
        layout.place(rows.withColumn(SLICE_COL, F.lit(1)))


def test_folds_are_attached_in_place(spark, rows, layout, tmp_path, no_broadcast):
    groups = folds.fold_table(rows, 3, fold_col="eval_fold", seed=3)
    first = layout.attach(layout.place(rows), groups)
    assert sum(1 for c in moved(first) if c & WIDE) == 1
    stored = layout.store(first, f"{tmp_path}/rows", ("eval_fold",))
    train = stored.filter("eval_fold <> 1")
    inner = folds.fold_table(train, 4, seed=9)
    tagged = layout.attach(train, inner)
    assert not any(c & WIDE for c in moved(tagged))
    want = folds.assign_folds(folds.attach_folds(rows, groups).filter("eval_fold <> 1"), 4, seed=9)
    columns = ("patid", "matched_positive_id", "eval_fold", "foldID")
    assert as_rows(tagged, *columns) == as_rows(want, *columns)


def test_stored_rows_are_reopened(spark, rows, layout, tmp_path, no_broadcast):
    tagged = layout.attach(layout.place(rows), folds.fold_table(rows, 2))
    path = f"{tmp_path}/rows"
    first = as_rows(layout.store(tagged, path, ("foldID",)), "patid", "foldID")
    layout.forget()
    again = group_layout(rows.limit(0), f"{tmp_path}/layout")  # kept, not counted again
    assert again.n_buckets == 8 and again.n_hot == 1
    opened = again.store_once(tagged.limit(0), path, ("foldID",))
    assert as_rows(opened, "patid", "foldID") == first
    assert not any(c & WIDE for c in moved(again.attach(opened, folds.fold_table(rows, 5, fold_col="other"))))
    again.forget()


@pytest.mark.parametrize("most", [0, 1000])
def test_similar_controls_are_chosen_in_place(spark, rows, layout, tmp_path, no_broadcast, monkeypatch, most):
    monkeypatch.setattr(clustering, "BROADCAST_IDS", most)
    cases = rows.filter("matched_positive_id IS NOT NULL").groupBy("matched_positive_id").agg(F.min("patid").alias("patid"))
    cases = cases.withColumn("cluster_id", (F.col("matched_positive_id") % 2).cast("int")).withColumn("cv_fold", F.lit(3))
    centres, shares = {0: [0.2, 0.9], 1: [0.7, 0.1]}, {0: 0.3, 1: 0.6}
    stored = layout.store(layout.place(rows), f"{tmp_path}/rows")
    args = (cases, ["A_FLAG", "B_FLAG"], centres, shares)
    plain = clustering.similar_controls_by_cluster(rows, *args)
    ours = clustering.similar_controls_by_cluster(stored, *args, carry=("cv_fold",), layout=layout)
    columns = (*rows.columns, "cluster_id")
    assert ours.columns == [*columns, "cv_fold"]
    assert as_rows(ours, *columns) == as_rows(plain, *columns) and ours.filter("cv_fold = 3").count() == ours.count()
    # only the rows of the one large group, cut to their nearest in the map tasks, move
    assert sum(1 for c in moved(ours) if c & WIDE) == 1
    even = rows.filter("matched_positive_id > 7")
    layout = group_layout(even, f"{tmp_path}/even-layout", n_buckets=4)
    assert layout.n_hot == 0
    stored = layout.store(layout.place(even), f"{tmp_path}/even")
    ours = clustering.similar_controls_by_cluster(stored, *args, layout=layout)
    assert as_rows(ours, *columns) == as_rows(clustering.similar_controls_by_cluster(even, *args), *columns)
    assert not any(c & WIDE for c in moved(ours))
    layout.forget()


def test_inner_folds_of_the_two_stages_move_no_features(spark, rows, layout, tmp_path, no_broadcast):
    vectors = clustering.assemble(rows, ["A_FLAG", "B_FLAG"]).withColumn("_part", F.lit("test"))
    outer = folds.fold_table(rows.filter("label = 1"), 3, fold_col="sim")
    tagged = layout.attach(layout.place(vectors), outer, "left").fillna(-1, ["sim"])
    tagged = layout.store(tagged, f"{tmp_path}/rows", ("sim",))
    inner = two_stage.inner_fold_table(outer, 0, 2, 42)
    train = two_stage.inner_fold_rows(tagged, inner, layout, 0)
    assert train.columns == ["matched_positive_id", "label", "patid", "features", "_inner"]
    assert not any(c & WIDE for c in moved(train))
    plain = vectors.join(outer, "matched_positive_id", "left").fillna(-1, ["sim"]).filter("sim <> 0")
    plain = plain.join(inner, "matched_positive_id", "left").fillna(-1, ["_inner"])
    assert as_rows(train, "patid", "_inner") == as_rows(plain, "patid", "_inner")
