"""Sources, sinks, column expressions and the cleaning job."""

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from twinfold.functions import columns as X
from twinfold.plans.cleaning import clean_cohort, run_cleaning
from twinfold.sources import sinks, tables


def test_topcoding_keeps_null(spark):
    df = spark.createDataFrame(
        [(1, 9, 9, 30, None), (2, 7, 5, 11, 5), (3, None, 0, 1, 6)],
        "patid int, SYMP_CNT int, COMOR_CNT int, NRCOMOR_CNT int, PROC_CNT int",
    )
    got = X.topcode(df)
    assert got.columns == ["patid", "SYMP_CNT2", "COMOR_CNT2", "NRCOMOR_CNT2", "PROC_CNT2"]
    assert [tuple(r) for r in got.orderBy("patid").collect()] == [
        (1, 7, 5, 11, None),
        (2, 7, 5, 11, 5),
        (3, None, 0, 1, 5),
    ]
    nan = spark.createDataFrame([(math.nan,)], "x double").select(X.capped("x", 3).alias("x")).first().x
    assert nan == 3.0
    with pytest.raises(ValueError):
        X.topcode(got.withColumn("SYMP_CNT", F.lit(1)), {"SYMP_CNT": 7})


def test_label_check(spark):
    df = spark.createDataFrame([(1, 1.0, "1")], "a int, b double, c string")
    assert dict(X.label_as_double(df, "a").dtypes)["a"] == "double"
    assert dict(X.label_as_double(df, "b").dtypes)["b"] == "double"
    with pytest.raises(TypeError):
        X.label_as_double(df, "c")


def test_distances(spark):
    df = spark.createDataFrame([(1, 0, Vectors.dense([1.0, 0.0]), [1.0, 0.0])], ["a", "b", "v", "r"])
    want = math.hypot(0.75, 0.5)
    row = df.select(
        X.euclidean_to(["a", "b"], [0.25, 0.5]).alias("x"),
        X.array_distance(F.col("r"), F.array(F.lit(0.25), F.lit(0.5))).alias("z"),
    ).first()
    assert row.x == row.z == pytest.approx(want)
    with pytest.raises(ValueError):
        X.euclidean_to(["a"], [1, 2])


def test_log_of_zero_is_null(spark):
    df = spark.createDataFrame([(0.0,), (0.01,)], "p double").select(X.log10_score(F.col("p")).alias("x"))
    assert sorted((r.x is None, r.x) for r in df.collect()) == [(False, -2.0), (True, None)]


def test_id_layouts(spark):
    with pytest.raises(ValueError):
        tables.normalise_ids(spark.range(1), "other")
    cases = spark.createDataFrame([(5, 9, 1)], "patid int, nonipf_patid int, label int")
    assert tables.normalise_ids(cases, "case_copy").first().asDict() == {"patid": 5, "label": 1, "matched_positive_id": 5}
    assert tables.normalise_ids(cases, "control_rename").first().asDict() == {
        "matched_positive_id": 5,
        "patid": 9,
        "label": 1,
    }
    indexed = spark.createDataFrame([(1, 5, 9)], "X int, matched_patient_id int, patient_id int")
    assert tables.normalise_ids(indexed, "indexed_patient_id").first().asDict() == {"matched_positive_id": 5, "patid": 9}


HEADER = "patient_id,matched_patient_id,label,SYMP_CNT,COMOR_CNT,NRCOMOR_CNT,PROC_CNT,A_FLAG,B_FLAG,B_AVG_RXDX,LVL3_GASTROSC_AVG_RXDX"


def write_text(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_cleaning_job_on_csv(spark, tmp_path):
    for name, label in (("pos", 1), ("neg", 0), ("score", 0)):
        write_text(tmp_path / f"raw_{name}.csv", [HEADER, f"7,3,{label},9,9,30,9,1,0,0.5,0.25"])
    write_text(tmp_path / "vars.csv", ["variable,note", "B,old"])
    paths = tuple(str(tmp_path / f"raw_{n}.csv") for n in ("pos", "neg", "score"))
    run_cleaning(spark, paths, str(tmp_path / "vars.csv"), str(tmp_path / "clean"))
    for name, label in (("pos", 1), ("neg", 0), ("ss", 0)):
        row = tables.read_cohort(spark, str(tmp_path / "clean" / f"{name}.csv")).first().asDict()
        assert row == {
            "patid": 7,
            "matched_positive_id": 3,
            "label": label,
            "A_FLAG": 1,
            "SYMP_CNT2": 7,
            "COMOR_CNT2": 5,
            "NRCOMOR_CNT2": 11,
            "PROC_CNT2": 5,
        }


def test_cleaning_job_reads_the_format_it_is_told(spark, tmp_path):
    paths = []
    for name in ("pos", "neg", "score"):
        paths.append(str(tmp_path / name))
        write_text(tmp_path / name / "part-0.csv", [HEADER, "7,3,1,9,9,30,9,1,0,0.5,0.25"])
    run_cleaning(spark, tuple(paths), None, str(tmp_path / "clean"))
    assert tables.read_cohort(spark, str(tmp_path / "clean/pos.csv")).first()["SYMP_CNT2"] == 7
    cleaned = tuple(f"{tmp_path}/clean/{n}.csv" for n in ("pos", "neg", "ss"))
    raw = [tables.read_cohort(spark, p).withColumnsRenamed({"patid": "patient_id", "matched_positive_id": "matched_patient_id"}) for p in cleaned]
    raw = [df.withColumnsRenamed({f"{c}2": c for c in ("SYMP_CNT", "COMOR_CNT", "NRCOMOR_CNT", "PROC_CNT")}) for df in raw]
    for name, df in zip(("pos", "neg", "score"), raw):
        df.write.parquet(str(tmp_path / f"p-{name}"))
    stored = tuple(f"{tmp_path}/p-{n}" for n in ("pos", "neg", "score"))
    run_cleaning(spark, stored, None, str(tmp_path / "again"), fmt="csv", source_fmt="parquet")
    assert tables.read_cohort(spark, str(tmp_path / "again/pos.csv")).first()["PROC_CNT2"] == 5


def test_part_files_skip_other_files(spark, tmp_path):
    write_text(tmp_path / "part-0.csv", ["a,b", "1,x"])
    write_text(tmp_path / "part-1.csv", ["a,b", "2,y"])
    write_text(tmp_path / "notes.txt", ["a,b", "3,z"])
    (tmp_path / "empty.csv").write_text("")
    got = tables.read_part_files(spark, str(tmp_path), "a int, b string")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (2, "y")]
    assert tables.read_part_files(spark, str(tmp_path)).count() == 2


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 1, 0)], "patid int, matched_positive_id int, label double, A_FLAG int, N_CNT int")
    assert X.predictor_columns(df.columns) == ["A_FLAG", "N_CNT"]
    assert X.predictor_columns(df.columns, ["N_CNT"]) == ["A_FLAG"]
    assert X.flag_columns(df.columns) == ["A_FLAG"]
    assert tables.align_columns(df, ["label", "patid"]).columns == ["label", "patid"]
    assert tables.rename_columns(df, {"label": "y"}).columns[2] == "y"
    with pytest.raises(Exception):
        clean_cohort(df, df, df)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("areaUnderPR", 0.5)], "metric string, value double")
    for fold in (0, 1):
        sinks.write_metrics(df, str(tmp_path / "m"), {"fold": fold})
        sinks.write_results(df, sinks.run_path(str(tmp_path / "r"), {"fold": fold}))
    assert sorted(r.fold for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [0, 1]
    assert sorted(r.fold for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [0, 1]
    sinks.write_results(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().metric == "areaUnderPR"
    manifest = sinks.run_manifest({"pos": df, "none": df.limit(0)}, {"seed": 42}).collect()
    assert sorted(tuple(r) for r in manifest) == [("rows", "none", "0"), ("rows", "pos", "1"), ("setting", "seed", "42")]


def test_undersampling_job_on_csv(spark, tmp_path):
    from twinfold.plans.undersampling import run_undersampling

    kinds = "matched_positive_id int, label double, patid int"
    rows = {
        "pos": [(i, 1.0, i) for i in range(40)],
        "neg": [(i, 0.0, 100 + 10 * i + j) for i in range(40) for j in range(4)],
        "ss": [(i, 0.0, 1000 + i) for i in range(45)],
    }
    paths = {p: str(tmp_path / p) for p in rows}
    for part, data in rows.items():
        sinks.write_results(spark.createDataFrame(data, kinds), paths[part], fmt="csv")
    written = run_undersampling(spark, paths, (0.2, 1.0), str(tmp_path / "out"), neg_ratio=3, ss_ratio=1, schema=kinds)
    whole = {p: tables.read_cohort(spark, f, kinds, "csv").count() for p, f in written[1.0].items()}
    assert whole == {"pos": 40, "neg": 120, "ss": 40}
    few = {p: tables.read_cohort(spark, f, kinds, "csv") for p, f in written[0.2].items()}
    cases = {r.matched_positive_id for r in few["pos"].collect()}
    assert 0 < len(cases) < 40 and {r.matched_positive_id for r in few["neg"].collect()} == cases
    assert few["neg"].count() == 3 * len(cases)
