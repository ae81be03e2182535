import random

from pyspark.sql import functions as F

from twinfold.llm import line_runs

SCHEMA = "doc_id bigint, text string"
LONG = "This line is long enough to be judged, as it has over forty characters"


def expected(rows, least_chars=40, least_docs=5):
    """Plain form: rows are documents, a key counts once per row."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()

    holders = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                holders.setdefault(k, []).append(doc_id)
    last = {k: max(v) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    found = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or not last.get(key(x), doc_id) > doc_id]
        found.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(found, key=str)


def result(df, **options):
    return sorted(map(tuple, line_runs.drop_repeated_lines(df, **options).collect()), key=str)


def test_equals_plain_form_with_bad_rows_and_clashing_columns(spark):
    rng = random.Random(3)
    lines = [f"{LONG} {i % 9}" for i in range(9)] + ["short", "", "  " + LONG.upper() + " 1\t\x0b", "É" + LONG, "é" + LONG, "x" * 39, " " + "y" * 40]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 7)))) for _ in range(150)]
    rows += [(1, None), (None, None), (2, ""), (3, "\n\n"), (4, "\n".join([LONG] * 3000)), (5, LONG), (5, LONG), (5, LONG), (6, LONG)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "batch": F.lit("b"), "keys": F.lit(0), "last": F.lit(2)})
    wanted = expected(rows)
    assert any(n for _, _, n, _ in wanted)
    assert result(df) == wanted
    assert result(df.repartition(5), batches=3, broadcast_keys=0) == wanted
    assert result(df, batches=1) == wanted


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_one_line_in_a_third_of_all_rows(spark):
    rows = [(i, f"{LONG}\nown line {i}" if i % 3 == 0 else f"row {i}") for i in range(3000)]
    assert result(spark.createDataFrame(rows, SCHEMA), broadcast_keys=0) == expected(rows)


def test_runs_in_any_order_decide_alike_and_stay_few(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 40), i) for i in range(1200)]
    batches = [rows[i::6] for i in range(6)]
    wanted = {}
    for key, doc_id in rows:
        n, last = wanted.get(key, (0, -1))
        wanted[key] = (n + 1, max(last, doc_id))
    runs = line_runs.LineRuns(spark, least_docs=30, buckets=4)
    for i, batch in enumerate(batches):
        runs.add(spark.createDataFrame(batch, "key bigint, doc_id bigint"))
        assert len(runs.runs()) == (i + 1).bit_count()
    assert sorted(map(tuple, runs.decided().collect())) == sorted((k, last) for k, (n, last) in wanted.items() if n >= 30)


def test_runs_are_joined_in_step_and_decided_keys_are_not_added_again(spark):
    runs = line_runs.LineRuns(spark, least_docs=2, buckets=4)
    runs.add(spark.createDataFrame([(7, 100), (7, 99), (8, 98)], "key bigint, doc_id bigint"))
    runs.add(spark.createDataFrame([(7, 5), (8, 4), (9, 3)], "key bigint, doc_id bigint"))
    merged = spark.table(runs.runs()[0])
    assert sorted(map(tuple, merged.collect())) == [(7, 2, 100), (8, 2, 98), (9, 1, 3)]  # 7 was decided: not three
    left, right = merged, spark.table(runs.runs()[0]).withColumnRenamed("key", "other")
    plan = left.join(right.hint("merge"), F.col("key") == F.col("other"), "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
