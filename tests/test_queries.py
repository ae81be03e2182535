"""Every registered query with SQL gives exactly the SQL's rows; the entry point runs."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_cluster_classify_runs_the_flow_at_its_own_size(monkeypatch):
    from twinfold.plans.cluster_flow import ClusterFlowConfig
    from twinfold.queries import registry

    class Result:
        predictions = "predictions"

    ran = []
    monkeypatch.setattr(registry, "cohort_tables", lambda spark, folder: ("pos", "neg", "ss"))
    monkeypatch.setattr(registry, "cluster_then_classify", lambda *args: ran.append(args) or Result)
    assert registry.cluster_classify(None, "folder") == "predictions"
    assert ran == [("pos", "neg", "ss", ClusterFlowConfig())]


def test_score_union_joins_the_members_once(spark):
    found = entry.queries()["score_union"](spark, FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_entry_point(spark):
    assert entry.entry(spark).count() == 10


def test_older_signatures(spark):
    from twinfold import compat

    df = spark.range(12).selectExpr("id % 4 as m", "id as patid")
    tagged = compat.AppendDataMatchingFoldIDs(df, nFolds=2, matchCol="m", foldCol="f", colsToKeep=["patid"], nDesiredPartitions=2)
    assert tagged.columns == ["m", "patid", "f"] and tagged.count() == 12
    assert compat.BinaryClassificationEvaluatorWithPrecisionAtRecall().isLargerBetter()
