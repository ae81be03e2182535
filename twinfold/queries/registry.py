"""Every registered query, with its oracle SQL where the result can be written as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions import columns as fx
from twinfold.operators import cohort as co
from twinfold.operators import crossval, curve, distance, fits, folds, ranking, scores
from twinfold.operators.clustering import (
    assemble,
    centres_of,
    cluster_rows,
    mark_near_by_cluster,
    similar_controls_by_cluster,
    split_test_rows,
    with_discarded,
)
from twinfold.operators.evaluator import PrecisionRecallEvaluator
from twinfold.plans.cleaning import clean_cohort
from twinfold.plans.cluster_flow import ClusterFlowConfig, cluster_then_classify, flow_metrics, tag_eval_folds
from twinfold.plans.two_stage import (
    TwoStageConfig,
    fit_unpenalised,
    held_out_scores,
    inner_fold_table,
    run_two_stage,
    two_stage,
)
from twinfold.plans.undersampling import run_undersampling
from twinfold.queries import sql
from twinfold.session import materialise, scratch_path
from twinfold.sources import orders_cohort as oc
from twinfold.sources.grouped import SLICE_COL, group_layout
from twinfold.sources.sinks import run_manifest, stage_counts, write_metrics, write_results
from twinfold.sources.tables import (
    exclusion_names,
    normalise_ids,
    read_cohort,
    read_part_files,
    rename_columns,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RECALLS = list(curve.STANDARD_RECALLS)
IDS = "matched_positive_id, label, patid"
ALL_FEATURES = [*oc.COUNTS, *oc.FLAGS, "DISC_AVG_RXDX"]
SEED = 42


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def study(rows: DataFrame) -> DataFrame:
    """Cases and controls of a cohort table."""
    return rows.filter(F.col("population") == "pn")


def cohort_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Case, control and scoring tables. Stored first: the order lines are aggregated once, not per table."""
    return oc.split(materialise(oc.cohort(spark, folder), "cohort"))


def stored_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flag rows for operators that pass over their input several times."""
    return materialise(oc.flag_rows(spark, folder), "flags")


# --- sources, cleaning, projections -------------------------------------------------------------

TOPCODED = (
    "least(SYMP_CNT, 7) AS SYMP_CNT2, least(COMOR_CNT, 5) AS COMOR_CNT2, "
    "least(NRCOMOR_CNT, 11) AS NRCOMOR_CNT2, least(PROC_CNT, 5) AS PROC_CNT2"
)


@register("topcode_counts", sql.query(sql.COHORT, select=f"SELECT patid, {TOPCODED} FROM cohort"))
def topcode_counts(spark, folder):
    rows = oc.cohort(spark, folder).select("patid", *oc.COUNTS)
    return fx.topcode(rows)


@register(
    "normalise_ids",
    sql.query(
        sql.MEMBERS,
        select="""
  SELECT 'case_copy' AS layout, patid AS matched_positive_id, patid, label FROM members
  WHERE population = 'pn' AND label = 1
  UNION ALL SELECT 'control_rename', matched_positive_id, patid, label FROM members
  WHERE population = 'pn' AND label = 0
  UNION ALL SELECT 'patient_id', matched_positive_id, patid, label FROM members WHERE population = 'ss'
  UNION ALL SELECT 'indexed_patient_id', matched_positive_id, patid, label FROM members""",
    ),
)
def normalise_id_layouts(spark, folder):
    rows = oc.members(spark, folder)
    in_study, case = F.col("population") == "pn", F.col("label") == 1
    match, pat, label = F.col("matched_positive_id"), F.col("patid"), F.col("label")
    raw = {
        "case_copy": rows.filter(in_study & case).select(pat, match.alias("nonipf_patid"), label),
        "control_rename": rows.filter(in_study & ~case).select(
            match.alias("patid"), pat.alias("nonipf_patid"), label
        ),
        "patient_id": rows.filter(~in_study).select(
            match.alias("matched_patient_id"), pat.alias("patient_id"), label
        ),
        "indexed_patient_id": rows.select(
            pat.alias("X"), match.alias("matched_patient_id"), pat.alias("patient_id"), label
        ),
    }
    tables = [normalise_ids(df, layout).withColumn("layout", F.lit(layout)) for layout, df in raw.items()]
    return co.union_all(tables).select("layout", "matched_positive_id", "patid", "label")


@register(
    "exclude_columns",
    sql.query(
        sql.COHORT,
        select="SELECT matched_positive_id, label, patid, SYMP_CNT, COMOR_CNT, NRCOMOR_CNT, PROC_CNT, "
        "RETURN_FLAG, OPEN_FLAG FROM cohort",
    ),
)
def exclude_columns(spark, folder):
    names = spark.createDataFrame([("URGENT",), ("DISC",)], "variable string")
    excluded = [r.excluded for r in exclusion_names(names).collect()]
    return fx.drop_excluded(oc.cohort(spark, folder).drop("population"), excluded)


@register(
    "exclusion_names",
    """SELECT concat(o_orderpriority, s) AS excluded, count(*) AS n_rows
       FROM orders, (VALUES ('_FLAG'), ('_AVG_RXDX')) AS t(s) GROUP BY ALL""",
)
def exclusion_name_pairs(spark, folder):
    names = oc.table(spark, folder, "orders").select("o_orderpriority")
    return exclusion_names(names).groupBy("excluded").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "clean_cohort",
    sql.query(
        sql.COHORT,
        select=f"""SELECT CASE WHEN population = 'ss' THEN 'ss' WHEN label = 1 THEN 'pos' ELSE 'neg' END AS part,
  {IDS}, RETURN_FLAG, OPEN_FLAG, {TOPCODED} FROM cohort""",
    ),
)
def cleaned(spark, folder):
    names = {"matched_positive_id": "matched_patient_id", "patid": "patient_id"}
    raw = [rename_columns(df, names) for df in cohort_tables(spark, folder)]
    excluded = ["URGENT_FLAG", "URGENT_AVG_RXDX", "DISC_FLAG", "DISC_AVG_RXDX"]
    parts = clean_cohort(*raw, excluded=excluded)
    return co.union_all([df.withColumn("part", F.lit(p)) for p, df in zip(("pos", "neg", "ss"), parts)])


@register("flag_predictors", sql.query(sql.COHORT, select=f"SELECT {IDS}, {', '.join(oc.FLAGS)} FROM cohort"))
def flag_predictors(spark, folder):
    rows = oc.flag_rows(spark, folder)
    return rows.select(*oc.IDS, *fx.flag_columns(fx.predictor_columns(rows.columns)))


@register(
    "label_as_double",
    sql.query(sql.MEMBERS, select=f"SELECT {IDS} FROM members"),
)
def label_cast(spark, folder):
    rows = oc.members(spark, folder).select(*oc.IDS).withColumn("label", F.col("label").cast("int"))
    return fx.label_as_double(rows)


@register(
    "assemble_features",
    sql.query(
        sql.COHORT,
        select=f"SELECT {IDS}, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(ALL_FEATURES))
        + " FROM cohort",
    ),
)
def assembled(spark, folder):
    vectors = assemble(oc.cohort(spark, folder), ALL_FEATURES)
    return vectors.select(
        *oc.IDS, *[fx.vector_element("features", i).alias(f"f{i}") for i in range(len(ALL_FEATURES))]
    )


@register(
    "score_transforms",
    sql.query(
        sql.SCORED,
        select="""SELECT patid, round(prob_1, 3) AS rounded,
  round(CASE WHEN prob_1 > 0 THEN log10(prob_1) END, 9) AS log_score FROM scored""",
    ),
)
def score_transforms(spark, folder):
    p = F.col("prob_1")
    return oc.scored(spark, folder).select(
        "patid", fx.quantised(p).alias("rounded"), F.round(fx.log10_score(p), 9).alias("log_score")
    )


@register(
    "csv_round_trip",
    sql.query(sql.COHORT, select=f"SELECT {IDS}, {', '.join(ALL_FEATURES)} FROM cohort"),
)
def csv_round_trip(spark, folder):
    """Write the cohort as CSV part files in the shared folder and read them back with a declared schema."""
    rows = oc.cohort(spark, folder).drop("population")
    path = scratch_path(spark, "cohort-csv")
    write_results(rows, path, fmt="csv")
    return read_part_files(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))


@register(
    "run_manifest",
    sql.query(
        sql.MEMBERS,
        select="""SELECT 'rows' AS entry, CASE WHEN population = 'ss' THEN 'n_rows_ss' WHEN label = 1
  THEN 'n_rows_pos' ELSE 'n_rows_neg' END AS name, CAST(count(*) AS VARCHAR) AS value FROM members GROUP BY ALL
  UNION ALL SELECT 'setting', 'n_clusters', '3' UNION ALL SELECT 'setting', 'n_eval_folds', '5'""",
    ),
)
def manifest(spark, folder):
    pos, neg, ss = oc.split(oc.members(spark, folder))
    tables = {"n_rows_pos": pos, "n_rows_neg": neg, "n_rows_ss": ss}
    return run_manifest(tables, {"n_clusters": 3, "n_eval_folds": 5})


@register(
    "stage_counts",
    sql.query(
        sql.MEMBERS,
        sql.folds("members"),
        select="""SELECT foldID, population, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_cases
  FROM members JOIN folds USING (matched_positive_id) GROUP BY ALL""",
    ),
)
def counts_per_stage(spark, folder):
    rows = folds.assign_folds(oc.members(spark, folder), 5, seed=SEED)
    return stage_counts(rows, "foldID", "population")


# --- cohort selection: joins, set operations, sampling ------------------------------------------


@register(
    "case_controls_join",
    sql.query(
        sql.MEMBERS,
        select=f"""SELECT {IDS} FROM members WHERE population = 'pn' AND label = 0 AND matched_positive_id IN (
  SELECT matched_positive_id FROM members WHERE population = 'pn' AND label = 1 AND priority = '1-URGENT')""",
    ),
)
def case_controls(spark, folder):
    pos, neg, _ = oc.split(oc.members(spark, folder))
    return co.rows_of_cases(neg, pos.filter(F.col("priority") == "1-URGENT")).select(*oc.IDS)


@register(
    "rows_per_case",
    sql.query(
        sql.MEMBERS,
        select="""SELECT s.matched_positive_id, s.label, s.patid FROM members s JOIN members c
  ON s.matched_positive_id = c.matched_positive_id AND c.population = 'pn' AND c.label = 1
     AND c.priority = '1-URGENT' WHERE s.population = 'ss'""",
    ),
)
def rows_per_case(spark, folder):
    pos, _, ss = oc.split(oc.members(spark, folder))
    return co.rows_per_case(ss, pos.filter(F.col("priority") == "1-URGENT")).select(*oc.IDS)


@register(
    "rows_by_id",
    sql.query(
        sql.COHORT,
        f"picked AS (SELECT patid FROM members WHERE population = 'pn' AND {sql.score()} >= 0.6)",
        select=f"SELECT {IDS}, {', '.join(oc.FLAGS)} FROM cohort WHERE patid IN (SELECT patid FROM picked)",
    ),
)
def rows_by_id(spark, folder):
    picked = oc.scored(spark, folder).filter(F.col("prob_1") >= 0.6)
    return co.rows_by_id(oc.flag_rows(spark, folder), picked).select(*oc.IDS, *oc.FLAGS)


@register(
    "test_set_assembly",
    sql.query(
        sql.MEMBERS,
        sql.folds("(SELECT * FROM members WHERE population = 'pn')"),
        select=f"""SELECT {IDS} FROM members JOIN folds USING (matched_positive_id) WHERE foldID = 0""",
    ),
)
def test_set(spark, folder):
    pos, neg, ss = (df.select(*oc.IDS) for df in oc.split(oc.members(spark, folder)))
    tagged = folds.assign_folds(co.union_all([pos, neg]), 5, seed=SEED)
    return co.assemble_test_set(pos, neg, ss, folds.held_out(tagged, 0))


@register(
    "fold_split",
    sql.query(
        sql.SCORED,
        sql.folds("scored"),
        select=f"""SELECT {IDS}, CASE WHEN foldID = 1 THEN 'held_out' ELSE 'train' END AS part
  FROM scored JOIN folds USING (matched_positive_id)""",
    ),
)
def fold_split(spark, folder):
    tagged = folds.assign_folds(study(oc.members(spark, folder)).select(*oc.IDS), 5, seed=SEED)
    held, train = folds.held_out(tagged, 1), folds.remaining(tagged, 1)
    return co.union_all([held.withColumn("part", F.lit("held_out")), train.withColumn("part", F.lit("train"))])


@register(
    "complement_rows",
    sql.query(
        sql.SCORED,
        select=f"""SELECT {IDS}, CASE WHEN prob_1 >= 0.4 THEN prob_1 ELSE 0 END AS prob_1 FROM scored""",
    ),
)
def complement(spark, folder):
    rows = oc.scored(spark, folder)
    kept = rows.filter(F.col("prob_1") >= 0.4)
    return with_discarded(kept, rows.drop("prob_1"))


@register(
    "distinct_difference",
    sql.query(
        sql.MEMBERS,
        select="""SELECT matched_positive_id FROM members WHERE population = 'pn'
  EXCEPT SELECT matched_positive_id FROM members WHERE population = 'ss'""",
    ),
)
def difference(spark, folder):
    rows = oc.members(spark, folder)
    ids = rows.select("matched_positive_id")
    return co.distinct_difference(ids.filter(F.col("population") == "pn"), ids.filter(F.col("population") == "ss"))


@register(
    "hash_sample",
    sql.query(
        sql.MEMBERS,
        select=f"""SELECT {IDS} FROM members
  WHERE CAST('0x' || substr(md5(concat('1:', patid)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < 0.1""",
    ),
)
def hash_sampled(spark, folder):
    return co.hash_sample(oc.members(spark, folder).select(*oc.IDS), 0.1)


@register("bernoulli_sample")
def bernoulli_sampled(spark, folder):
    return co.sample_rows(oc.members(spark, folder).select(*oc.IDS), 0.1, method="bernoulli")


@register(
    "bernoulli_sample_rows",
    sql.query(sql.MEMBERS, select="SELECT count(*) AS n_rows, TRUE AS subset, TRUE AS once, TRUE AS within FROM members"),
)
def bernoulli_sample_rows(spark, folder):
    """Spark's own sample holds rows of the table, each as often as the table, and as many as its share allows.

    The number of rows may be 6 standard deviations off, which a right sample exceeds once in about 10**9 runs.
    """
    keys = [F.col(c) for c in oc.IDS]
    rows = oc.members(spark, folder).select(*oc.IDS)
    drawn = co.sample_rows(rows, 0.1, method="bernoulli").groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    both = held.join(drawn, list(oc.IDS), "full")
    sums = both.agg(
        F.sum("held").alias("n_rows"), F.every(F.col("held").isNotNull()).alias("subset"),
        F.every(F.coalesce("times", F.lit(0)) <= F.coalesce("held", F.lit(0))).alias("once"), F.coalesce(F.sum("times"), F.lit(0)).alias("_drawn"),
    )
    off = F.abs(F.col("_drawn") - 0.1 * F.col("n_rows"))
    return sums.select("n_rows", "subset", "once", (off <= 6 * F.sqrt(0.09 * F.col("n_rows"))).alias("within"))


@register(
    "matched_undersample",
    sql.query(
        sql.MEMBERS,
        """cases AS (
  SELECT * FROM members WHERE population = 'pn' AND label = 1
  AND CAST('0x' || substr(md5(concat('1:', patid)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < 0.1)""",
        select="""SELECT 'pos' AS part, matched_positive_id, label, patid FROM cases
  UNION ALL SELECT part, matched_positive_id, label, patid FROM (
    SELECT CASE WHEN population = 'ss' THEN 'ss' ELSE 'neg' END AS part, matched_positive_id, label, patid,
           row_number() OVER (PARTITION BY population, matched_positive_id ORDER BY label, patid) AS r
    FROM members WHERE (population = 'ss' OR label = 0)
      AND matched_positive_id IN (SELECT matched_positive_id FROM cases))
  WHERE r <= CASE WHEN part = 'neg' THEN 5 ELSE 10 END""",
    ),
)
def undersampled(spark, folder):
    parts = co.undersample_cohort(*(df.select(*oc.IDS) for df in oc.split(oc.members(spark, folder))), ratio=0.1)
    return co.union_all([df.withColumn("part", F.lit(p)) for p, df in zip(("pos", "neg", "ss"), parts)])


@register(
    "undersample_job",
    sql.query(
        sql.MEMBERS,
        """cases AS (
  SELECT ratio, members.* FROM members, (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.3 AS DOUBLE))) AS r(ratio)
  WHERE population = 'pn' AND label = 1
  AND CAST('0x' || substr(md5(concat('1:', patid)), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < ratio)""",
        select="""SELECT ratio, 'pos' AS part, matched_positive_id, label, patid FROM cases
  UNION ALL SELECT ratio, part, matched_positive_id, label, patid FROM (
    SELECT ratio, CASE WHEN members.population = 'ss' THEN 'ss' ELSE 'neg' END AS part, members.matched_positive_id,
           members.label, members.patid,
           row_number() OVER (PARTITION BY ratio, members.population, members.matched_positive_id
                              ORDER BY members.label, members.patid) AS r
    FROM members JOIN cases ON members.matched_positive_id = cases.matched_positive_id
    WHERE members.population = 'ss' OR members.label = 0)
  WHERE r <= CASE WHEN part = 'neg' THEN 5 ELSE 10 END""",
    ),
)
def undersample_job(spark, folder):
    """The job on CSV files, its output read back."""
    kinds = "matched_positive_id bigint, label double, patid bigint"
    source, out = scratch_path(spark, "cohort-csv"), scratch_path(spark, "undersampled")
    paths = {}
    for part, df in zip(("pos", "neg", "ss"), oc.split(oc.members(spark, folder))):
        paths[part] = f"{source}/{part}"
        write_results(df.select("matched_positive_id", "label", "patid"), paths[part], fmt="csv")
    written = run_undersampling(spark, paths, (0.1, 0.3), out, schema=kinds)
    tables = [
        read_cohort(spark, path, kinds, "csv").withColumns({"ratio": F.lit(ratio), "part": F.lit(part)})
        for ratio, parts in written.items()
        for part, path in parts.items()
    ]
    return co.union_all(tables).select("ratio", "part", "matched_positive_id", "label", "patid")


@register(
    "top_rows_per_group",
    sql.query(
        sql.SCORED,
        select=f"""SELECT {IDS} FROM scored
  QUALIFY row_number() OVER (PARTITION BY matched_positive_id ORDER BY label, patid) <= 5""",
    ),
)
def top_rows(spark, folder):
    return ranking.top_n_per_group(study(oc.members(spark, folder)).select(*oc.IDS), 5, order_by=["label", "patid"])


# --- folds and global ranks ---------------------------------------------------------------------


@register(
    "fold_assign",
    sql.query(
        sql.SCORED, sql.folds("scored"), select=f"SELECT {IDS}, foldID FROM scored JOIN folds USING (matched_positive_id)"
    ),
)
def fold_assign(spark, folder):
    rows = study(oc.members(spark, folder))
    return folds.assign_folds(rows, 5, cols_to_keep=["label", "patid"], seed=SEED)


@register(
    "fold_balance",
    sql.query(
        sql.SCORED,
        sql.folds("scored"),
        select="""SELECT foldID, count(DISTINCT matched_positive_id) AS n_groups, count(*) AS n_rows,
  CAST(sum(label) AS BIGINT) AS n_cases FROM scored JOIN folds USING (matched_positive_id) GROUP BY foldID""",
    ),
)
def fold_balance(spark, folder):
    tagged = folds.assign_folds(study(oc.members(spark, folder)).select(*oc.IDS), 5, seed=SEED)
    return folds.fold_summary(tagged)


@register(
    "fold_validation",
    sql.query(
        sql.SCORED, sql.folds("scored", 4), select="SELECT CAST(count(DISTINCT foldID) AS INTEGER) AS n_folds FROM folds"
    ),
)
def fold_validation(spark, folder):
    tagged = folds.assign_folds(study(oc.members(spark, folder)).select(*oc.IDS), 4, seed=SEED)
    gap = tagged.filter("foldID <> 1")
    try:
        folds.validate_folds(gap)
    except ValueError:
        n = folds.validate_folds(tagged)
        return tagged.agg(F.lit(n).cast("int").alias("n_folds"))
    raise AssertionError("a gap in the fold ids was not found")


@register(
    "round_robin_folds",
    sql.query(
        sql.SCORED,
        select=f"""SELECT {IDS}, CAST((row_number() OVER (ORDER BY matched_positive_id, patid) - 1) % 3 AS INTEGER)
  AS foldID FROM scored""",
    ),
)
def round_robin(spark, folder):
    rows = study(oc.members(spark, folder)).select(*oc.IDS)
    return folds.round_robin_folds(rows, 3, ["matched_positive_id", "patid"], row_key=["patid"])


@register(
    "global_row_index",
    sql.query(
        sql.SCORED,
        select=f"SELECT {IDS}, prob_1, row_number() OVER (ORDER BY prob_1 DESC, patid) - 1 AS index FROM scored",
    ),
)
def row_index(spark, folder):
    return ranking.with_row_index(oc.scored(spark, folder), [F.desc("prob_1"), "patid"], row_key=["patid"])


# --- distances and clusters ---------------------------------------------------------------------


@register(
    "dist_to_centre", sql.query(sql.COHORT, select=f"SELECT patid, {sql.distance(oc.CENTRES[0])} AS dist FROM cohort")
)
def dist_to_centre(spark, folder):
    rows = oc.flag_rows(spark, folder)
    return distance.with_distance(rows, oc.FLAGS, oc.CENTRES[0]).select("patid", "dist")


@register(
    "in_cluster_dist",
    sql.query(
        sql.CLUSTERED,
        select="""SELECT patid, cluster_id, CASE cluster_id WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END AS dist
  FROM clustered""",
    ),
)
def in_cluster_dist(spark, folder):
    rows = oc.flag_rows(spark, folder)
    clustered = rows.withColumn("cluster_id", distance.nearest_centre(oc.FLAGS, oc.CENTRES))
    return distance.with_in_cluster_distance(clustered, oc.FLAGS, "cluster_id", oc.CENTRES).select(
        "patid", "cluster_id", "dist"
    )


@register(
    "array_in_cluster_dist",
    """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings),
  m AS (SELECT label, i, avg(v) AS c FROM x GROUP BY label, i)
SELECT vec_id, x.label, round(sqrt(sum((CAST(v AS DOUBLE) - c) * (CAST(v AS DOUBLE) - c))), 6) AS dist
FROM x JOIN m ON x.label = m.label AND x.i = m.i GROUP BY vec_id, x.label""",
)
def array_in_cluster_dist(spark, folder):
    rows = oc.table(spark, folder, "embeddings")
    centres = distance.array_centres(rows, "embedding", "label")
    out = distance.array_in_cluster_distance(rows, "embedding", "label", centres)
    return out.select("vec_id", "label", F.round("dist", 6).alias("dist"))


@register(
    "cluster_share",
    sql.query(
        sql.CLUSTERED,
        select="""SELECT cluster_id, count(*) AS n_rows, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
  FROM clustered WHERE population = 'pn' AND label = 1 GROUP BY cluster_id""",
    ),
)
def cluster_share(spark, folder):
    cases = study(oc.flag_rows(spark, folder)).filter(F.col("label") == 1)
    return distance.cluster_shares(cases.withColumn("cluster_id", distance.nearest_centre(oc.FLAGS, oc.CENTRES)))


@register(
    "nearest_per_group",
    sql.query(
        sql.COHORT,
        f"controls AS (SELECT *, {sql.distance(oc.CENTRES[1])} AS dist FROM cohort"
        " WHERE population = 'pn' AND label = 0)",
        select="""SELECT matched_positive_id, patid, dist FROM controls
  QUALIFY row_number() OVER (PARTITION BY matched_positive_id ORDER BY dist, patid) <= (
    SELECT round(count(*) / CAST(count(DISTINCT matched_positive_id) AS DOUBLE) * 0.4) FROM controls)""",
    ),
)
def nearest_per_group(spark, folder):
    controls = study(stored_flags(spark, folder)).filter(F.col("label") == 0)
    out = distance.nearest_per_group(controls, oc.FLAGS, oc.CENTRES[1], 0.4)
    return out.select("matched_positive_id", "patid", "dist")


@register(
    "nearest_overall",
    sql.query(
        sql.COHORT,
        f"d AS (SELECT *, {sql.distance(oc.CENTRES[2])} AS dist FROM cohort)",
        select="""SELECT matched_positive_id, patid, dist FROM d
  QUALIFY row_number() OVER (ORDER BY dist, patid) <= (SELECT round(count(*) * CAST(0.37 AS DOUBLE)) FROM d)""",
    ),
)
def nearest_overall(spark, folder):
    rows = stored_flags(spark, folder)
    out = distance.nearest_overall(rows, oc.FLAGS, oc.CENTRES[2], 0.37)
    return out.select("matched_positive_id", "patid", "dist")


@register(
    "similar_controls",
    sql.query(
        sql.CLUSTERED,
        """cases AS (SELECT * FROM clustered WHERE population = 'pn' AND label = 1),
shares AS (SELECT cluster_id, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM cases GROUP BY cluster_id),
matched AS (
  SELECT c.matched_positive_id, c.patid, s.cluster_id, shares.share,
         CASE s.cluster_id WHEN 0 THEN c.d0 WHEN 1 THEN c.d1 ELSE c.d2 END AS dist
  FROM clustered c JOIN cases s ON c.matched_positive_id = s.matched_positive_id
  JOIN shares ON s.cluster_id = shares.cluster_id
  WHERE c.population = 'pn' AND c.label = 0),
sizes AS (SELECT cluster_id, round(count(*) / CAST(count(DISTINCT matched_positive_id) AS DOUBLE) * any_value(share))
  AS n FROM matched GROUP BY cluster_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, matched_positive_id ORDER BY dist, patid) AS r
  FROM matched)""",
        select="""SELECT ranked.cluster_id, matched_positive_id, patid FROM ranked
  JOIN sizes ON ranked.cluster_id = sizes.cluster_id WHERE r <= n""",
    ),
)
def similar_controls_per_cluster(spark, folder):
    rows = study(stored_flags(spark, folder))
    controls = rows.filter(F.col("label") == 0)
    cases = rows.filter(F.col("label") == 1).withColumn("cluster_id", distance.nearest_centre(oc.FLAGS, oc.CENTRES))
    shares = {r.cluster_id: r.share for r in distance.cluster_shares(cases).collect()}
    chosen = similar_controls_by_cluster(controls, cases, oc.FLAGS, oc.CENTRES, shares)
    return chosen.select("cluster_id", "matched_positive_id", "patid")


@register(
    "nearest_test_rows",
    sql.query(
        sql.COHORT,
        f"d AS (SELECT *, {sql.distance(oc.CENTRES[0])} AS dist FROM cohort)",
        select=f"""SELECT {IDS}, CASE WHEN row_number() OVER (ORDER BY dist, patid) <= (
    SELECT round(count(*) * CAST(0.25 AS DOUBLE)) FROM d) THEN 'near' ELSE 'discarded' END AS part FROM d""",
    ),
)
def nearest_test_rows(spark, folder):
    near, rest = split_test_rows(stored_flags(spark, folder), oc.FLAGS, oc.CENTRES[0], 0.25)
    parts = [near.withColumn("part", F.lit("near")), rest.withColumn("part", F.lit("discarded"))]
    return co.union_all(parts).select(*oc.IDS, "part")


NEAR_SHARES = {0: 0.2, 1: 0.5, 2: 0.3}


@register(
    "nearest_by_cluster",
    sql.query(
        sql.CLUSTERED,
        select=" UNION ALL ".join(
            f"""SELECT CAST({c} AS INTEGER) AS cluster_id, patid, row_number() OVER (ORDER BY d{c}, patid)
  <= (SELECT round(count(*) * CAST({share} AS DOUBLE)) FROM clustered) AS near FROM clustered"""
            for c, share in NEAR_SHARES.items()
        ),
    ),
)
def nearest_by_cluster(spark, folder):
    """Test rows near each of three centres; the three cut-offs come from the same passes."""
    marked = mark_near_by_cluster(stored_flags(spark, folder), oc.FLAGS, oc.CENTRES, NEAR_SHARES)
    parts = [df.select(F.lit(cluster).alias("cluster_id"), "patid", "near") for cluster, df in marked.items()]
    return co.union_all(parts)


@register(
    "nearest_with_missing",
    sql.query(
        sql.COHORT,
        f"d AS (SELECT *, CASE WHEN patid % 5 > 0 THEN {sql.distance(oc.CENTRES[2])} END AS dist FROM cohort)",
        select=f"""SELECT {IDS}, CASE WHEN row_number() OVER (ORDER BY dist NULLS LAST, patid) <= (
    SELECT round(count(*) * CAST(0.9 AS DOUBLE)) FROM d) THEN 'near' ELSE 'discarded' END AS part FROM d""",
    ),
)
def nearest_with_missing(spark, folder):
    """Rows without a distance come last, and every row is in one of the two parts."""
    rows = stored_flags(spark, folder)
    rows = rows.withColumn(oc.FLAGS[0], F.when(F.col("patid") % 5 > 0, F.col(oc.FLAGS[0])))
    near, rest = split_test_rows(rows, oc.FLAGS, oc.CENTRES[2], 0.9)
    parts = [near.withColumn("part", F.lit("near")), rest.withColumn("part", F.lit("discarded"))]
    return co.union_all(parts).select(*oc.IDS, "part")


# --- curves and metrics -------------------------------------------------------------------------


@register(
    "score_curve",
    sql.query(
        sql.SCORED,
        sql.curve("scored"),
        select="""SELECT score, tps, fps, CAST(dense_rank() OVER (ORDER BY score DESC) - 1 AS INTEGER) AS rank
  FROM curve""",
    ),
)
def score_curve(spark, folder):
    return curve.score_curve(oc.scored(spark, folder), with_rank=True)


@register(
    "score_curve_unrounded",
    sql.query(sql.SCORED, sql.curve("scored", digits=None), select="SELECT score, tps, fps FROM curve"),
)
def score_curve_unrounded(spark, folder):
    return curve.score_curve(materialise(oc.scored(spark, folder), "scored"), digits=None)


@register(
    "pr_curve", sql.query(sql.SCORED, sql.curve("scored"), sql.pr(), select="SELECT precision, recall FROM pr")
)
def pr_points(spark, folder):
    return curve.pr_curve(oc.scored(spark, folder))


@register(
    "pr_unrounded", sql.query(sql.SCORED, sql.curve("scored", digits=None), sql.pr(), select="SELECT precision, recall FROM pr")
)
def pr_unrounded(spark, folder):
    """The precision-recall curve on every distinct score."""
    return curve.pr_curve(materialise(oc.scored(spark, folder), "scored"), digits=None)


@register(
    "precision_at_recalls",
    sql.query(
        sql.SCORED,
        sql.curve("scored"),
        sql.pr(),
        sql.at_recalls(RECALLS),
        select="SELECT recall, reached_recall, precision FROM found",
    ),
)
def precision_at_recalls(spark, folder):
    return curve.precision_at_recalls(curve.pr_curve(oc.scored(spark, folder)), RECALLS)


def _scope_sql(scope: str, by: str, fold: str, model: str) -> str:
    ctes = [
        "data AS (SELECT * FROM by_model JOIN folds USING (matched_positive_id))",
        sql.curve("data", by),
        sql.pr(by),
        sql.at_recalls([0.05, 0.1, 0.25], by),
    ]
    return f"""SELECT * FROM (WITH {', '.join(ctes)}
  SELECT '{scope}' AS scope, {fold} AS foldID, {model} AS model_id, recall, precision AS value FROM found)"""


@register(
    "metrics_by_scope",
    sql.query(
        sql.BY_MODEL,
        sql.folds("members"),
        select=" UNION ALL ".join(
            [
                _scope_sql("foldID+model_id", "foldID, model_id,", "foldID", "model_id"),
                _scope_sql("foldID", "foldID,", "foldID", "CAST(NULL AS INTEGER)"),
                _scope_sql("all", "", "CAST(NULL AS INTEGER)", "CAST(NULL AS INTEGER)"),
            ]
        ),
    ),
)
def metrics_by_scope(spark, folder):
    groups = folds.fold_table(oc.members(spark, folder), 5, seed=SEED)
    tagged = folds.attach_folds(oc.scored_by_model(spark, folder), groups)
    return curve.metrics_by_scope(tagged, [0.05, 0.1, 0.25], [("foldID", "model_id"), ("foldID",), ()])


@register(
    "areas_by_model",
    sql.query(
        sql.BY_MODEL,
        sql.curve("by_model", "model_id,", None),
        sql.areas("model_id,"),
        select="SELECT model_id, round(area_roc, 9) AS area_roc, round(area_pr, 9) AS area_pr FROM areas",
    ),
)
def areas_by_model(spark, folder):
    found = curve.areas(materialise(oc.scored_by_model(spark, folder), "scored"), by=["model_id"])
    return found.select(
        "model_id", F.round("area_roc", 9).alias("area_roc"), F.round("area_pr", 9).alias("area_pr")
    )


@register(
    "evaluator_metrics",
    sql.query(
        sql.BY_MODEL,
        "whole AS (SELECT * FROM by_model)",
        select=f"""SELECT model_id, metric, round(value, 9) AS value FROM (
  SELECT model_id, 'precisionAtGivenRecall at recallValue 0.05' AS metric, precision AS value FROM (
    WITH {sql.curve("whole", "model_id,")}, {sql.pr("model_id,")}, {sql.at_recalls([0.05], "model_id,")}
    SELECT * FROM found)
  UNION ALL SELECT model_id, unnest(['areaUnderROC', 'areaUnderPR']), unnest([area_roc, area_pr]) FROM (
    WITH {sql.curve("whole", "model_id,", None)}, {sql.areas("model_id,")} SELECT * FROM areas))""",
    ),
)
def evaluator_metrics(spark, folder):
    evaluator = PrecisionRecallEvaluator(rawPredictionCol="prob_1")
    stored = materialise(oc.scored_by_model(spark, folder), "scored")
    found = evaluator.evaluate_groups(stored, ["model_id"])
    return found.select("model_id", "metric", F.round("value", 9).alias("value"))


# --- score merging and the second stage ---------------------------------------------------------


@register("score_union", sql.query(sql.BY_MODEL, select=f"SELECT {IDS}, prob_1, model_id FROM by_model"))
def score_union(spark, folder):
    # stored: a task of a union of joins would hold the sorted rows of every join in it
    rows = materialise(study(oc.members(spark, folder)).select(*oc.IDS), "members")
    tables = {m: rows.select(*oc.IDS, oc.model_score(m).alias("prob_1")) for m in oc.SCORE_FACTORS}
    return scores.union_scores(tables, "model_id")


@register(
    "score_average",
    sql.query(
        sql.BY_MODEL,
        select="SELECT patid, label, round(avg(prob_1), 9) AS avg_prob FROM by_model GROUP BY patid, label",
    ),
)
def score_average(spark, folder):
    merged = scores.average_scores(oc.scored_by_model(spark, folder), len(oc.SCORE_FACTORS))
    return merged.select("patid", "label", F.round("avg_prob", 9).alias("avg_prob"))


@register(
    "positive_score_cut",
    sql.query(
        sql.SCORED, select="SELECT round(quantile_cont(prob_1, 0.75), 9) AS cut FROM scored WHERE label = 1"
    ),
)
def score_cut(spark, folder):
    rows = materialise(oc.scored(spark, folder), "scored")
    cut = scores.positive_score_cut(rows)
    return rows.agg(F.round(F.lit(cut), 9).alias("cut"))


@register(
    "second_stage_subset",
    sql.query(
        sql.SCORED,
        select=f"""SELECT {IDS}, prob_1, round(log10(prob_1), 9) AS logprob_1 FROM scored
  WHERE prob_1 >= (SELECT quantile_cont(prob_1, 0.75) FROM scored WHERE label = 1)""",
    ),
)
def second_stage(spark, folder):
    rows = materialise(oc.scored(spark, folder), "scored")
    kept = scores.second_stage_rows(rows, scores.positive_score_cut(rows))
    return kept.withColumn("logprob_1", F.round("logprob_1", 9))


# --- cross-validation tables --------------------------------------------------------------------

CV_CTES = (
    sql.BY_MODEL,
    sql.folds("members"),
    "data AS (SELECT * FROM by_model JOIN folds USING (matched_positive_id))",
    f"""cv AS (SELECT model_id AS paramSetID, avg(precision) AS metric FROM (
  WITH {sql.curve("data", "foldID, model_id,")}, {sql.pr("foldID, model_id,")},
       {sql.at_recalls([0.05], "foldID, model_id,")} SELECT * FROM found) GROUP BY model_id)""",
)


def cv_table(spark: SparkSession, folder: str) -> DataFrame:
    """Mean precision at recall 0.05 over five folds, for each model's scores."""
    groups = folds.fold_table(oc.members(spark, folder), 5, seed=SEED)
    tagged = folds.attach_folds(oc.scored_by_model(spark, folder), groups)
    keys = ["foldID", "model_id"]
    found = curve.precision_at_recalls(curve.pr_curve(tagged, by=keys), [0.05], keys)
    per_fold = found.select(
        "foldID", F.col("model_id").alias("paramSetID"), F.lit("metric").alias("metric"), F.col("precision").alias("value")
    )
    return crossval.average_fold_metrics(per_fold, ["metric"])


@register("cv_metrics_avg", sql.query(*CV_CTES, select="SELECT paramSetID, round(metric, 9) AS metric FROM cv"))
def cv_metrics_avg(spark, folder):
    return cv_table(spark, folder).select("paramSetID", F.round("metric", 9).alias("metric"))


@register(
    "best_params",
    sql.query(
        *CV_CTES,
        select="""SELECT paramSetID, round(metric, 9) AS metric,
  row_number() OVER (ORDER BY metric DESC, paramSetID) = 1 AS is_best FROM cv""",
    ),
)
def best_params(spark, folder):
    table = cv_table(spark, folder)
    return crossval.mark_best(table, "metric").withColumn("metric", F.round("metric", 9))


# --- deterministic parts of the two flows -------------------------------------------------------


@register(
    "eval_fold_rows",
    sql.query(
        sql.COHORT,
        sql.folds("(SELECT * FROM cohort WHERE population = 'pn')", column="eval_fold"),
        select=f"""SELECT {IDS}, CASE WHEN population = 'ss' THEN 'ss' WHEN label = 1 THEN 'pos' ELSE 'neg' END AS part,
  {', '.join(oc.FLAGS)}, eval_fold FROM cohort JOIN folds USING (matched_positive_id)""",
    ),
)
def eval_fold_rows(spark, folder):
    tables = oc.split(stored_flags(spark, folder))
    return tag_eval_folds(*tables, 5, SEED).withColumnRenamed("_part", "part")


GROUP_BUCKETS = 1000


@register(
    "group_slices",
    sql.query(
        sql.MEMBERS,
        "sizes AS (SELECT matched_positive_id, count(*) AS n FROM members GROUP BY matched_positive_id)",
        f"""shares AS (SELECT *, ceil((SELECT count(*) FROM members) / CAST({GROUP_BUCKETS} AS DOUBLE)) AS share FROM sizes),
sliced AS (SELECT matched_positive_id, CASE WHEN n > share THEN 1 ELSE 0 END AS low,
  CASE WHEN n > share THEN CAST(ceil(n / share) AS INTEGER) ELSE 0 END AS high FROM shares)""",
        select="""SELECT matched_positive_id, CAST(unnest(generate_series(low, high)) AS INTEGER) AS slice FROM sliced""",
    ),
)
def group_slices(spark, folder):
    rows = oc.members(spark, folder)
    layout = group_layout(rows, scratch_path(spark, "layout"), n_buckets=GROUP_BUCKETS)
    ids = rows.select("matched_positive_id").distinct()
    return layout.by_slice(ids).withColumnRenamed(SLICE_COL, "slice")


@register(
    "grouped_inner_folds",
    sql.query(
        sql.MEMBERS,
        "study AS (SELECT * FROM members WHERE population = 'pn')",
        sql.folds("study", column="eval_fold"),
        sql.folds("(SELECT * FROM folds WHERE eval_fold <> 0)", 5, SEED + 1, "inner_folds", "inner_fold"),
        select=f"""SELECT {IDS}, eval_fold, inner_fold FROM study JOIN folds USING (matched_positive_id)
  JOIN inner_folds USING (matched_positive_id)""",
    ),
)
def grouped_inner_folds(spark, folder):
    rows = study(oc.members(spark, folder)).select(*oc.IDS)
    path = scratch_path(spark, "by-group")
    layout = group_layout(rows, f"{path}/layout")
    outer = folds.fold_table(rows, 5, fold_col="eval_fold", seed=SEED)
    tagged = layout.store(layout.attach(layout.place(rows), outer), f"{path}/rows", ("eval_fold",))
    train = tagged.filter(F.col("eval_fold") != 0)
    inner = folds.fold_table(train, 5, fold_col="inner_fold", seed=SEED + 1)
    return layout.attach(train, inner).select(*oc.IDS, "eval_fold", "inner_fold")


@register(
    "nested_folds",
    sql.query(
        sql.SCORED,
        sql.folds("scored", column="sim"),
        *[
            sql.folds(f"(SELECT * FROM folds WHERE sim <> {i})", 5, SEED + 1 + i, f"inner{i}", "inner_fold")
            for i in range(5)
        ],
        select=" UNION ALL ".join(f"SELECT {i} AS sim, * FROM inner{i}" for i in range(5)),
    ),
)
def nested_folds(spark, folder):
    outer = materialise(folds.fold_table(study(oc.members(spark, folder)), 5, fold_col="sim", seed=SEED), "outer")
    parts = [inner_fold_table(outer, i, 5, SEED).withColumn("sim", F.lit(i)) for i in range(5)]
    return co.union_all(parts).select("sim", "matched_positive_id", F.col("_inner").alias("inner_fold"))


@register(
    "held_out_scores",
    sql.query(
        sql.BY_MODEL,
        sql.folds("members"),
        select=f"""SELECT {IDS}, foldID, prob_1 FROM by_model JOIN folds USING (matched_positive_id)
  WHERE model_id = foldID""",
    ),
)
def held_out(spark, folder):
    rows = study(oc.members(spark, folder))
    by_model = F.array(*[oc.model_score(m) for m in oc.SCORE_FACTORS])
    groups = folds.fold_table(oc.members(spark, folder), 5, seed=SEED)
    tagged = folds.attach_folds(rows.select(*oc.IDS, by_model.alias("_scores")), groups)
    return held_out_scores(tagged, "foldID").select(*oc.IDS, "foldID", "prob_1")


def _flow_scope_sql(scope: str, source: str, by: str, fold: str, cluster: str) -> str:
    ctes = [sql.curve(source, by), sql.pr(by), sql.at_recalls([0.05, 0.25], by)]
    return f"""SELECT * FROM (WITH {', '.join(ctes)}
  SELECT '{scope}' AS scope, {fold} AS fold, {cluster} AS cluster, recall, precision AS value FROM found)"""


@register(
    "flow_metrics_max",
    sql.query(
        sql.BY_MODEL,
        sql.folds("members", column="fold"),
        "data AS (SELECT *, model_id AS cluster FROM by_model JOIN folds USING (matched_positive_id))",
        "best AS (SELECT fold, patid, label, max(prob_1) AS prob_1 FROM data GROUP BY fold, patid, label)",
        select=" UNION ALL ".join(
            [
                _flow_scope_sql("fold+cluster", "data", "fold, cluster,", "fold", "cluster"),
                _flow_scope_sql("fold", "best", "fold,", "fold", "CAST(NULL AS INTEGER)"),
                _flow_scope_sql("all", "best", "", "CAST(NULL AS INTEGER)", "CAST(NULL AS INTEGER)"),
            ]
        ),
    ),
)
def flow_metrics_max(spark, folder):
    groups = folds.fold_table(oc.members(spark, folder), 5, fold_col="fold", seed=SEED)
    tagged = folds.attach_folds(oc.scored_by_model(spark, folder), groups)
    predictions = materialise(tagged.withColumnRenamed("model_id", "cluster"), "predictions")
    return flow_metrics(predictions, ClusterFlowConfig(recalls=(0.05, 0.25), combine="max"))


@register(
    "metrics_sink",
    sql.query(
        sql.BY_MODEL,
        sql.curve("by_model", "model_id,", None),
        sql.areas("model_id,"),
        select="SELECT 7 AS run, model_id, round(area_roc, 9) AS area_roc, round(area_pr, 9) AS area_pr FROM areas",
    ),
)
def metrics_sink(spark, folder):
    """Append a metrics table with its run key to a results folder and read the folder back."""
    path = scratch_path(spark, "metrics")
    write_metrics(areas_by_model(spark, folder), path, {"run": 7})
    return spark.read.parquet(path)


# --- fitted models with known results -----------------------------------------------------------


@register(
    "kmeans_points",
    sql.query(
        sql.COHORT,
        "cases AS (SELECT * FROM cohort WHERE population = 'pn' AND label = 1)",
        select="""SELECT patid, count(*) OVER (PARTITION BY RETURN_FLAG, OPEN_FLAG, URGENT_FLAG) AS in_cluster,
  CAST(0 AS DOUBLE) AS dist FROM cases""",
    ),
)
def kmeans_points(spark, folder):
    """With a cluster for every different point, each point is its own centre."""
    cases = study(stored_flags(spark, folder)).filter(F.col("label") == 1).drop("population")
    k = cases.select(*oc.FLAGS).distinct().count()
    _, clustered = cluster_rows(cases, oc.FLAGS, k=k, seed=SEED)
    sizes = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("in_cluster"))
    return clustered.join(sizes, "cluster_id").select("patid", "in_cluster", F.round("dist", 6).alias("dist"))


@register(
    "cell_logit",
    sql.query(
        sql.COHORT,
        select="""SELECT RETURN_FLAG + 2 * OPEN_FLAG + 4 * URGENT_FLAG AS cell, count(*) AS n_rows,
  round(avg(label), 3) AS prob FROM cohort WHERE population = 'pn' GROUP BY cell""",
    ),
)
def cell_logit(spark, folder):
    """An unpenalised logistic model with one column per cell of the flags predicts each cell's mean label."""
    rows = study(stored_flags(spark, folder))
    cell = F.col("RETURN_FLAG") + 2 * F.col("OPEN_FLAG") + 4 * F.col("URGENT_FLAG")
    columns = [f"C{i}" for i in range(8)]
    rows = rows.withColumn("cell", cell).withColumns({c: (cell == i).cast("double") for i, c in enumerate(columns)})
    vectors = materialise(assemble(rows, columns, keep=("label", "cell")), "cells")
    scored = scores.score_with(vectors, fit_unpenalised(vectors, TwoStageConfig(max_iter=500)))
    return scored.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("prob_1"), 3).alias("prob"))


NET_COLUMNS = [*oc.COUNTS, *oc.FLAGS]
NET_GRID = [(reg, alpha) for reg in (0.01, 0.1, 1.0) for alpha in (0.0, 0.5, 1.0)]


@register(
    "elastic_net_optimal",
    sql.query(
        sql.COHORT,
        select=" UNION ALL ".join(
            f"SELECT p AS paramSetID, '{c}' AS feature, {deviation} AS deviation, TRUE AS optimal FROM (SELECT unnest(range({len(NET_GRID)}))::INTEGER AS p)"
            + (f", (SELECT round(stddev_samp({c}), 6) AS d FROM cohort WHERE population = 'pn')" if c else "")
            for c, deviation in [("", "CAST(NULL AS DOUBLE)"), *[(c, "d") for c in NET_COLUMNS]]
        ),
    ),
)
def elastic_net_optimal(spark, folder):
    """Every fit of an elastic-net grid is optimal: the slope of the loss meets the penalty at each coefficient."""
    rows = materialise(study(oc.cohort(spark, folder)).select("label", "matched_positive_id", "patid", *NET_COLUMNS), "net-rows")
    models = fits.fit_grid(rows, NET_COLUMNS, NET_GRID, maxIter=100_000, tol=1e-10, standardization=True)
    found = fits.elastic_net_certificate(rows, NET_COLUMNS, models)
    return found.select("paramSetID", "feature", F.round("deviation", 6).alias("deviation"), "optimal")


@register(
    "kmeans_fixed_point",
    sql.query(
        sql.COHORT,
        select="""SELECT count(*) AS n_rows, count(*) AS nearest, CAST(1 AS DOUBLE) AS share, TRUE AS fixed
  FROM cohort WHERE population = 'pn' AND label = 1""",
    ),
)
def kmeans_fixed_point(spark, folder):
    """K-means of the cases with three clusters ends at a fixed point, and the shares add up."""
    cases = study(stored_flags(spark, folder)).filter(F.col("label") == 1).drop("population")
    model, clustered = cluster_rows(cases, oc.FLAGS, k=3, seed=SEED)
    found = fits.kmeans_certificate(clustered, oc.FLAGS, centres_of(model), "cluster_id")
    return found.agg(
        F.sum("n_rows").alias("n_rows"), F.sum("nearest").alias("nearest"), F.round(F.sum("share"), 9).alias("share"), F.every("fixed").alias("fixed")
    )


CELLS = [f"C{i}" for i in range(8)]
CELL = "RETURN_FLAG + 2 * OPEN_FLAG + 4 * URGENT_FLAG"


@register(
    "two_stage_cells",
    sql.query(
        sql.COHORT,
        f"cells AS (SELECT patid, matched_positive_id, label, {CELL} AS cell FROM cohort WHERE population = 'pn')",
        sql.folds("cells", column="sim"),
        *[
            sql.folds(f"(SELECT * FROM folds WHERE sim <> {i})", 5, SEED + 1 + i, f"inner{i}", "inner_fold")
            for i in range(5)
        ],
        f"nested AS ({' UNION ALL '.join(f'SELECT {i} AS sim, * FROM inner{i}' for i in range(5))})",
        """own AS (SELECT sim, inner_fold, cell, count(*) AS n, sum(label) AS p
          FROM cells JOIN nested USING (matched_positive_id) GROUP BY ALL)""",
        "whole AS (SELECT sim, cell, sum(n) AS n, sum(p) AS p FROM own GROUP BY ALL)",
        """models AS (SELECT w.sim, m AS inner_fold, w.cell, (w.p - coalesce(o.p, 0)) / (w.n - coalesce(o.n, 0)) AS prob
          FROM whole w CROSS JOIN (SELECT unnest(range(5)) AS m)
          LEFT JOIN own o ON o.sim = w.sim AND o.cell = w.cell AND o.inner_fold = m)""",
        select="""SELECT sim, 'train' AS "set", patid, round(0.7320508 * prob, 2) AS scaled
  FROM cells JOIN nested USING (matched_positive_id) JOIN models USING (sim, inner_fold, cell)
  UNION ALL
  SELECT f.sim, 'test', patid, round(0.7320508 * avg(prob), 2)
  FROM cells JOIN folds f USING (matched_positive_id) JOIN models m ON m.sim = f.sim AND m.cell = cells.cell GROUP BY f.sim, patid""",
    ),
)
def two_stage_cells(spark, folder):
    """The whole two-stage flow with one column per cell of the flags: its first-stage scores are shares of cases.

    Scores are scaled before they are rounded, as shares of few rows lie on the rounding's own borders.
    """
    cell = F.expr(CELL)
    tables = [df.withColumns({c: (cell == i).cast("double") for i, c in enumerate(CELLS)}) for df in cohort_tables(spark, folder)]
    first = two_stage(*tables, TwoStageConfig(max_iter=500), predictors=CELLS).first_stage
    return first.filter(F.col("set") != "rep").select("sim", "set", "patid", F.round(0.7320508 * F.col("prob_1"), 2).alias("scaled"))


@register("two_stage_job", ORACLES["two_stage_cells"])
def two_stage_job(spark, folder):
    """The job from raw CSV files to CSV results, on the same cells.

    Half of the cells are told apart by counts that only top-coding makes equal, the others by flags. A flag that holds
    the label is on the exclusion list.
    """
    cell = F.expr(CELL)
    source = scratch_path(spark, "raw-csv")
    counts = [
        F.when(cell == i, F.lit(cap) + F.col("patid") % 5).otherwise(0).alias(c) for i, (c, cap) in enumerate(fx.COUNT_CAPS.items())
    ]
    flags = [(cell == i).cast("int").alias(f"C{i}_FLAG") for i in range(len(counts), len(CELLS))]
    ids = [F.col("patid").alias("patient_id"), F.col("matched_positive_id").alias("matched_patient_id"), "label"]
    paths = []
    for part, df in zip(("pos", "neg", "ss"), cohort_tables(spark, folder)):
        paths.append(f"{source}/{part}")
        write_results(df.select(*ids, *counts, *flags, F.col("label").cast("int").alias("KNOWN_FLAG")), paths[-1], fmt="csv")
    write_results(spark.createDataFrame([("KNOWN",)], "variable string"), f"{source}/excluded", fmt="csv")
    config = TwoStageConfig(max_iter=500, result_format="csv")
    out = scratch_path(spark, "two-stage-job")
    first = run_two_stage(spark, tuple(paths), f"{source}/excluded", out, config=config).first_stage
    scaled = F.round(0.7320508 * F.col("prob_1"), 2).alias("scaled")
    return first.filter(F.col("set") != "rep").select("sim", "set", F.col("patid").cast("bigint"), scaled)


# --- fitted models: no SQL can repeat an iterative fit ------------------------------------------


@register("kmeans_assign")
def kmeans_assign(spark, folder):
    """Cases by K-means cluster over the flag columns, with the distance to their centre."""
    cases = study(stored_flags(spark, folder)).filter(F.col("label") == 1).drop("population")
    _, clustered = cluster_rows(cases, oc.FLAGS, k=3, seed=SEED)
    return clustered.select("patid", "cluster_id", "dist")


@register("stratified_cv")
def stratified_cv(spark, folder):
    """Metrics of an elastic-net grid over five match-group folds."""
    rows = assemble(study(oc.cohort(spark, folder)), ALL_FEATURES)
    tagged = materialise(folds.assign_folds(rows, 5, seed=SEED), "cv-rows")
    lr = LogisticRegression(maxIter=100_000, standardization=True)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1, 1.0, 10.0]).addGrid(lr.elasticNetParam, [0.0, 0.5, 1.0]).build()
    validator = crossval.FoldCrossValidator(
        estimator=lr,
        estimatorParamMaps=grid,
        evaluator=PrecisionRecallEvaluator(rawPredictionCol="probability"),
        stratifyCol="foldID",
        evaluateOtherMetrics=True,
        otherMetrics=[
            {"metricName": "precisionAtGivenRecall", "metricParams": {"recallValue": 0.05}},
            {"metricName": "precisionAtGivenRecall", "metricParams": {"recallValue": 0.1}},
        ],
        parallelism=8,
    )
    return validator.fit(tagged).avgMetrics


@register("cluster_classify")
def cluster_classify(spark, folder):
    """Predictions of the cluster-then-classify flow at its own size: 915 classifier fits."""
    return cluster_then_classify(*cohort_tables(spark, folder), ClusterFlowConfig()).predictions


@register("two_stage_scores")
def two_stage_scores(spark, folder):
    """Second-stage scores of the two-stage model."""
    return two_stage(*cohort_tables(spark, folder)).second_stage
