"""Oracle SQL: the same results written independently, as plain SQL over the given tables."""

from __future__ import annotations

from twinfold.sources.orders_cohort import CENTRES, FLAGS, SCORE_FACTORS

MEMBERS = """members AS (
  SELECT o_orderkey AS patid, o_custkey AS matched_positive_id,
         CASE WHEN o_orderstatus = 'P' THEN 'ss' ELSE 'pn' END AS population,
         CASE WHEN o_orderstatus <> 'P' AND row_number() OVER (
                PARTITION BY o_custkey, o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey) = 1
              THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label,
         o_orderpriority AS priority
  FROM orders)"""

COHORT = (
    MEMBERS
    + """, lines AS (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps,
         CAST(sum(l_linenumber) AS BIGINT) AS numbers,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
         max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS is_open,
         round(avg(l_discount), 6) AS rate
  FROM lineitem GROUP BY l_orderkey),
cohort AS (
  SELECT matched_positive_id, label, patid, population,
         coalesce(n, 0) AS SYMP_CNT, coalesce(parts, 0) AS COMOR_CNT, coalesce(supps, 0) AS NRCOMOR_CNT,
         coalesce(numbers, 0) AS PROC_CNT, coalesce(returned, 0) AS RETURN_FLAG, coalesce(is_open, 0) AS OPEN_FLAG,
         CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END AS URGENT_FLAG,
         coalesce(rate, CAST(0 AS DOUBLE)) AS DISC_AVG_RXDX
  FROM members LEFT JOIN lines ON patid = l_orderkey)"""
)


def score(model: int = 0) -> str:
    return f"((patid * {SCORE_FACTORS[model]}) % 10007 + label * 2000) / CAST(12011 AS DOUBLE)"


SCORED = (
    MEMBERS
    + f""", scored AS (
  SELECT matched_positive_id, label, patid, {score()} AS prob_1 FROM members WHERE population = 'pn')"""
)
BY_MODEL = (
    MEMBERS
    + ", by_model AS ("
    + " UNION ALL ".join(
        f"SELECT matched_positive_id, label, patid, {m} AS model_id, {score(m)} AS prob_1"
        " FROM members WHERE population = 'pn'"
        for m in SCORE_FACTORS
    )
    + ")"
)


def folds(source: str, k: int = 5, seed: int = 42, name: str = "folds", column: str = "foldID") -> str:
    return f"""{name} AS (
  SELECT matched_positive_id,
         CAST((row_number() OVER (ORDER BY md5(concat('{seed}:', matched_positive_id)), matched_positive_id) - 1)
              % {k} AS INTEGER) AS {column}
  FROM (SELECT DISTINCT matched_positive_id FROM {source}))"""


def distance(centre: list[float]) -> str:
    terms = " + ".join(f"({f} - CAST({x} AS DOUBLE)) * ({f} - CAST({x} AS DOUBLE))" for f, x in zip(FLAGS, centre))
    return f"sqrt({terms})"


NEAREST = (
    "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
)
CLUSTERED = (
    COHORT
    + ", dists AS (SELECT *, "
    + ", ".join(f"{distance(c)} AS d{i}" for i, c in CENTRES.items())
    + f" FROM cohort), clustered AS (SELECT *, {NEAREST} AS cluster_id FROM dists)"
)


def curve(source: str, by: str = "", digits: int | None = 3) -> str:
    """CTEs ``counts`` and ``curve`` over a scored relation; ``by`` ends with a comma when used."""
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    value = f"round(prob_1, {digits})" if digits is not None else "prob_1"
    return f"""counts AS (
  SELECT {by} {value} AS score, CAST(sum(label) AS BIGINT) AS n_pos, count(*) AS n_rows
  FROM {source} GROUP BY ALL),
curve AS (
  SELECT {by} score, n_pos, n_rows,
         CAST(sum(n_pos) OVER (w) AS BIGINT) AS tps, CAST(sum(n_rows - n_pos) OVER (w) AS BIGINT) AS fps
  FROM counts WINDOW w AS ({part} ORDER BY score DESC))"""


def pr(by: str = "") -> str:
    """CTE ``pr`` over ``curve``."""
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    start = f"SELECT DISTINCT {by} CAST(1 AS DOUBLE) AS precision, CAST(0 AS DOUBLE) AS recall FROM curve"
    return f"""pr AS (
  SELECT {by} tps / (tps + fps + CAST(1e-12 AS DOUBLE)) AS precision,
         tps / CAST(nullif(max(tps) OVER ({part}), 0) AS DOUBLE) AS recall FROM curve
  UNION ALL {start})"""


def at_recalls(recalls: list[float], by: str = "") -> str:
    """CTE ``found``: precision at each recall over ``pr``."""
    values = ", ".join(f"(CAST({r} AS DOUBLE))" for r in recalls)
    key = f"{by} wanted"
    return f"""wanted AS (SELECT * FROM (VALUES {values}) AS t(wanted)),
gaps AS (SELECT {by} wanted, precision, recall, abs(recall - wanted) AS gap FROM pr CROSS JOIN wanted),
near AS (SELECT *, min(gap) OVER (PARTITION BY {key}) AS least FROM gaps),
found AS (
  SELECT {by} wanted AS recall, recall AS reached_recall, precision FROM near WHERE abs(gap - least) < 1e-9
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY recall, precision DESC) = 1)"""


def areas(by: str = "") -> str:
    """CTE ``areas`` over an unrounded ``curve``."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""steps AS (
  SELECT *, tps / CAST(tps + fps AS DOUBLE) AS here,
         CASE WHEN tps + fps > n_rows THEN (tps - n_pos) / CAST(tps + fps - n_rows AS DOUBLE)
              ELSE tps / CAST(tps + fps AS DOUBLE) END AS before
  FROM curve),
areas AS (
  SELECT {by} sum((n_rows - n_pos) * (2 * tps - n_pos)) / (2.0 * sum(n_pos) * sum(n_rows - n_pos)) AS area_roc,
         sum(n_pos * (here + before)) / (2.0 * sum(n_pos)) AS area_pr
  FROM steps {group})"""


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
