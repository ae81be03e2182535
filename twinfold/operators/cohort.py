"""Choosing cohort rows: joins on match and row keys, complements, sampling, test-set assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.columns import ID_COL, LABEL_COL, MATCH_COL, hash_fraction
from twinfold.operators.ranking import top_n_per_group
from twinfold.sources.tables import align_columns

# Match ids up to this number are broadcast.
BROADCAST_IDS = 500_000


def require_unique(df: DataFrame, key: str = MATCH_COL) -> None:
    """Raise ``ValueError`` when a key occurs twice."""
    if df.groupBy(key).count().filter(F.col("count") > 1).take(1):
        raise ValueError(f"column {key!r} holds duplicated values")


def rows_of_cases(rows: DataFrame, cases: DataFrame, match_col: str = MATCH_COL) -> DataFrame:
    """Rows matched to the given cases. Each row comes out once, even when a case id repeats."""
    return rows.join(cases.select(match_col), match_col, "left_semi")


def broadcast_ids(cases: DataFrame, match_col: str = MATCH_COL, most: int = BROADCAST_IDS) -> DataFrame | None:
    """Distinct match ids marked for broadcasting, or None when there are more than ``most``."""
    ids = cases.select(match_col).distinct()
    return F.broadcast(ids) if ids.count() <= most else None


def top_rows_of_cases(
    rows: DataFrame,
    cases: DataFrame,
    n: int,
    match_col: str = MATCH_COL,
    order_by: Sequence[str] = (ID_COL,),
    few_ids: DataFrame | None = None,
) -> DataFrame:
    """First ``n`` rows of each of the given cases' match groups.

    The rows of a group never meet in one task: few cases are broadcast, and with many the groups
    are cut to ``n`` rows before the join. Both give the same rows, as a case keeps or drops whole
    groups. ``few_ids`` is the result of :func:`broadcast_ids` when the caller has it already.
    """
    ids = few_ids if few_ids is not None else broadcast_ids(cases, match_col)
    if ids is not None:
        return top_n_per_group(rows.join(ids, match_col, "left_semi"), n, match_col, order_by)
    return _top_rows_before_join(rows, cases, n, match_col, order_by)


def _top_rows_before_join(
    rows: DataFrame, cases: DataFrame, n: int, match_col: str, order_by: Sequence[str]
) -> DataFrame:
    """First ``n`` rows of each group, then the groups of the cases."""
    return rows_of_cases(top_n_per_group(rows, n, match_col, order_by), cases, match_col)


def rows_per_case(rows: DataFrame, cases: DataFrame, match_col: str = MATCH_COL) -> DataFrame:
    """Plain inner join on the match id: a row comes out once per matching case row."""
    return rows.join(cases.select(match_col), match_col)


def rows_by_id(rows: DataFrame, ids: DataFrame, id_col: str = ID_COL) -> DataFrame:
    """Rows whose id is in ``ids``."""
    return rows.join(ids.select(id_col), id_col, "left_semi")


def complement_rows(rows: DataFrame, ids: DataFrame, id_col: str = ID_COL) -> DataFrame:
    """Rows whose id is not in ``ids``. Duplicate rows stay, unlike with EXCEPT."""
    return rows.join(ids.select(id_col), id_col, "left_anti")


def distinct_difference(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows of ``rows`` that are not in ``other`` (EXCEPT DISTINCT)."""
    return rows.subtract(align_columns(other, rows))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, tables)


def only_label(df: DataFrame, value: int = 1, label_col: str = LABEL_COL) -> DataFrame:
    """Rows with one label value."""
    return df.filter(F.col(label_col) == value)


def hash_sample(df: DataFrame, ratio: float, id_col: str = ID_COL, seed: int = 1) -> DataFrame:
    """Bernoulli sample decided by a seeded hash of the id: the same rows on every run and layout."""
    return df.filter(hash_fraction(id_col, seed) < ratio)


def sample_rows(df: DataFrame, ratio: float, id_col: str = ID_COL, seed: int = 1, method: str = "hash") -> DataFrame:
    """Bernoulli sample by id hash, or Spark's own row sample with ``method="bernoulli"``."""
    if method == "hash":
        return hash_sample(df, ratio, id_col, seed)
    if method == "bernoulli":
        return df.sample(False, ratio, seed)
    raise ValueError(f"unknown sampling method {method!r}")


def undersample_cohort(
    pos: DataFrame,
    neg: DataFrame,
    ss: DataFrame,
    ratio: float,
    neg_ratio: int = 5,
    ss_ratio: int = 10,
    seed: int = 1,
    method: str = "hash",
    match_col: str = MATCH_COL,
    id_col: str = ID_COL,
    label_col: str = LABEL_COL,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sample cases, then keep up to ``neg_ratio`` controls and ``ss_ratio`` scoring rows per case.

    Raises ``ValueError`` when the sampled cases repeat a match id.
    """
    cases = sample_rows(pos, ratio, id_col, seed, method)
    order = [label_col, id_col]
    # one pass over the cases tells both whether an id repeats and how many there are
    counted = cases.groupBy(match_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count("n").alias("ids")).first()
    if counted.ids and counted.most > 1:
        raise ValueError(f"column {match_col!r} holds duplicated values")
    if counted.ids <= BROADCAST_IDS:
        ids = F.broadcast(cases.select(match_col))
        controls = top_rows_of_cases(neg, cases, neg_ratio, match_col, order, ids)
        scoring = top_rows_of_cases(ss, cases, ss_ratio, match_col, order, ids)
    else:
        controls = _top_rows_before_join(neg, cases, neg_ratio, match_col, order)
        scoring = _top_rows_before_join(ss, cases, ss_ratio, match_col, order)
    return cases, align_columns(controls, neg), align_columns(scoring, ss)


def assemble_test_set(
    pos: DataFrame,
    neg: DataFrame,
    ss: DataFrame,
    held_out: DataFrame,
    match_col: str = MATCH_COL,
    id_col: str = ID_COL,
    label_col: str = LABEL_COL,
) -> DataFrame:
    """Held-out cases and controls, and the scoring rows matched to the held-out cases."""
    scoring = rows_of_cases(ss, only_label(held_out, 1, label_col), match_col)
    parts = [scoring, rows_by_id(pos, held_out, id_col), rows_by_id(neg, held_out, id_col)]
    return union_all([align_columns(p, pos) for p in parts])
