"""Cleaning job: top-coding, id normalisation, column exclusion, for the three cohort tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from twinfold.functions.columns import COUNT_CAPS, drop_excluded, topcode
from twinfold.sources.sinks import write_results
from twinfold.sources.tables import align_columns, normalise_ids, read_cohort, read_exclusion_list

# Fixed value: one more column the cleaning job leaves out.
ALSO_EXCLUDED = ("LVL3_GASTROSC_AVG_RXDX",)


def clean_table(df: DataFrame, layout: str, caps: Mapping[str, float] = COUNT_CAPS) -> DataFrame:
    """Top-code the counts and normalise the ids of one table."""
    return normalise_ids(topcode(df, caps), layout)


def clean_cohort(
    pos: DataFrame,
    neg: DataFrame,
    ss: DataFrame,
    layouts: tuple[str, str, str] = ("patient_id", "patient_id", "patient_id"),
    excluded: Iterable[str] = (),
    caps: Mapping[str, float] = COUNT_CAPS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean the three tables; all get the columns of the cleaned case table."""
    cleaned = [clean_table(df, layout, caps) for df, layout in zip((pos, neg, ss), layouts)]
    cases = drop_excluded(cleaned[0], [*excluded, *ALSO_EXCLUDED])
    return cases, align_columns(cleaned[1], cases), align_columns(cleaned[2], cases)


def run_cleaning(
    spark: SparkSession,
    paths: tuple[str, str, str],
    exclusion_path: str | None,
    out_dir: str,
    layouts: tuple[str, str, str] = ("patient_id", "patient_id", "patient_id"),
    schema=None,
    fmt: str = "csv",
    source_fmt: str | None = None,
) -> None:
    """Read, clean and write the case, control and scoring tables below ``out_dir``.

    ``fmt`` is the format of both ends unless ``source_fmt`` names another one for the inputs.
    """
    tables = [read_cohort(spark, p, schema, source_fmt or fmt) for p in paths]
    excluded = read_exclusion_list(spark, exclusion_path) if exclusion_path else []
    for name, df in zip(("pos", "neg", "ss"), clean_cohort(*tables, layouts, excluded)):
        write_results(df, f"{out_dir.rstrip('/')}/{name}.{fmt}", fmt=fmt)
