"""Reading cohort tables and exclusion lists, and bringing tables to one layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.columns import FLAG_SUFFIX, MATCH_COL, RATE_SUFFIX

# The three id naming layouts, as {old name: new name} after dropping columns.
ID_LAYOUTS: dict[str, dict] = {
    "case_copy": {"drop": ["nonipf_patid"], "copy": {"patid": MATCH_COL}, "rename": {}},
    "control_rename": {"drop": [], "copy": {}, "rename": {"patid": MATCH_COL, "nonipf_patid": "patid"}},
    "patient_id": {
        "drop": [],
        "copy": {},
        "rename": {"matched_patient_id": MATCH_COL, "patient_id": "patid"},
    },
    "indexed_patient_id": {
        "drop": ["", "X"],
        "copy": {},
        "rename": {"matched_patient_id": MATCH_COL, "patient_id": "patid"},
    },
}


def normalise_ids(df: DataFrame, layout: str) -> DataFrame:
    """Bring the id columns to ``matched_positive_id`` and ``patid``."""
    if layout not in ID_LAYOUTS:
        raise ValueError(f"unknown id layout {layout!r}; expected one of {sorted(ID_LAYOUTS)}")
    rules = ID_LAYOUTS[layout]
    kept = [c for c in df.columns if c not in rules["drop"]]
    renamed = [F.col(f"`{c}`").alias(rules["rename"].get(c, c)) for c in kept]
    copied = [F.col(src).alias(dst) for src, dst in rules["copy"].items()]
    return df.select(*renamed, *copied)


def read_cohort(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, fmt: str | None = None
) -> DataFrame:
    """Read a cohort table from parquet, or from CSV with a header.

    A declared ``schema`` saves the extra pass that inferring one from CSV takes.
    """
    paths = [path] if isinstance(path, str) else list(path)
    kind = fmt or ("csv" if paths[0].rstrip("/").endswith(".csv") else "parquet")
    if kind != "csv":
        reader = spark.read.format(kind)
        return (reader.schema(schema) if schema else reader).load(paths)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(paths)


def read_part_files(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read all CSV part files of a folder as one table; other files and empty ones are skipped."""
    reader = spark.read.option("header", True).option("pathGlobFilter", "*.csv")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(folder)


def exclusion_names(names: DataFrame, name_col: str | None = None) -> DataFrame:
    """Column names excluded by a list of variable base names: each with its flag and rate suffix."""
    base = F.col(f"`{name_col or names.columns[0]}`")
    both = F.array(F.concat(base, F.lit(FLAG_SUFFIX)), F.concat(base, F.lit(RATE_SUFFIX)))
    return names.select(F.explode(both).alias("excluded"))


def read_exclusion_list(spark: SparkSession, path: str) -> list[str]:
    """Excluded column names from a CSV with a header whose first column holds variable names.

    The list names columns of a schema, so it is no larger than the schema itself.
    """
    names = spark.read.option("header", True).csv(path)
    return [r.excluded for r in exclusion_names(names).collect()]


def align_columns(df: DataFrame, reference: DataFrame | Sequence[str]) -> DataFrame:
    """Select the reference columns in their order."""
    columns = reference.columns if isinstance(reference, DataFrame) else list(reference)
    return df.select([F.col(f"`{c}`") for c in columns])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename several columns at once."""
    return df.withColumnsRenamed(dict(names))
