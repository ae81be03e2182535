"""Writing predictions, metrics, manifests and chosen parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "error"
) -> None:
    """Write one table, split by folder (for example fold and cluster) instead of one path per loop step."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table that :func:`write_results` wrote, with the keys of its folders as columns. CSV columns get inferred types."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return reader.load(path)


def run_path(path: str, run: Mapping[str, object]) -> str:
    """Folder of one loop step below a table's folder, such as ``predictions/fold=0/cluster=1``.

    Each step writes its own folder, so steps may run at the same time; reading ``path`` gives the
    run keys back as columns.
    """
    return "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in run.items())])


def write_metrics(metrics: DataFrame, path: str, run: Mapping[str, object] | None = None, fmt: str = "parquet") -> None:
    """Append a metrics table, with the keys of the run (such as fold or cluster) as columns."""
    keyed = metrics.select(*[F.lit(v).alias(k) for k, v in (run or {}).items()], "*")
    write_results(keyed, path, fmt=fmt, mode="append")


def run_manifest(tables: Mapping[str, DataFrame], config: Mapping[str, object] | None = None) -> DataFrame:
    """Row count of every input table and each setting of a run, as ``(entry, name, value)``.

    The counts of all tables come from one query.
    """
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
                F.lit("rows").alias("entry"), F.lit(name).alias("name"), "value"
            )
            for name, df in tables.items()
        ],
    )
    if not config:
        return counts
    spark = counts.sparkSession
    settings = spark.createDataFrame(
        [("setting", str(k), str(v)) for k, v in config.items()], "entry string, name string, value string"
    )
    return counts.unionByName(settings)


def stage_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, cases and match groups of every stage in one grouped query."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("bigint").alias("n_cases"),
    )
