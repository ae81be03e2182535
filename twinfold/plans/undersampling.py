"""Down-sampling job: three cohort files in, one folder of three smaller files out per ratio."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from twinfold.operators.cohort import undersample_cohort
from twinfold.sources.sinks import run_path, write_results
from twinfold.sources.tables import read_cohort

PARTS = ("pos", "neg", "ss")


def run_undersampling(
    spark: SparkSession,
    paths: Mapping[str, str],
    ratios: Sequence[float],
    out_dir: str,
    neg_ratio: int = 5,
    ss_ratio: int = 10,
    seed: int = 1,
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
) -> dict[float, dict[str, str]]:
    """Read the case, control and scoring files, sample them at every ratio, write the results.

    ``paths`` names the three inputs as ``pos``, ``neg`` and ``ss``. Returns the folders written, by ratio and part.
    """
    tables = [read_cohort(spark, paths[p], schema, fmt) for p in PARTS]
    written: dict[float, dict[str, str]] = {}
    for ratio in ratios:
        folder = run_path(out_dir, {"ratio": ratio})
        written[ratio] = {}
        for part, rows in zip(PARTS, undersample_cohort(*tables, ratio, neg_ratio, ss_ratio, seed)):
            written[ratio][part] = f"{folder}/{part}"
            write_results(rows, written[ratio][part], fmt=fmt)
    return written
