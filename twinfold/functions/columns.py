"""Column expressions: everything here stays inside Catalyst, there is no Python UDF."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import add

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identity columns, name suffixes and the four count caps of the cleaning step.
MATCH_COL = "matched_positive_id"
ID_COL = "patid"
LABEL_COL = "label"
FLAG_SUFFIX = "_FLAG"
RATE_SUFFIX = "_AVG_RXDX"
COUNT_CAPS = {"SYMP_CNT": 7, "COMOR_CNT": 5, "NRCOMOR_CNT": 11, "PROC_CNT": 5}


def require_new_column(df: DataFrame, *names: str) -> None:
    """Refuse to overwrite an existing column."""
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"column(s) {taken} already exist in the input data")


def capped(column: str | Column, cap: float) -> Column:
    """Top-coded value. NULL stays NULL; NaN sorts above every number and becomes the cap."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c > cap, F.lit(cap)).otherwise(c)


def topcode(df: DataFrame, caps: Mapping[str, float] = COUNT_CAPS, suffix: str = "2") -> DataFrame:
    """Replace each counted column by its capped version, named ``<column><suffix>``."""
    new = [capped(c, cap).alias(c + suffix) for c, cap in caps.items()]
    require_new_column(df, *(c + suffix for c in caps))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in caps], *new)


def predictor_columns(columns: Iterable[str], exclude: Iterable[str] = ()) -> list[str]:
    """Every column that is neither an id, the label nor excluded."""
    skip = {MATCH_COL, ID_COL, LABEL_COL, *exclude}
    return [c for c in columns if c not in skip]


def flag_columns(columns: Iterable[str], pattern: str = "FLAG") -> list[str]:
    """Columns used for clustering: names that contain ``pattern``."""
    return [c for c in columns if pattern in c]


def drop_excluded(df: DataFrame, excluded: Iterable[str]) -> DataFrame:
    """Keep the columns that are not on the exclusion list, in their order."""
    skip = set(excluded)
    return df.select([F.col(f"`{c}`") for c in df.columns if c not in skip])


def label_as_double(df: DataFrame, label_col: str = LABEL_COL) -> DataFrame:
    """Check that the label is an integer or double column and cast it to double."""
    kind = df.schema[label_col].dataType
    if not isinstance(kind, (T.IntegerType, T.DoubleType)):
        raise TypeError(f"label column {label_col!r} must be integer or double, not {kind.simpleString()}")
    return df.withColumn(label_col, F.col(label_col).cast("double"))


def positive_score(df: DataFrame, column: str) -> Column:
    """Score of the positive class: element 1 of a probability vector or array, or a plain number."""
    return positive_score_of(column, df.schema[column].dataType)


def positive_score_of(column: str, kind: T.DataType) -> Column:
    """Score of the positive class in a column of a known type."""
    if isinstance(kind, VectorUDT):
        return vector_to_array(F.col(column)).getItem(1)
    if isinstance(kind, T.ArrayType):
        return F.col(column).getItem(1).cast("double")
    return F.col(column).cast("double")


def vector_element(column: str | Column, index: int) -> Column:
    """One element of an ML vector as a double."""
    return vector_to_array(F.col(column) if isinstance(column, str) else column).getItem(index)


def quantised(score: Column, digits: int | None = 3) -> Column:
    """Score rounded half up to ``digits`` decimals; unchanged when ``digits`` is None."""
    return score if digits is None else F.round(score, digits)


def log10_score(score: Column) -> Column:
    """log10 of a score. A score of zero or below gives NULL."""
    return F.log10(score)


def euclidean_to(columns: Sequence[str], centre: Sequence[float]) -> Column:
    """Distance of the point made of ``columns`` to a fixed ``centre``.

    Written as a sum over plain columns, so it runs inside whole-stage codegen.
    """
    if len(columns) != len(centre):
        raise ValueError(f"{len(columns)} columns but {len(centre)} centre coordinates")
    terms = [
        (F.col(c).cast("double") - F.lit(float(x))) * (F.col(c).cast("double") - F.lit(float(x)))
        for c, x in zip(columns, centre)
    ]
    return F.sqrt(reduce(add, terms))


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two equally long numeric array columns."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def hash_key(id_col: str | Column, seed: int) -> Column:
    """Hex key that orders ids in a seeded, engine-independent pseudo-random order."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hash_fraction(id_col: str | Column, seed: int) -> Column:
    """Uniform number in [0, 1) derived from the id: the first 32 bits of :func:`hash_key`."""
    return F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def round_half_up(x: float) -> int:
    """Rounding of retained row counts: halves go away from zero."""
    return int(Decimal(repr(float(x))).quantize(Decimal(1), rounding=ROUND_HALF_UP))
