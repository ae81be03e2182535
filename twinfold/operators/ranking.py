"""Ranking without a single-task window: top rows per group, global index, k-th key, running totals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions.columns import ID_COL, MATCH_COL, hash_key, require_new_column, round_half_up
from twinfold.session import materialise

# A window filter of at most this many rows per group is applied by Spark before the shuffle
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
PRE_SHUFFLE_LIMIT = 1000
# A range of at most this many (key) rows may be sorted by one task.
ONE_TASK_ROWS = 200_000


def top_n_per_group(
    df: DataFrame, n: int, group_col: str = MATCH_COL, order_by: Sequence[str] = (ID_COL,), salts: int = 64
) -> DataFrame:
    """First ``n`` rows of every group by ``order_by`` (ties must be settled by the last column).

    For a small ``n`` Spark keeps at most ``n`` rows per group in every map task before the shuffle,
    so a very large group costs no more than the others. A larger ``n`` takes the same first cut
    over hashed slices of each group.
    """
    rank = "_rank"
    require_new_column(df, rank, "_slice")
    order = [F.col(c) for c in order_by]
    if n > PRE_SHUFFLE_LIMIT:
        in_slice = Window.partitionBy(group_col, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.pmod(F.xxhash64(*order_by), F.lit(salts)))
            .withColumn(rank, F.row_number().over(in_slice))
            .filter(F.col(rank) <= n)
            .drop(rank, "_slice")
        )
    in_group = Window.partitionBy(group_col).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(in_group)).filter(F.col(rank) <= n).drop(rank)


def hash_rank(ids: DataFrame, id_col: str, seed: int, rank_col: str = "rank", prefix: int = 3) -> DataFrame:
    """Zero-based rank of distinct ids in seeded hash order.

    Equal to a global ``row_number() over (order by hash) - 1``. The first hex digits of the hash
    split the ids into 16**prefix even buckets; only the bucket counts meet in one task.
    """
    require_new_column(ids, rank_col, "_key", "_bucket")
    keyed = ids.withColumn("_key", hash_key(id_col, seed)).withColumn("_bucket", F.substring("_key", 1, prefix))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_key", id_col)
    return (
        keyed.withColumn("_pos", F.row_number().over(inside) - 1)
        # at most 16**prefix rows; a left join adds no NULL filter, so both branches share one shuffle
        .join(F.broadcast(offsets), "_bucket", "left")
        .withColumn(rank_col, F.col("_offset") + F.col("_pos"))
        .drop("_key", "_bucket", "_offset", "_pos")
    )


def with_row_index(
    df: DataFrame, order_by: Sequence[Column | str], index_col: str = "index", row_key: Sequence[str] | None = None
) -> DataFrame:
    """Zero-based global index of the rows in sort order.

    One range-partitioned sort; each row's place inside its partition is stored with it, and the
    partition offsets are a prefix sum over one count per partition.

    ``row_key`` names columns that tell every row apart (NULL is a value; ``ValueError`` when they repeat). Then only
    these and the sort keys are sorted and stored, and the index is joined back to the rows. Without it whole
    rows are sorted and stored.
    """
    require_new_column(df, index_col, "_mid", "_part")
    keys = None if row_key is None else list(row_key)
    rows = df
    if keys is not None:
        order = [F.col(c) if isinstance(c, str) else c for c in order_by]
        rows = df.orderBy(*order).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    else:
        rows = df.orderBy(*order_by)
    # stored with the number, so every use sees the same places even when executors are lost
    placed = materialise(rows.withColumn("_mid", F.monotonically_increasing_id()), "row-index")
    # the id holds the partition number above bit 33 and the row's place in the partition below it
    placed = placed.withColumn("_part", F.shiftright("_mid", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    indexed = (
        placed.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(index_col, F.col("_offset") + place)
        .drop("_mid", "_part", "_offset")
    )
    if keys is None:
        return indexed
    stored = [f"_k{i}" for i in range(len(keys))]
    if not placed.groupBy(*stored).count().filter("count > 1").isEmpty():
        raise ValueError(f"columns {keys} do not tell the rows apart")
    same = reduce(and_, [df[c].eqNullSafe(indexed[k]) for c, k in zip(keys, stored)])
    return df.join(indexed, same, "left").drop(*stored)


def _below(keys: Sequence[str], bound: Sequence, or_equal: bool) -> Column:
    """Whether the keys come before ``bound`` (or equal it): NULL after everything, NaN after all numbers. Never NULL."""
    result = F.lit(or_equal)
    for name, value in reversed(list(zip(keys, bound))):
        c = F.col(name)
        if value is None:
            before, same = c.isNotNull(), c.isNull()
        else:
            before, same = F.coalesce(c < F.lit(value), F.lit(False)), c.eqNullSafe(F.lit(value))
        result = before | (same & result)
    return result


@dataclass
class _Search:
    """One wanted rank: the rows that may still hold it, their number, and how many come before them."""

    keys: list[str]
    k: int
    n: int
    below: int = 0
    inside: Column | None = None
    halve: bool = False
    found: tuple | None = None

    def bounds(self, sample: Sequence[tuple]) -> list[tuple]:
        """Sampled keys around the wanted place; the middle one when the last bounds cut off little."""
        at = (self.k - self.below) / self.n * len(sample)
        margin = 3 * math.sqrt(len(sample)) + 1
        places = sorted({int(at - margin), int(at + margin)} & set(range(len(sample))))
        if self.halve or not places:
            places = [(len(sample) - 1) // 2]
        return [tuple(sample[i]) for i in places]

    def narrow(self, bounds: list[tuple], flags: list[Column], counts: Sequence[int]) -> None:
        """Keep the step between two bounds that holds the answer; a step of rows equal to a bound is the answer."""
        edges = [0, *counts, self.n]
        step = next(i for i in range(len(edges) - 1) if edges[i] < self.k - self.below <= edges[i + 1])
        if step % 2:
            self.found = bounds[step // 2]
            return
        if step > 0:
            self.inside = self.inside & ~flags[step - 1]
        if step < len(flags):
            self.inside = self.inside & flags[step]
        left = edges[step + 1] - edges[step]
        self.halve = left > self.n // 2
        self.below, self.n = self.below + edges[step], left


def _tagged_keys(rows: DataFrame, picks: Sequence[tuple[list[str], Column]]) -> DataFrame:
    """``(tag, k0, k1, ...)``: the keys of every row, once for each pick whose condition holds for it."""
    options = [
        F.when(chosen, F.struct(F.lit(tag).alias("tag"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]))
        for tag, (keys, chosen) in enumerate(picks)
    ]
    return rows.select(F.array_compact(F.array(*options)).alias("_picked")).select(F.inline("_picked"))


def kth_keys(
    df: DataFrame,
    wanted: Sequence[tuple[Sequence[str], int]],
    n_rows: int | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
    seed: int = 1,
) -> list[tuple]:
    """Exact ``k``-th smallest (1-based) key tuple of each ``(keys, k)``, all found in the same passes.

    The ranks may be of one list of keys or of several of equal types, such as distances to different centres. NaN
    comes after all numbers and NULL last; keys may repeat.

    The range that holds an answer is narrowed with sampled bounds and exact counts until it is small enough to sort in
    one task, or one of the bounds is found to be the answer. Every round samples for all ranks in one pass and counts
    for all in another, so the number of passes does not grow with the number of ranks. Only counts and a few sampled
    keys reach the driver, and no full row is shuffled. The results depend neither on the sample nor on the size at
    which narrowing begins.
    """
    searches = [_Search(list(keys), k, 0, inside=F.lit(True)) for keys, k in wanted]
    if not searches:
        return []
    rows = df.select(*dict.fromkeys(c for s in searches for c in s.keys))
    if len({tuple(rows.schema[c].dataType for c in s.keys) for s in searches}) > 1:
        raise ValueError("all keys must have the same types")
    order = [F.asc_nulls_last(f"k{i}") for i in range(len(searches[0].keys))]
    n = rows.count() if n_rows is None else n_rows
    for s in searches:
        s.n = n
        if not 1 <= s.k <= n:
            raise ValueError(f"k must be between 1 and the {n} rows, not {s.k}")
    sample_size = 4000
    while wide := [s for s in searches if s.found is None and s.n > one_task_rows]:
        picks = [(s.keys, s.inside & (F.rand(seed + i) < min(1.0, sample_size / s.n))) for i, s in enumerate(wide)]
        seed += len(wide)
        samples: dict[int, list[tuple]] = {}
        for row in _tagged_keys(rows, picks).repartition(1).sortWithinPartitions("tag", *order).collect():
            samples.setdefault(row[0], []).append(tuple(row)[1:])
        tried = [(wide[tag], wide[tag].bounds(sample)) for tag, sample in samples.items()]
        flags = [[_below(s.keys, b, or_equal) for b in bounds for or_equal in (False, True)] for s, bounds in tried]
        if not tried:
            continue
        near = rows.filter(reduce(or_, [s.inside for s, _ in tried]))
        counts = iter(near.agg(*[F.count_if(s.inside & f) for (s, _), fs in zip(tried, flags) for f in fs]).first())
        for (s, bounds), fs in zip(tried, flags):
            s.narrow(bounds, fs, [next(counts) for _ in fs])
    left = [s for s in searches if s.found is None]
    if left:
        near = rows.filter(reduce(or_, [s.inside for s in left]))
        place = F.row_number().over(Window.partitionBy("tag").orderBy(*order))
        at = F.element_at(F.array(*[F.lit(s.k - s.below).cast("bigint") for s in left]), F.col("tag") + 1)
        found = _tagged_keys(near, [(s.keys, s.inside) for s in left]).withColumn("_place", place).filter(F.col("_place") == at)
        for row in found.drop("_place").collect():
            left[row[0]].found = tuple(row)[1:]
    return [s.found for s in searches]


def kth_key(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    n_rows: int | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
    seed: int = 1,
) -> tuple:
    """Exact ``k``-th smallest (1-based) key tuple, as :func:`kth_keys` finds it."""
    return kth_keys(df, [(keys, k)], n_rows, one_task_rows, seed)[0]


def smallest_fractions(
    df: DataFrame, wanted: Sequence[tuple[Sequence[str], float]], n_rows: int | None = None
) -> list[Column]:
    """For each ``(keys, fraction)`` the condition of :func:`smallest_fraction`, all found in the same passes."""
    n = df.count() if n_rows is None else n_rows
    ranks = [round_half_up(n * fraction) for _, fraction in wanted]
    inner = [(list(keys), k) for (keys, _), k in zip(wanted, ranks) if 0 < k < n]
    cuts = iter(kth_keys(df, inner, n))
    return [_below(list(keys), next(cuts), True) if 0 < k < n else F.lit(k > 0) for (keys, _), k in zip(wanted, ranks)]


def smallest_fraction(df: DataFrame, keys: Sequence[str], fraction: float, n_rows: int | None = None) -> Column:
    """Condition that holds for the ``round(rows * fraction)`` rows with the smallest keys; never NULL.

    NULL keys come last. Rows with equal keys stay together: where keys repeat across the border, all
    rows of the border key are in.
    """
    return smallest_fractions(df, [(keys, fraction)], n_rows)[0]


def quantile_bounds(
    df: DataFrame, column: str | Column, buckets: int = 256, one_task_rows: int = ONE_TASK_ROWS
) -> list[float]:
    """Ascending, distinct bucket bounds of a numeric column, without NaN.

    Their number grows with the table, from ``buckets`` to 16 times as many, so that a bucket stays a
    task's work. Empty when the table is small enough to need no buckets. No shuffle.
    """
    n = df.count()
    if n <= one_task_rows:
        return []
    buckets = min(16 * buckets, max(buckets, 4 * n // max(1, one_task_rows)))
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, shares, 10 * buckets)).first()[0]
    return sorted({x for x in found or [] if not math.isnan(x)})


def running_totals(
    df: DataFrame,
    order_col: str,
    sums: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = True,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Inclusive running sums over distinct ``order_col`` values, ``{column: name of its total}``.

    With ``bounds`` the values are cut into buckets: totals run inside each bucket and start at the
    prefix sum of the buckets before it. Without them each ``by`` group is one window; use that for
    a bounded number of values per group, such as rounded scores.
    """
    by = list(by)
    direction = F.desc if descending else F.asc
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not bounds:
        window = Window.partitionBy(*by).orderBy(direction(order_col)).rowsBetween(*upto)
        return df.select("*", *[F.sum(c).over(window).alias(name) for c, name in sums.items()])
    bucketizer = Bucketizer(
        splits=[-math.inf, *bounds, math.inf], inputCol=order_col, outputCol="_bucket", handleInvalid="keep"
    )
    bucketed = bucketizer.transform(df)
    before = Window.partitionBy(*[F.col(c) for c in by]).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_bucket"]
    offsets = (
        bucketed.groupBy(*keys)
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        )
    )
    inside = Window.partitionBy(*keys).orderBy(direction(order_col)).rowsBetween(*upto)
    # null-safe keys: a NULL group finds its offsets, and no NULL filter keeps the branches from sharing a shuffle
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    totals = [(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(name) for c, name in sums.items()]
    return (
        bucketed.select("*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in sums])
        .join(offsets, same, "left")
        .select(*df.columns, *totals)
    )


def exact_percentile(df: DataFrame, column: str, share: float, one_task_rows: int = ONE_TASK_ROWS) -> float | None:
    """Percentile with linear interpolation between the two neighbouring order statistics.

    A column with few enough rows uses Spark's own ``percentile``, which keeps every distinct value
    in one buffer. Larger ones find the two neighbours by narrowing.
    """
    values = df.select(F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n = values.count()
    if n == 0:
        return None
    if n <= one_task_rows:
        return values.agg(F.percentile("_v", share)).first()[0]
    at = (n - 1) * share
    low = math.floor(at)
    places = [low + 1] if at == low else [low + 1, low + 2]
    near = [key[0] for key in kth_keys(values, [(["_v"], place) for place in places], n, one_task_rows)]
    return near[0] + (near[-1] - near[0]) * (at - low)
