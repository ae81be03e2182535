"""Logistic models on different parts of one table, fitted together: every step is one pass over the rows for all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.fits import FittedLinear
from twinfold.session import scratch_path

# Sums of products of two columns are kept for every model; wider tables are fitted one by one.
MOST_COLUMNS = 64
# Rows are stored in blocks of this size, and these in row groups that a task can hold.
BLOCK_BYTES, ROW_GROUP_BYTES = 128 << 10, 16 << 20
STEP_TOLERANCE, LOSS_TOLERANCE = 1e-8, 1e-11


@dataclass(frozen=True)
class WantedFit:
    """Penalty and mix of one model, and the fold whose rows it does not train on (None: it trains on all)."""

    reg: float = 0.0
    alpha: float = 0.0
    left_out: int | None = None


def fit_together(
    df: DataFrame,
    width: int,
    wanted: Sequence[WantedFit],
    fold_col: str | None = None,
    features_col: str = "features",
    label_col: str = "label",
    max_iter: int = 100,
    standardization: bool = True,
) -> list[FittedLinear]:
    """Binary logistic models with intercept, each the optimum that Spark's ``LogisticRegression`` approaches.

    The objective is Spark's: mean log loss plus the elastic-net penalty on standardised columns (on plain ones without
    ``standardization``). Each pass adds up the slopes and curvatures of all models at their current places; the driver gets
    these sums, as many as there are pairs of columns, and takes a proximal Newton step, halved where the loss grew. A model whose training rows
    have one label only gets an infinite intercept.
    """
    if not 0 < width <= MOST_COLUMNS:
        raise ValueError(f"between 1 and {MOST_COLUMNS} columns can be fitted together, not {width}")
    values = vector_to_array(F.col(features_col))
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(-1)
    rows = df.select(F.col(label_col).cast("double").alias("y"), fold.alias("fold"), values.alias("x"))
    rows = _stored_blocks(rows.select("y", "fold", *[F.col("x")[j].alias(f"x{j}") for j in range(width)]))
    left_out = [w.left_out for w in wanted]

    n, positives, centre, spread = _moments(rows, width, left_out)
    if not n.all():
        raise ValueError("a model has no training rows")
    scale = np.where(spread.max(axis=0) > 0, spread.max(axis=0), 1.0)
    weight = spread / scale if standardization else np.broadcast_to(1 / scale, spread.shape)
    reg, alpha = np.array([w.reg for w in wanted]), np.array([w.alpha for w in wanted])
    linear = np.hstack([np.zeros((len(wanted), 1)), (reg * alpha)[:, None] * weight])
    square = np.hstack([np.zeros((len(wanted), 1)), (reg * (1 - alpha))[:, None] * weight**2])
    usable = np.hstack([np.ones((len(wanted), 1), bool), spread > 0])  # the intercept comes first

    place = np.zeros((len(wanted), width + 1))
    one_sided = (positives == 0) | (positives == n)
    with np.errstate(divide="ignore"):
        place[:, 0] = np.log(positives) - np.log(n - positives)
    loss = np.full(len(wanted), np.inf)
    trial, step, length = place.copy(), np.zeros_like(place), np.ones(len(wanted))
    going, passes = np.flatnonzero(~one_sided), 0
    while len(going):
        sums = _slopes(rows, trial[going], centre, scale, [left_out[m] for m in going])
        still = []
        for k, m in enumerate(going):
            at = trial[m]
            now = sums.loss[k] / n[m] + linear[m] @ abs(at) + square[m] @ at**2 / 2
            if now > loss[m] + 1e-13 * abs(loss[m]):  # too far: half the step
                length[m] /= 2
                trial[m] = place[m] + length[m] * step[m]
                if length[m] > 1e-6:
                    still.append(m)
                continue
            gain, loss[m], place[m], length[m] = loss[m] - now, now, at, 1.0
            step[m] = _newton_step(sums.slope[k] / n[m], sums.curvature[k] / n[m], at, linear[m], square[m], usable[m])
            small = abs(step[m]).max() <= STEP_TOLERANCE * max(1.0, abs(at).max())
            if not small and gain > LOSS_TOLERANCE * now and now > LOSS_TOLERANCE:
                trial[m] = at + step[m]
                still.append(m)
        going, passes = np.array(still, int), passes + 1
        if passes > max_iter:
            break
    slopes = np.where(usable[:, 1:], place[:, 1:] / scale, 0.0)
    intercepts = np.where(one_sided, place[:, 0], place[:, 0] - slopes @ centre)
    return [
        FittedLinear(w.reg, w.alpha, tuple(map(float, c)), float(b), features_col)
        for w, c, b in zip(wanted, slopes, intercepts)
    ]


@dataclass(frozen=True)
class _Sums:
    """Sums over the training rows of every model: log loss, its slopes and its curvatures."""

    loss: np.ndarray
    slope: np.ndarray
    curvature: np.ndarray


def _stored_blocks(rows: DataFrame) -> DataFrame:
    """Rows of numbers ``y, fold, x0, ...``, stored as ``n, block``: the bytes of the columns of ``n`` rows.

    Every pass over the blocks then moves bytes to the Python workers, not rows. A null number becomes NaN.
    """
    width = len(rows.columns)
    chunk = max(1, BLOCK_BYTES // (8 * width))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(width)]
            starts = range(0, batch.num_rows, chunk)
            packed = [b"".join(c[at : at + chunk].tobytes() for c in columns) for at in starts]
            sizes = pa.array([min(chunk, batch.num_rows - at) for at in starts], pa.int64())
            yield pa.RecordBatch.from_pydict({"n": sizes, "block": pa.array(packed, pa.binary())})

    blocks, path = rows.mapInArrow(task, "n bigint, block binary"), scratch_path(rows.sparkSession, "fit-rows")
    blocks.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return rows.sparkSession.read.parquet(path)


def _summed(rows: DataFrame, per_chunk, size: int) -> np.ndarray:
    """Sum over all blocks of ``per_chunk(x, y, fold)``, an array of ``size`` numbers; one small row per task reaches the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for n, block in zip(batch.column("n").to_pylist(), batch.column("block")):
                y, fold, *x = np.frombuffer(block.as_buffer()).reshape(-1, n)
                total += per_chunk(np.column_stack(x), y, fold)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    found = np.zeros(size)
    for row in rows.mapInArrow(task, "sums binary").collect():
        found += np.frombuffer(row.sums)
    return found


def _add_up(rows: DataFrame, per_chunk, size: int) -> np.ndarray:
    """:func:`_summed` for one step of the models."""
    return _summed(rows, per_chunk, size)


def _moments(rows: DataFrame, width: int, left_out: Sequence[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and positives of every model, the centre of all rows, and each model's standard deviations."""
    # what a model leaves out is one fold: moments per fold and of all rows are enough
    folds = sorted({f for f in left_out if f is not None})

    def totals(x, y, fold):
        return np.concatenate([[len(y), np.count_nonzero((y != 0) & (y != 1))], x.sum(axis=0)])

    counted = _summed(rows, totals, 2 + width)
    if counted[1]:
        raise ValueError("labels must be 0 or 1")
    centre = counted[2:] / max(counted[0], 1.0)

    def moments(x, y, fold):
        values = np.column_stack([np.ones(len(y)), y, x - centre, (x - centre) ** 2])
        return np.concatenate([values.sum(axis=0), *[values[fold == f].sum(axis=0) for f in folds]])

    sums = _summed(rows, moments, (1 + len(folds)) * (2 + 2 * width)).reshape(1 + len(folds), -1)
    found = {None: sums[0]} | dict(zip(folds, sums[1:]))
    own = np.array([found[None] - (found[f] if f is not None else 0.0) for f in left_out])
    n, s, q = own[:, :1], own[:, 2 : 2 + width], own[:, 2 + width :]
    variance = (q - s**2 / np.maximum(n, 1)) / np.maximum(n - 1, 1)
    noise = 1e-12 * q / np.maximum(n, 1)  # what subtracting leaves of a constant column
    return own[:, 0], own[:, 1], centre, np.sqrt(np.where(variance > noise, variance, 0.0))


def _slopes(rows: DataFrame, place: np.ndarray, centre: np.ndarray, scale: np.ndarray, left_out: Sequence[int | None]) -> _Sums:
    """Loss, slopes and curvatures of all models at their places, from one pass over the rows."""
    n_models, width = place.shape
    left, right = np.triu_indices(width)
    without = np.array([-2 if f is None else f for f in left_out])  # -2 is no fold
    size = n_models * (1 + width + len(left))

    def per_chunk(x, y, fold):
        z = np.hstack([np.ones((len(y), 1)), (x - centre) / scale])
        trains = (fold[:, None] != without[None, :]).astype(float)
        margin = z @ place.T
        small = np.exp(-np.abs(margin))
        prob = np.where(margin >= 0, 1.0, small) / (1 + small)
        loss = np.log1p(small) + np.maximum(margin, 0) - margin * y[:, None]
        slope = ((prob - y[:, None]) * trains).T @ z
        curve = prob * (1 - prob) * trains
        if n_models * width < 2 * len(left):  # a product per model costs less than all pairs of columns
            curve = np.array([((z * c[:, None]).T @ z)[left, right] for c in curve.T])
        else:
            curve = curve.T @ (z[:, left] * z[:, right])
        return np.concatenate([(loss * trains).sum(axis=0), slope.ravel(), curve.ravel()])

    sums = _add_up(rows, per_chunk, size)
    loss, slope, pairs = np.split(sums, [n_models, n_models * (1 + width)])
    curvature = np.zeros((n_models, width, width))
    curvature[:, left, right] = curvature[:, right, left] = pairs.reshape(n_models, -1)
    return _Sums(loss, slope.reshape(n_models, width), curvature)


def _newton_step(slope, curvature, at, linear, square, usable) -> np.ndarray:
    """Step to the least value of the quadratic model of the loss plus the penalty."""
    step, idx = np.zeros(len(at)), np.flatnonzero(usable)
    g, h, here, l1, l2 = slope[idx], curvature[np.ix_(idx, idx)], at[idx], linear[idx], square[idx]
    if not l1.any():
        # columns that depend on each other, as one per cell next to the intercept, leave several least places
        step[idx] = -np.linalg.pinv(h + np.diag(l2), rcond=1e-12, hermitian=True) @ (g + l2 * here)
        return step
    step[idx] = _least_place(h + np.diag(l2), h @ here - g, l1, here) - here
    return step


def _least_place(a, c, l1, start) -> np.ndarray:
    """Least place of ``u a u / 2 - c u + l1 |u|`` by signs: solve for the columns that have one, drop the column that first
    comes to 0 on the way, and else take in the column whose slope is furthest above its penalty."""
    u, sign, free = start.copy(), np.sign(start), l1 == 0
    slack = 1e-12 * max(1.0, abs(c).max())
    for _ in range(20 * len(u)):
        active = free | (sign != 0)
        new = np.zeros(len(u))
        new[active] = np.linalg.pinv(a[np.ix_(active, active)], rcond=1e-12, hermitian=True) @ (c - l1 * sign)[active]
        crossing = np.flatnonzero(active & ~free & (new * sign < 0))
        if len(crossing):
            share = u[crossing] / (u[crossing] - new[crossing])
            u = u + share.min() * (new - u)
            gone = crossing[share == share.min()]
            u[gone] = sign[gone] = 0.0
            continue
        u = new
        pull = c - a @ u
        over = np.where(active, -np.inf, abs(pull) - l1)
        if over.max() <= slack:
            break
        sign[over.argmax()] = np.sign(pull[over.argmax()])
    return u
