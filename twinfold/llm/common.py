"""Helpers that the operators share: column picking, Arrow mapping, stored tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.session import scratch_path

WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 4 << 20
SCAN_ROWS = 512  # texts that a Parquet scan decodes at once; Spark's 4,096 are many MB of heap in each running task


def quoted(name: str) -> str:
    """Column name that is never read as a path or an expression."""
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under new names; other columns, whatever they are called, are left out."""
    return df.select(*[F.col(quoted(source)).alias(name) for name, source in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use the result several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text: longest runs without ASCII white space. Null text: no words."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about ``SLICE_BYTES`` of ``column``, or a single longer row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * SLICE_BYTES / max(SLICE_BYTES, batch.column(column).nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose batches are bounded by bytes, not only by rows: executor and worker each hold a batch of every
    running task, some of them several times. The scan below it decodes few rows at once. The settings stay with the
    session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    return df.mapInArrow(fn, schema)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str) -> DataFrame:
    """Apply ``fn`` to Arrow slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield fn(part)

    return map_texts(df, run, schema)


_CACHES: dict[str, Callable[[], None]] = {}
_claimed: list[str] = []


def cached_by(owner: str, clear: Callable[[], None]) -> None:
    """Name how a module forgets what its worker process remembers."""
    _CACHES[owner] = clear


def claim_memory(owner: str) -> None:
    """Workers are used again by later stages: whoever begins a task lets the other modules' memories go."""
    for name, clear in _CACHES.items():
        if name != owner:
            clear()
    if _claimed != [owner]:
        if _claimed:
            give_back_memory()
        _claimed[:] = [owner]


def give_back_memory() -> None:
    """Return what this worker process has freed to the system. Workers wait for further tasks while the executor needs it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage; lost executors re-read files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
