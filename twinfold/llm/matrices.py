"""Packed token matrices as files: rows of ids, where their segments end, and positions that restart with each segment.

Documents are cut and placed as :mod:`twinfold.llm.packing` does it (best fit, longest first, a segment tree over room),
but here the ids travel with the pieces and every window is written as one row, padded to its full width. Overlong
documents are split without loss: the pieces of a document, by their start, are its ids again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinfold.llm.packing import WINDOW, dealt, pieces, place

DOCS_PER_GROUP = 10_000
ROWS_PER_BATCH = 256
PAD_ID = 0
MATRIX_SCHEMA = (
    "sequence_id bigint, n_tokens int, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, "
    "ids binary, position_ids binary"
)


def matrix_rows(table: pa.Table, window: int, pad_id: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """One row per window from the placed pieces of a group, whose ids are of ``dtype``."""
    sequences, lengths, offsets = (np.asarray(table.column(c)) for c in ("sequence_id", "length", "offset"))
    begins = np.flatnonzero(np.r_[True, sequences[1:] != sequences[:-1]]) if len(sequences) else np.zeros(0, dtype=np.int64)
    ends = np.r_[begins[1:], len(sequences)]
    place = np.dtype("<u2" if window <= 1 << 16 else "<u4")
    for at in range(0, len(begins), ROWS_PER_BATCH):
        a, b = begins[at : at + ROWS_PER_BATCH], ends[at : at + ROWS_PER_BATCH]
        rows, some = len(a), slice(a[0], b[-1])
        size = lengths[some]
        flat = np.frombuffer(b"".join(table.column("ids").slice(a[0], b[-1] - a[0]).to_pylist()), dtype=dtype)
        row = np.repeat(np.arange(rows), b - a)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        spot = np.repeat(row * window + offsets[some], size) + within
        ids = np.full(rows * window, pad_id, dtype=dtype)
        ids[spot] = flat
        positions = np.zeros(rows * window, dtype=place)
        positions[spot] = within
        bounds = pa.array(np.r_[0, b - a[0]].astype(np.int32))
        of_piece = [pa.ListArray.from_arrays(bounds, table.column(c).slice(a[0], b[-1] - a[0]).combine_chunks()) for c in ("doc_id", "start")]
        last = offsets[b - 1] + lengths[b - 1]
        # per window the offsets of its pieces, then its number of tokens
        cuts = np.insert(offsets[some], b - a[0], last).astype(np.int32)
        cut_bounds = pa.array((np.r_[0, b - a[0]] + np.arange(rows + 1)).astype(np.int32))
        arrays = [
            pa.array(sequences[a]), pa.array(last.astype(np.int32)), *of_piece, pa.ListArray.from_arrays(cut_bounds, pa.array(cuts)),
            _rows_of_bytes(ids, rows), _rows_of_bytes(positions, rows),
        ]
        yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


def _rows_of_bytes(flat: np.ndarray, rows: int) -> pa.Array:
    """The bytes of a flat array as ``rows`` values of equal size."""
    ends = np.arange(rows + 1, dtype=np.int32) * (flat.nbytes // max(1, rows))
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


_ARROW_SCHEMA = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("ids", pa.binary()),
        ("position_ids", pa.binary()),
    ]
)


def token_matrices(
    df: DataFrame, vocabulary: str, window: int = WINDOW, per_group: int = DOCS_PER_GROUP, pad_id: int = PAD_ID,
    dtype: str = "<u2", **columns: str,
) -> DataFrame:
    """One row per window: ids (``dtype``, ``window`` wide), cumulative segment lengths from 0 to the number of tokens,
    positions that restart at 0 with each segment (16 bits; 0 behind the last), and doc_id and start of each segment.

    Null and empty texts are a segment of one end id; repeated rows are repeated segments; null ids stay null; an empty
    table gives no rows. A task holds the ids of one group, about ``per_group`` documents. ``dtype`` must hold every id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            yield from matrix_rows(place(pa.Table.from_batches(rows), window), window, pad_id, dtype)

    found = pieces(df, vocabulary, window, ids_as=dtype, **columns)
    return dealt(found, df, per_group, columns.get("text_col", "text")).mapInArrow(run, MATRIX_SCHEMA)


def write_matrices(df: DataFrame, path: str) -> None:
    """Write the rows of :func:`token_matrices` as Parquet files, one folder for all groups."""
    df.write.option("compression", "zstd").parquet(path)
