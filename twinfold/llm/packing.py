"""Packing documents into windows of a fixed number of tokens by best fit, longest piece first.

A document is its token ids and an end id. Documents of a window or more are first cut into full windows; what is left
of each document is one piece. Pieces are dealt into groups by a hash, as many groups as the rows and their bytes ask for, and
every group is packed by itself: the longest piece first, each into the open window with the least room that still
holds it. A segment tree over the amounts of room finds that window.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import claim_memory, map_slices, pick
from twinfold.llm.tokens import tokenizer

WINDOW = 4096
END_ID = 2
DOCS_PER_GROUP = 50_000
BYTES_PER_DOC = 4096  # a group has no more text than its number of rows with so many bytes each
GROUP_SPAN = 1 << 32
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id bigint, offset bigint"


class RoomTree:
    """Open windows by the room they have left; finds the least room of at least a given amount."""

    def __init__(self, most: int):
        self._leaves = 1 << most.bit_length()
        self._filled = bytearray(2 * self._leaves)
        self._windows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, window: int) -> None:
        self._windows[room].append(window)
        node = room + self._leaves
        while node and not self._filled[node]:
            self._filled[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of ``least`` or more; None if no window has it."""
        filled, node = self._filled, least + self._leaves
        while not filled[node]:
            while node & 1:  # a right child: what lies further right hangs on a node above
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node *= 2
            if not filled[node]:
                node += 1
        room = node - self._leaves
        window = self._windows[room].pop()
        if not self._windows[room]:
            filled[node] = 0
            node >>= 1
            while node and not (filled[2 * node] or filled[2 * node + 1]):
                filled[node] = 0
                node >>= 1
        return room, window


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """Window number and offset of each piece; ``lengths`` fall and none is over ``window``."""
    tree, used, placed = RoomTree(window), 0, []
    for length in lengths:
        found = tree.take(length)
        if found is None:
            room, at = window, used
            used += 1
        else:
            room, at = found
        placed.append((at, window - room))
        if room > length:
            tree.add(room - length, at)
    return placed


def cut(ids: bytes, window: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of one document: full windows, then the rest."""
    total = len(ids) // 4
    return [(at, min(window, total - at)) for at in range(0, total, window)]


def pieces(
    df: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    ids_as: str | None = None,
) -> DataFrame:
    """Pieces of every document: ``doc_id, start, length, ids_crc32, doc_tokens, turn``, with ``ids_as`` (a number type
    that holds every id) also their ``ids``. ``turn`` counts equal pieces of neighbouring rows.

    A null text counts as empty: its only id is the end id. Repeated rows give repeated pieces, null ids are kept, an
    empty table gives none. Only the two named columns are read.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "turn", "ids")}
        seen: Counter = Counter()
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer(vocabulary).encode_all(texts)):
            ids += end
            for start, length in cut(ids, window):
                part = ids[4 * start : 4 * (start + length)]
                check = zlib.crc32(part)
                if ids_as:
                    part = np.frombuffer(part, "<u4").astype(ids_as).tobytes()
                turn = seen[doc_id, start, check]
                seen[doc_id, start, check] += 1
                for column, value in zip(rows.values(), (doc_id, start, length, check, len(ids) // 4, turn, part)):
                    column.append(value)
        arrays = {c: pa.array(v, pa.int64()) for c, v in rows.items() if c != "ids"}
        if ids_as:
            arrays["ids"] = pa.array(rows["ids"], pa.binary())
        return pa.RecordBatch.from_pydict(arrays)

    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_slices(rows, run, PIECE_SCHEMA + ", turn bigint" + (", ids binary" if ids_as else ""), "text")


def dealt(df: DataFrame, docs: DataFrame, per_group: int, text_col: str = "text") -> DataFrame:
    """Pieces dealt into groups, one per partition, of about ``per_group`` documents of ``docs`` and no more than
    ``BYTES_PER_DOC`` times as many bytes of text, by a hash of the whole piece and its turn among equal ones."""
    sizes = pick(docs, text=text_col).agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    groups = max(1, math.ceil(sizes[0] / per_group), math.ceil((sizes[1] or 0) / (per_group * BYTES_PER_DOC)))
    return df.repartition(groups, F.xxhash64("doc_id", "start", "length", "ids_crc32", "turn")).drop("turn")


def place(table: pa.Table, window: int) -> pa.Table:
    """One group's pieces with ``sequence_id`` and ``offset``, in the order of the windows; the same for any row order."""
    keys = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
    table = table.sort_by(keys)
    spots = np.array(best_fit(table.column("length").to_pylist(), window), dtype=np.int64).reshape(-1, 2)
    first = TaskContext.get().partitionId() * GROUP_SPAN if TaskContext.get() else 0
    table = table.append_column("sequence_id", pa.array(first + spots[:, 0]))
    table = table.append_column("offset", pa.array(spots[:, 1]))
    return table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])


def place_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """One group's batches, placed. What the worker remembers of parts goes first: no task that places pieces needs it."""
    claim_memory("packing")
    rows = list(batches)
    if rows:
        yield from place(pa.Table.from_batches(rows), window).to_batches()


def pack(df: DataFrame, vocabulary: str, window: int = WINDOW, per_group: int = DOCS_PER_GROUP, **columns: str) -> DataFrame:
    """All pieces of all documents with the sequence they are in and their offset there.

    Sequence ids are unique: group number times 2**32 plus the number within the group. Offsets in a sequence are gapless
    from 0. Only five numbers per piece are shuffled, never ids or texts.
    """

    found = pieces(df, vocabulary, window, **columns)
    groups = dealt(found, df, per_group, columns.get("text_col", "text"))
    return groups.mapInArrow(lambda batches: place_batches(batches, window), PLACED_SCHEMA)
