"""Audit of how five text filters interact when they are applied in any order.

Filters (a text fails one if its condition holds): A under 50 words, B fewer than 65 distinct words in 100, C more than 5
characters in 100 from A-Z, D a symbol of ``#$%&*|``, E the same text as a row with a smaller doc_id.

A document's failures are a mask of five bits. What happens to it at each of the 5 steps of all 120 orders depends on the
mask and its labels alone, so every mask and label pair has one wide integer: a field per order, step and outcome, wide
enough for the number of all rows, so that no sum of rows can carry into the next field. Each task adds the integers of
its rows by part; the sums are added up in two rounds and taken apart at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import pick, slices

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
# fields of one step, in this order
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FIRST_SUMS = 64
PARTS_HELD = 2_000
AUDIT_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in (*OUTCOMES, "shapley"))
_SUM_SCHEMA = "part string, slot int, total binary"


def mask_of(text: str | None) -> int:
    """Bits of the filters A to D that a text fails, A the lowest; null counts as empty."""
    data = (text or "").encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    failed = (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * capitals > 5 * len(text or ""),
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return sum(bit << i for i, bit in enumerate(failed))


def step_outcomes(mask: int, good: bool, toxic: bool, order: str) -> list[tuple[int, ...]]:
    """What :data:`OUTCOMES` count for one document at each step of an order."""
    found, gone = [], False
    for name in order:
        bit = 1 << FILTERS.index(name)
        fails = bool(mask & bit)
        removed = fails and not gone
        redundant = fails and gone
        gone = gone or fails
        found.append((not gone, removed, redundant, mask == bit, removed and good, removed and toxic))
    return [tuple(map(int, row)) for row in found]


@lru_cache(maxsize=4)
def wide_integers(bits: int) -> dict[tuple[int, bool, bool], int]:
    """The integer of every mask and label pair; fields of ``bits``, the first in the lowest bits."""
    packed = {}
    for mask in range(1 << len(FILTERS)):
        for good in (False, True):
            for toxic in (False, True):
                fields = [v for order in ORDERS for row in step_outcomes(mask, good, toxic, order) for v in row]
                packed[mask, good, toxic] = sum(v << (i * bits) for i, v in enumerate(fields))
    return packed


def unpacked(total: int, bits: int) -> list[int]:
    """The fields of a sum, in order."""
    low = (1 << bits) - 1
    data, fields = total, []
    width = len(ORDERS) * len(FILTERS) * len(OUTCOMES)
    # halves first, so that long shifts touch each bit a few times only
    stack = [(data, width)]
    while stack:
        value, count = stack.pop()
        if count == 1:
            fields.append(value & low)
            continue
        half = count // 2
        stack.append((value >> (half * bits), count - half))
        stack.append((value & ((1 << (half * bits)) - 1), half))
    return fields


def audit_rows(part: str, total: int, bits: int) -> Iterator[tuple]:
    """The 600 rows of one part from its sum."""
    fields = iter(unpacked(total, bits))
    steps = [(order, i + 1, [next(fields) for _ in OUTCOMES]) for order in ORDERS for i in range(len(FILTERS))]
    shapley = Counter()
    for order, step, counts in steps:
        shapley[order[step - 1]] += counts[1]
    return ((part, order, step, *counts, shapley[order[step - 1]]) for order, step, counts in steps)


def _masked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every row; equal texts have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            masks = [mask_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("digest"), pa.array(masks, pa.int32())],
                ["doc_id", "part", "digest", "mask"],
            )

    known = docs.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return known.mapInArrow(run, "doc_id bigint, part string, digest binary, mask int")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, times``: repeated rows counted together, all five filters judged.

    Nothing is grouped or joined by the text alone but the least id of its rows, one number per task and text, so a text
    that a third of all rows share is no large group anywhere.
    """
    rows = pick(docs, doc_id="doc_id", text="text", part="source")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    keys = ["digest", "doc_id", "part", "mask"]
    once = _masked(rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    first = once.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marked = once.join(first.withColumn("_first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    with_e = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    flags = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    known = marked.select("doc_id", "part", with_e.alias("mask"), "times").join(flags, "doc_id", "left")
    no = F.lit(False)
    return known.select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "times")


def _sums(bits: int):
    """Adds the wide integers of the rows of a task by part; sums go out when many parts are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        integers, slot, held = wide_integers(bits), TaskContext.get().partitionId() % FIRST_SUMS, {}
        for batch in batches:
            counted = Counter()
            for part, mask, good, toxic, times in zip(*(c.to_pylist() for c in batch.columns)):
                counted[part, (mask, good, toxic)] += times
            for (part, outcome), times in counted.items():
                held[part] = held.get(part, 0) + integers[outcome] * times
                if len(held) >= PARTS_HELD:
                    yield _sum_batch(held, slot)
                    held = {}
        if held:
            yield _sum_batch(held, slot)

    return run


def _sum_batch(held: dict[str, int], slot: int) -> pa.RecordBatch:
    totals = [v.to_bytes(-(-v.bit_length() // 8), "little") for v in held.values()]
    arrays = [pa.array(list(held)), pa.array([slot] * len(held), pa.int32()), pa.array(totals, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["part", "slot", "total"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
    """Sums of neighbouring rows of one part and slot."""
    part = slot = None
    total = 0
    for batch in batches:
        for p, s, t in zip(*(c.to_pylist() for c in batch.columns)):
            if part is not None and (p, s) != (part, slot):
                yield part, slot, total
                total = 0
            part, slot = p, s
            total += int.from_bytes(t, "little")
    if part is not None:
        yield part, slot, total


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: 600 rows for
    each value of ``source``, zeros included.

    Null sources are the part ``''``, null texts are empty. A row is a document: repeated rows count each, and none of
    those that share the least id of a text fails E. A null id is not larger than any, so it never fails E and is nobody's
    smaller id. Several label rows of an id: the largest counts; null labels count as 0. An empty table gives no rows.
    Other columns are not read. Counts are exact up to 2**63.
    """
    bits = docs.count().bit_length() + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, slot, total in _merged(batches):
            yield _sum_batch({part: total}, slot)

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, total in _merged(batches):
            columns = list(zip(*audit_rows(part, total, bits)))
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(OUTCOMES) + 1)]
            names = ["part", "filter_order", "step", *OUTCOMES, "shapley"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    sums = failure_counts(docs, labels).mapInArrow(_sums(bits), _SUM_SCHEMA)
    by_slot = sums.repartition("part", "slot").sortWithinPartitions("part", "slot").mapInArrow(add_up, _SUM_SCHEMA)
    whole = by_slot.select("part", F.lit(0).alias("slot"), "total").repartition("part").sortWithinPartitions("part")
    return whole.mapInArrow(take_apart, AUDIT_SCHEMA)
