"""Removing lines that many documents repeat, with counts of line keys in levelled sorted runs.

A run is a table of line keys with the number of rows that hold the key and the largest doc_id among them, bucketed and
sorted by key in the shared folder. Documents come in batches. Each new batch is merge-anti-joined with the runs, which
takes out what a run has decided already (a key found in enough documents, with a larger id to keep it), and the rest is
added as a run of its own. Whenever a level holds two runs, a merge join compacts them into one of the next level, so
there are never more than about log2(batches) runs. All these joins read buckets in step: only a batch's own keys are
shuffled, and only once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.common import GAP_CHARS, pick, slices
from twinfold.session import scratch_path

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 8
BROADCAST_KEYS = 1_000_000
SALTS = 16
RESULT_SCHEMA = "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"


def line_key(line: str, least_chars: int = LEAST_CHARS) -> int | None:
    """Signed 64-bit hash of a line without white space at its ends and with A-Z lower-cased; None for short lines."""
    key = line.strip(GAP_CHARS)
    if len(key) < least_chars:
        return None
    return xxhash.xxh3_64_intdigest(key.encode().lower()) - (1 << 63)


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``key, doc_id, digest``: each key once per row of ``doc_id, digest, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text")))
            found = [(k, i, d) for i, d, t in rows for k in {line_key(x, least_chars) for x in (t or "").split("\n")} if k is not None]
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "doc_id", "digest"])

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "key bigint, doc_id bigint, digest bigint")


class LineRuns:
    """Levelled runs of ``key, n, last``: rows that hold the key and the largest doc_id among them.

    A key with ``n >= least_docs`` is decided: its count is no longer kept up, only larger ids still come in. Batches may
    come in any order; from large ids to small ones the runs decide most.
    """

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, buckets: int | None = None):
        self._spark, self._least = spark, least_docs
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.write.bucketBy(self._buckets, "key").sortBy("key").format("parquet")
        writer.option("path", scratch_path(self._spark, "line-run")).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        """Table names of all runs, newest level first."""
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``key, doc_id``, one row per row and key that it holds."""
        own = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        for name in self.runs():
            known = self._spark.table(name).filter(F.col("n") >= self._least)
            known = known.select(F.col("key").alias("known"), F.col("last").alias("known_last")).hint("merge")
            own = own.join(known, (F.col("key") == F.col("known")) & (F.col("last") <= F.col("known_last")), "left_anti")
        self._push(self._write(own), 0)

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            older, newer = self.levels[level]
            self.levels[level] = []
            self._push(self._merge(older, newer), level + 1)

    def _merge(self, left: str, right: str) -> str:
        """One run of two. Both are read bucket by bucket in the order of their keys."""
        a = self._spark.table(left)
        b = self._spark.table(right).select(F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"))
        both = a.join(b.hint("merge"), F.col("key") == F.col("key_b"), "full_outer")
        zero = F.lit(0)
        merged = self._write(
            both.select(
                F.coalesce("key", "key_b").alias("key"),
                (F.coalesce("n", zero) + F.coalesce("n_b", zero)).alias("n"),
                F.greatest("last", "last_b").alias("last"),
            )
        )
        for name in (left, right):  # the entry in the catalog; the files stay in the shared folder
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")
        return merged

    def decided(self) -> DataFrame:
        """``key, last`` of all keys found in ``least_docs`` rows or more. Compacts all runs into one."""
        names = self.runs()
        while len(names) > 1:
            names = [self._merge(names[0], names[1]), *names[2:]]
        self.levels = [names]
        run = self._spark.table(names[0])
        return run.filter(F.col("n") >= self._least).select("key", "last")


def repeated_lines(lines: DataFrame, decided: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``lines`` whose key is decided and kept by a larger id.

    Keys counted to be few are broadcast. Else the join shuffles, and as one key may be in a third of all rows, lines are
    spread over ``SALTS`` copies of the keys.
    """
    if decided.count() <= broadcast_keys:
        found = lines.join(F.broadcast(decided), "key")
    else:
        salted = lines.withColumn("_salt", F.pmod("doc_id", F.lit(SALTS)))
        copies = decided.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        found = salted.join(copies, ["key", "_salt"])
    return found.filter("doc_id < last").select(*lines.columns)


def _without(rows: DataFrame, least_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, totals, dropped, texts = batch.column("doc_id"), [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist()):
                lines = (text or "").split("\n")
                totals.append(len(lines))
                if keys:
                    gone = set(keys)
                    lines = [x for x in lines if line_key(x, least_chars) not in gone]
                dropped.append(totals[-1] - len(lines))
                texts.append("\n".join(lines) if keys else text or "")
            arrays = [ids, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.select("doc_id", "text", "keys").mapInArrow(run, RESULT_SCHEMA)


def batch_cuts(docs: DataFrame, batches: int) -> list[int]:
    """Rising ids that deal ``docs`` into about equal ranges; they decide which rows come together, no result."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None
    return sorted(set(found or []))


def drop_repeated_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
    batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    r"""``doc_id, n_lines, n_dropped, kept`` of every row.

    Lines end at ``\n``. A key of ``least_chars`` code points or more that ``least_docs`` rows hold loses all its lines but
    those of the largest id that holds it. A null text is one empty line. A row is a document: repeated rows count each,
    and all rows of the largest id keep their lines. Rows with a null id count nowhere and keep all their lines. Other
    columns are not read; an empty table gives none. Keys are compared by 64-bit hashes: among 10**12 different lines one
    meets a repeated one's hash by chance with a probability of about 10**-7.
    """
    spark = df.sparkSession
    docs = pick(df, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    known = docs.filter("doc_id is not null")
    cuts = batch_cuts(known, batches)
    batch = sum(((F.col("doc_id") >= cut).cast("int") for cut in cuts), F.lit(0))
    path = scratch_path(spark, "lines")
    line_keys(known, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("key bigint, doc_id bigint, digest bigint, batch int").parquet(path)
    runs = LineRuns(spark, least_docs)
    for i in range(len(cuts), -1, -1):  # large ids first: what they decide, the smaller ids need not add
        runs.add(lines.filter(F.col("batch") == i).select("key", "doc_id"))
    gone = repeated_lines(lines.select("key", "doc_id", "digest"), runs.decided(), broadcast_keys)
    lists = gone.groupBy("doc_id", "digest").agg(F.collect_set("key").alias("keys"))
    return _without(docs.join(lists, ["doc_id", "digest"], "left"), least_chars)
