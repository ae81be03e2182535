"""Tables stored by match group, so that later joins and groupings on the match id move no wide rows.

A table is bucketed by match id and slice. Most groups lie in slice 0 of one bucket. A group that is larger than a bucket's
even share of the rows is hot: its rows are dealt over slices 1, 2, ... by a hash of the row key, so no bucket gets much more
than its share. A table with one row per group meets the stored rows after its hot ids are repeated once per slice; only that
narrow table is shuffled.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.columns import ID_COL, MATCH_COL, require_new_column
from twinfold.session import is_written
from twinfold.sources.sinks import write_results

SLICE_COL = "_group_slice"
HOT_ID, HOT_SLICES = "_hot_id", "_hot_slices"


@dataclass(frozen=True)
class GroupLayout:
    """Buckets and hot groups of tables that are stored alike.

    ``hot`` holds the match id and number of slices of every hot group. There are fewer of them than buckets, as each holds
    more than an even share of the rows; so it may be broadcast. Rows without a match id are a group like any other.
    """

    match_col: str
    row_key: str
    n_buckets: int
    hot: DataFrame
    n_hot: int
    _names: list[str] = field(default_factory=list)

    def place(self, rows: DataFrame) -> DataFrame:
        """Rows with their slice, shuffled to their buckets: the one time that they move."""
        require_new_column(rows, SLICE_COL, HOT_ID, HOT_SLICES)
        own = F.pmod(F.xxhash64(self.row_key), F.col(HOT_SLICES)) + 1
        sliced = (
            rows.join(F.broadcast(self.hot), F.col(self.match_col).eqNullSafe(F.col(HOT_ID)), "left")
            .withColumn(SLICE_COL, F.when(F.col(HOT_SLICES).isNull(), 0).otherwise(own).cast("int"))
            .drop(HOT_ID, HOT_SLICES)
        )
        return sliced.repartition(self.n_buckets, self.match_col, SLICE_COL)

    def by_slice(self, keyed: DataFrame) -> DataFrame:
        """A table keyed by match id, with the rows of hot ids once per slice."""
        slices = F.when(F.col(HOT_SLICES).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col(HOT_SLICES)))
        return (
            keyed.join(F.broadcast(self.hot), F.col(self.match_col) == F.col(HOT_ID), "left")
            .withColumn(SLICE_COL, F.explode(slices))
            .drop(HOT_ID, HOT_SLICES)
        )

    def attach(self, rows: DataFrame, keyed: DataFrame, how: str = "inner") -> DataFrame:
        """Join placed or stored rows with a table keyed by match id. The rows stay where they are."""
        return rows.join(self.by_slice(keyed), [self.match_col, SLICE_COL], how)

    def hot_and_other(self, rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Rows of hot groups, None if no group is hot, and those of all others, whose groups lie in one bucket each."""
        if not self.n_hot:
            return None, rows
        return rows.filter(F.col(SLICE_COL) > 0), rows.filter(F.col(SLICE_COL) == 0)

    def store(self, rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write placed rows below ``path`` in this layout and read them back.

        Each call writes a folder of its own; the note of the last one that ended is what :meth:`reopen` finds.
        """
        spark, folder = rows.sparkSession, f"rows-{uuid.uuid4().hex}"
        name = self._new_name()
        writer = rows.write.format("parquet").option("path", f"{path}/{folder}")
        writer = writer.bucketBy(self.n_buckets, self.match_col, SLICE_COL).sortBy(self.match_col, SLICE_COL)
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
        stored = spark.table(name)
        note = (folder, stored._jdf.schema().toDDL(), list(partition_by))
        note = spark.createDataFrame([note], "folder string, columns string, partition_by array<string>")
        write_results(note, f"{path}/stored", fmt="json", mode="overwrite")
        return stored

    def reopen(self, spark: SparkSession, path: str) -> DataFrame:
        """Rows that :meth:`store` wrote, also in an earlier session."""
        kinds = "folder string, columns string, partition_by array<string>"
        note = spark.read.schema(kinds).json(f"{path}/stored").first()
        name, keys = self._new_name(), f"`{self.match_col}`, `{SLICE_COL}`"
        split = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in note.partition_by)})" if note.partition_by else ""
        spark.sql(
            f"CREATE TABLE {name} ({note.columns}) USING parquet {split} "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.n_buckets} BUCKETS LOCATION '{path}/{note.folder}'"
        )
        if note.partition_by:
            spark.catalog.recoverPartitions(name)
        return spark.table(name)

    def store_once(self, rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """:meth:`store` unless an earlier run has."""
        spark = rows.sparkSession
        if is_written(spark, f"{path}/stored"):
            return self.reopen(spark, path)
        return self.store(rows, path, partition_by)

    def forget(self) -> None:
        """Take the tables out of the session's catalog. Their files stay."""
        while self._names:
            self.hot.sparkSession.sql(f"DROP TABLE IF EXISTS {self._names.pop()}")

    def _new_name(self) -> str:
        self._names.append(f"by_group_{uuid.uuid4().hex}")
        return self._names[-1]


def group_layout(
    rows: DataFrame, path: str, match_col: str = MATCH_COL, row_key: str = ID_COL, n_buckets: int | None = None
) -> GroupLayout:
    """Layout for ``rows`` and tables derived from them, from one count per match id.

    It is kept below ``path``; called again with the same path it is read, not counted. Without ``n_buckets`` the session's
    number of shuffle partitions is taken.
    """
    spark = rows.sparkSession
    if not is_written(spark, f"{path}/buckets"):
        n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        share = max(math.ceil(rows.count() / n), 1)
        sizes = rows.groupBy(F.col(match_col).alias(HOT_ID)).agg(F.count(F.lit(1)).alias("_n"))
        slices: Column = F.ceil(F.col("_n") / share).cast("int")
        hot = sizes.filter(F.col("_n") > share).select(HOT_ID, slices.alias(HOT_SLICES))
        hot.coalesce(1).write.mode("overwrite").parquet(f"{path}/hot")
        write_results(spark.createDataFrame([(n,)], "n int"), f"{path}/buckets", fmt="json", mode="overwrite")
    n = spark.read.schema("n int").json(f"{path}/buckets").first().n
    hot = spark.read.parquet(f"{path}/hot")
    return GroupLayout(match_col, row_key, n, hot, hot.count())
