"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for matched cohorts: match groups can be very uneven, so a join on the match
# id must be split at run time even when a grouping on the same id follows it, and AQE (not a fixed
# number) decides the final partition counts.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "twinfold", master: str | None = None, **conf: str) -> SparkSession:
    """Session with :data:`SESSION_CONF`; further settings as keyword arguments (``_`` for ``.``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**SESSION_CONF, **{k.replace("_", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SESSION_CONF` to a session that was built elsewhere."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder of the session for ``checkpoint()`` and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``, and it is an error not to: a folder of the driver's
    machine would lose what executors write. A local session, where all run on one machine, gets its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    if active is None:
        if not named and not re.match(r"local(\[[^,]*\])?$", context.master):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="twinfold-"))
        active = context.getCheckpointDir()
    return named or active


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for one intermediate table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/twinfold/{name}-{uuid.uuid4().hex}"


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: later steps plan from a plain scan, and a lost executor re-reads the files.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
