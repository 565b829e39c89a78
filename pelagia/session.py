"""Session helpers: checkpoint folder, bounded materialisation, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Row count up to which a side may be broadcast (about 100 B a row: some tens of MB).
BROADCAST_ROWS = 200_000


def local_session(name: str = "pelagia", cpus: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests, bench) a temporary folder is
    used; on a cluster a machine-local folder would be lost with the executor, so
    the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pelagia-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy.

    A written table is computed once, survives lost executors and, unlike a checkpointed
    RDD, has a known size, so later joins can pick a broadcast by themselves.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pelagia-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written = path
    return written


def discard(written: DataFrame) -> None:
    """Remove a table that :func:`cut_lineage` wrote, once nothing that is still to be computed reads it."""
    path = getattr(written, "_written", None)
    if path:
        context = written.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows (reads no further than that)."""
    return df.limit(rows + 1).count() <= rows


def looked_up(table: DataFrame) -> DataFrame:
    """``table`` as the side of a join that rows are looked up in: sent to every task where its counted rows are few, else met by a shuffle.

    Told by hint, as the planner compares estimates only: a measured row counts for no more there than the row it came from, and a
    literal table for the least size of a broadcast, so that it would send the measured rows to the tasks that hold the literals.
    """
    return F.broadcast(table) if at_most(table, BROADCAST_ROWS) else table.hint("merge")
