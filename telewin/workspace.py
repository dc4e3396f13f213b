"""Where intermediate tables and streaming checkpoints go."""

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Staged tables are broadcast up to these rows and bytes on disk; keys may be of any width.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8_000_000


def shared_base(spark: SparkSession) -> str:
    """The shared folder the session names, by setting or by ``setCheckpointDir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors and a restarted driver would not see it.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="telewin-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def job_checkpoint(spark: SparkSession, folder: str | None, name: str) -> str:
    """Where a job keeps its progress: the same place on every start."""
    base = folder or spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        raise ValueError(f"a job needs a checkpoint folder, or {CHECKPOINT_CONF}")
    return f"{base.rstrip('/')}/{name}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


class Staged(NamedTuple):
    """A written table, the number of its rows and its bytes on disk."""

    rows: DataFrame
    count: int
    bytes: int

    def sized(self) -> DataFrame:
        """The table as a join side: broadcast up to the bounds above, else merged."""
        if self.count <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES:
            return F.broadcast(self.rows)
        return self.rows.hint("merge")


def stage(df: DataFrame, path: str | None = None, name: str = "stage") -> Staged:
    """Write ``df`` and read it back.

    Used for small derived tables that several branches of a plan read. The
    files survive lost executors. Counting them reads file footers only.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return Staged(rows, rows.count(), files.getContentSummary(folder).getLength())
