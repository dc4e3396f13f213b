"""Starting a streaming query: identity, progress, cadence."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

CADENCE = "10 seconds"

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # An extra trigger without data could only forget windows; in update mode it
    # emits nothing, and the next trigger with data forgets them as well.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def use_stream_settings(spark: SparkSession) -> None:
    """Keep window state on local disk with a change log, and trigger only on data.

    Applies to queries started afterwards.
    """
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)


def writer(
    df: DataFrame,
    name: str,
    checkpoint: str,
    mode: str = "update",
    available_now: bool = False,
    cadence: str = CADENCE,
) -> DataStreamWriter:
    """A writer with a stable name and its own checkpoint.

    The checkpoint holds the source position and the state, so a restart goes
    on where the last committed trigger ended.
    """
    out = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True) if available_now else out.trigger(processingTime=cadence)


# Rows of a trigger that are printed; they pass through the driver.
PRINTED = 1000


def to_console(df: DataFrame, name: str, checkpoint: str, printed: int = PRINTED, **run) -> StreamingQuery:
    """Print the updates of each trigger, up to ``printed`` rows."""
    out = writer(df, name, checkpoint, **run).format("console")
    return out.option("truncate", False).option("numRows", printed).start()


def show(rows: DataFrame, printed: int = PRINTED) -> None:
    """Print a batch of updates the way the console sink does."""
    out = rows.write.format("console").option("truncate", False).option("numRows", printed)
    out.mode("append").save()


def finish(query: StreamingQuery, seconds: int = 600) -> None:
    """Wait for an ``availableNow`` query, passing on its failure."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"{query.name} did not finish in {seconds} s")


ForEach = Callable[[DataFrame, int], None]


def to_batches(df: DataFrame, each: ForEach, name: str, checkpoint: str, **run) -> StreamingQuery:
    """Hand every trigger's rows to ``each`` as a batch."""
    return writer(df, name, checkpoint, **run).foreachBatch(each).start()
