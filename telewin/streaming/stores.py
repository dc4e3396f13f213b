"""Reading the windowed table a running or stopped query keeps as its state."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from telewin.operators.windows import END, START


def read_store(spark: SparkSession, checkpoint: str, size_ms: int) -> DataFrame:
    """``key``, bounds and ``kept`` of every window the state still holds.

    ``kept`` is what the aggregate would emit: a count, or the winning record.
    It is the first field of the aggregate's state.
    """
    state = spark.read.format("statestore").load(checkpoint)
    kept = state.schema["value"].dataType.names[0]
    start = F.unix_millis(F.col("key.window.start"))
    return state.select(
        F.col("key.key").alias("key"),
        start.alias(START),
        (start + size_ms).alias(END),
        F.col("value").getField(kept).alias("kept"),
    )


def read_counts(spark: SparkSession, checkpoint: str, size_ms: int) -> DataFrame:
    return read_store(spark, checkpoint, size_ms).withColumnRenamed("kept", "n")


def read_maxima(spark: SparkSession, checkpoint: str, size_ms: int) -> DataFrame:
    """Winning records as they arrived, before their paths are marked."""
    return read_store(spark, checkpoint, size_ms).select("key", START, END, "kept.*")
