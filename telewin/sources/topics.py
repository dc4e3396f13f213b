"""Topic source: an unbounded keyed stream, or the same topic as a table."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telewin.sources.options import overlay


#: The column that orders records of several source partitions.
ARRIVED = "arrived_ms"


def topic_options(
    brokers: str, topic: str, user_options: Mapping[str, str] | None = None
) -> dict[str, str]:
    """Start at the earliest offset unless a checkpoint already holds a position.

    ``maxOffsetsPerTrigger`` bounds a micro-batch and ``minPartitions`` splits a
    large topic partition over several tasks; both go into ``user_options``.
    """
    return overlay(
        {
            "kafka.bootstrap.servers": brokers,
            "subscribe": topic,
            "startingOffsets": "earliest",
        },
        user_options,
    )


def read_topic(
    spark: SparkSession,
    brokers: str,
    topic: str,
    user_options: Mapping[str, str] | None = None,
    streaming: bool = True,
) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**topic_options(brokers, topic, user_options)).load()


def observations_from(records: DataFrame, key: Column, value: Column) -> DataFrame:
    """Topic rows as observations, given the decoded ``key`` and ``value`` columns.

    ``arrived_ms`` is the time the topic gives a record, where it gives one.
    """
    arrived = [F.unix_millis("timestamp").alias(ARRIVED)] if "timestamp" in records.columns else []
    return records.select(
        key.alias("key"),
        value.alias("value"),
        F.col("partition").alias("part"),
        F.col("offset").alias("off"),
        *arrived,
    )
