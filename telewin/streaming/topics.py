"""Publishing windowed records to a topic, and reading them back."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from telewin.functions import windowed_key
from telewin.functions.partitioning import key_partition
from telewin.operators.windows import END, START
from telewin.sources.options import overlay
from telewin.sources.payloads import (
    from_json_key,
    from_json_response,
    reading_has_other,
    to_json_key,
    to_json_response,
)
from telewin.streaming.run import writer


def topic_rows(
    windowed: DataFrame,
    topic: str,
    partitions: int | None = None,
    key_bytes: Column | None = None,
    value_bytes: Column | None = None,
) -> DataFrame:
    """``key``, ``value``, ``topic`` (and ``partition``) columns of a topic sink.

    Key and value are JSON unless encoded columns are given. The partition is the one a
    producer gives the inner key, so all windows of a key share it, and share it with
    other records of that key. Without ``partitions`` the producer chooses, by the whole windowed key.
    """
    inner = to_json_key(F.col("key")) if key_bytes is None else key_bytes
    if value_bytes is None:
        open_reading = reading_has_other(windowed.schema)
        value_bytes = to_json_response(F.col("value"), open_reading).cast("binary")
    encoded = windowed.select(inner.alias("inner"), START, value_bytes.alias("value"))
    columns = [
        windowed_key.encode(F.col("inner"), F.col(START)).alias("key"),
        "value",
        F.lit(topic).alias("topic"),
    ]
    if partitions is not None:
        columns.append(key_partition(F.col("inner"), partitions).alias("partition"))
    return encoded.select(*columns)


def read_topic_rows(rows: DataFrame, size_ms: int) -> DataFrame:
    """Decode JSON topic rows; the window's end follows from its size."""
    start = windowed_key.decode_start_ms(F.col("key"))
    return rows.select(
        from_json_key(windowed_key.decode_key(F.col("key"))).alias("key"),
        start.alias(START),
        (start + size_ms).alias(END),
        from_json_response(F.col("value")).alias("value"),
        *[c for c in rows.columns if c not in ("key", "value")],
    )


def publish(
    rows: DataFrame, brokers: str, user_options: Mapping[str, str] | None = None
) -> None:
    """Write a batch of topic rows."""
    options = overlay({"kafka.bootstrap.servers": brokers}, user_options)
    rows.write.format("kafka").options(**options).save()


def to_topic(
    rows: DataFrame,
    brokers: str,
    name: str,
    checkpoint: str,
    user_options: Mapping[str, str] | None = None,
    **run,
) -> StreamingQuery:
    options = overlay({"kafka.bootstrap.servers": brokers}, user_options)
    return writer(rows, name, checkpoint, **run).format("kafka").options(**options).start()
