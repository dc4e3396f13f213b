"""Record-level transforms: which rows count, when they happened, how they are keyed."""

from pyspark.sql import Column, DataFrame, functions as F

from telewin.functions import record
from telewin.functions.partitioning import key_partition


def valid_records(obs: DataFrame, on_bad: str = "drop") -> DataFrame:
    """Observations with a key and a non-negative event time, plus ``ts_ms`` and ``event_time``.

    A record without a value is dropped, or fails the query with ``on_bad="fail"``.
    """
    if on_bad not in ("drop", "fail"):
        raise ValueError(f"on_bad must be 'drop' or 'fail', not {on_bad!r}")
    value = F.col("value")
    if on_bad == "drop":
        obs = obs.where(value.isNotNull())
    time = record.timestamp_ms(value, "fail" if on_bad == "fail" else "null")
    return with_event_time(obs, time).where(F.col("key").isNotNull() & (F.col("ts_ms") >= 0))


def with_event_time(obs: DataFrame, time_ms: Column) -> DataFrame:
    """Attach the event time taken from epoch milliseconds in the payload."""
    return obs.withColumn("ts_ms", time_ms).withColumn("event_time", F.timestamp_millis("ts_ms"))


def rekey(obs: DataFrame, ep: Column) -> DataFrame:
    """Replace the device id inside the key; other key fields and the value stay."""
    return obs.withColumn("key", F.col("key").withField("ep", ep))


def rekey_by_resource(obs: DataFrame, on_bad: str = "null") -> DataFrame:
    """Key by ``<device>.<resource path>``."""
    return rekey(obs, record.ep_path(F.col("key"), F.col("value"), on_bad))


def with_rekeyed_partition(obs: DataFrame, partitions: int, key_bytes: Column, name: str = "rpart") -> DataFrame:
    """Attach the partition that re-keyed records land in, given their serialized keys."""
    return obs.withColumn(name, key_partition(key_bytes, partitions))


def mark_max(obs: DataFrame, on_bad: str = "null") -> DataFrame:
    """Rewrite both paths of the value to ``<resource path>-max``."""
    value = F.col("value")
    return obs.withColumn("value", record.with_path(value, record.max_path(value, on_bad)))
