"""Records per key and tumbling window."""

from pyspark.sql import DataFrame, functions as F

from telewin.functions import record
from telewin.operators.windows import (
    MINUTE_MS,
    START,
    WINDOW,
    time_column,
    window_bounds,
    window_key,
    with_retention,
)

# Names of the two levels counted together.
BY_DEVICE = "ep"
BY_RESOURCE = "ep_path"


def count_by_window(
    obs: DataFrame, size_ms: int = MINUTE_MS, grace: int | None = None
) -> DataFrame:
    """Count per whole key and window.

    Counts are summed up before the shuffle, so a key that holds most of the
    rows costs one shuffled row per task and window.
    """
    narrow = with_retention(obs.select("key", time_column(obs)), size_ms, grace)
    counted = narrow.groupBy(window_key(narrow, size_ms), "key").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select("key", *window_bounds(counted, size_ms), "n")


def count_both_levels(
    obs: DataFrame, size_ms: int = MINUTE_MS, on_bad: str = "null", grace: int | None = None
) -> DataFrame:
    """Counts per key and per key and resource from one read of the source.

    Rows carry the ``level`` they belong to. The finer level groups by the
    formatted name, which is what the re-keyed count groups by.
    """
    key = F.col("key")
    narrow = obs.select(
        time_column(obs),
        key.alias("device"),
        key.withField("ep", record.ep_path(key, F.col("value"), on_bad)).alias("resource"),
    )
    keyed = with_retention(narrow, size_ms, grace).select(
        window_key(obs, size_ms), "device", "resource"
    )
    by = F.col(WINDOW if obs.isStreaming else START)
    counted = keyed.groupingSets(
        [[by, F.col("device")], [by, F.col("resource")]], by, F.col("device"), F.col("resource")
    ).agg(F.grouping("resource").alias("coarse"), F.count(F.lit(1)).alias("n"))
    is_device = F.col("coarse") == 1
    return counted.select(
        F.when(is_device, BY_DEVICE).otherwise(BY_RESOURCE).alias("level"),
        F.when(is_device, F.col("device")).otherwise(F.col("resource")).alias("key"),
        *window_bounds(counted, size_ms),
        "n",
    )
