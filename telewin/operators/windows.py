"""Tumbling event-time windows, aligned to the epoch and half open."""

from pyspark.sql import Column, DataFrame, functions as F

MINUTE_MS = 60_000
HALF_MINUTE_MS = 30_000
# A window's state lives this long from the window's start.
RETENTION_MS = 24 * 60 * MINUTE_MS

WINDOW = "window"
START = "window_start_ms"
END = "window_end_ms"


def start_ms(time_ms: Column, size_ms: int) -> Column:
    return time_ms - F.pmod(time_ms, F.lit(size_ms))


def assign_window(obs: DataFrame, size_ms: int) -> DataFrame:
    """Attach the bounds of the window each record falls into."""
    start = start_ms(F.col("ts_ms"), size_ms)
    return obs.withColumns({START: start, END: start + size_ms})


def time_column(obs: DataFrame) -> str:
    """The column ``window_key`` reads: a stream's watermark needs a timestamp."""
    return "event_time" if obs.isStreaming else "ts_ms"


def window_key(obs: DataFrame, size_ms: int) -> Column:
    """The window as a grouping column.

    A stream groups by Spark's window column, which the watermark knows; a batch
    groups by the start alone, a cheaper key to hash and to shuffle.
    """
    if obs.isStreaming:
        return F.window(time_column(obs), f"{size_ms} milliseconds").alias(WINDOW)
    return start_ms(F.col(time_column(obs)), size_ms).alias(START)


def window_bounds(grouped: DataFrame, size_ms: int) -> list[Column]:
    """Start and end in epoch milliseconds of rows grouped by ``window_key``."""
    start = F.unix_millis(f"{WINDOW}.start") if WINDOW in grouped.columns else F.col(START)
    return [start.alias(START), (start + size_ms).alias(END)]


def grace_ms(size_ms: int) -> int:
    """How long after its end a window still takes records."""
    return RETENTION_MS - size_ms


def with_retention(obs: DataFrame, size_ms: int, grace: int | None = None) -> DataFrame:
    """Let a stream forget windows whose grace has passed; a batch is returned as it is."""
    delay = grace_ms(size_ms) if grace is None else grace
    return obs.withWatermark("event_time", f"{delay} milliseconds") if obs.isStreaming else obs
