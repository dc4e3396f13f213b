"""The update stream of a windowed table: one row per input record.

Row ``i`` of a key and window shows the table's value right after record ``i``
arrived. This is the replay form; a stream emits at most one row per key and
trigger (see ``telewin.streaming``).
"""

from pyspark.sql import DataFrame, Window, functions as F

from telewin.operators.maxima import NAN_RULES, best_of, is_nan, rank, winner
from telewin.operators.scan import (
    ARRIVAL,
    CHUNK,
    CHUNK_OFFSETS,
    earlier_chunks,
    join_carry,
    up_to_here,
    with_chunk,
)
from telewin.operators.windows import END, HALF_MINUTE_MS, MINUTE_MS, START, assign_window

GROUP = ("key", START)
SHOWN = ("key", START, END, "part", "off")


def count_updates(
    obs: DataFrame, size_ms: int = MINUTE_MS, chunk_offsets: int = CHUNK_OFFSETS
) -> DataFrame:
    """Running count per key and window in arrival order."""
    rows = with_chunk(assign_window(obs, size_ms), chunk_offsets).select(*SHOWN, CHUNK)
    totals = rows.groupBy(*GROUP, CHUNK).agg(F.count(F.lit(1)).alias("total"))
    carry = totals.select(
        *GROUP, CHUNK, F.sum("total").over(earlier_chunks(GROUP)).alias("before")
    ).where(F.col("before").isNotNull())
    scanned = rows.withColumn("here", F.count(F.lit(1)).over(up_to_here(GROUP)))
    return join_carry(scanned, carry, GROUP).select(
        *SHOWN,
        (F.col("here") + F.coalesce(F.col("before"), F.lit(0))).alias("n"),
    )


def max_updates(
    obs: DataFrame,
    size_ms: int = HALF_MINUTE_MS,
    nan: str = "replay",
    chunk_offsets: int = CHUNK_OFFSETS,
) -> DataFrame:
    """Running winner per key and window in arrival order.

    ``part`` and ``off`` name the record that caused the update, ``best`` is the
    winning record after it. ``nan`` is one of the rules of ``maxima``.
    """
    if nan not in NAN_RULES:
        raise ValueError(f"nan must be one of {NAN_RULES}, not {nan!r}")
    rows = with_chunk(assign_window(obs, size_ms), chunk_offsets).select(
        *SHOWN, CHUNK, rank().alias("rank"), winner().alias("rec"), is_nan().alias("nan")
    )
    scanned, carry = _plain_scan(rows) if nan == "lowest" else _replay_scan(rows)
    before_wins = F.col("open") & (F.col("rank_before") > F.col("rank_here"))
    best = F.when(before_wins, F.col("rec_before")).otherwise(F.col("rec_here"))
    return join_carry(scanned, carry, GROUP).select(*SHOWN, best.alias("best"))


def _plain_scan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    here, before = up_to_here(GROUP), earlier_chunks(GROUP)
    scanned = rows.select(
        *SHOWN,
        CHUNK,
        F.max_by("rec", "rank").over(here).alias("rec_here"),
        F.max("rank").over(here).alias("rank_here"),
        F.lit(True).alias("open"),
    )
    carry = best_of(rows, (*GROUP, CHUNK)).select(
        *GROUP,
        CHUNK,
        F.max_by("rec", "rank").over(before).alias("rec_before"),
        F.max("rank").over(before).alias("rank_before"),
    )
    return scanned, carry.where(F.col("rank_before").isNotNull())


def _replay_scan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan with the replay rule: a NaN starts a new segment of its chunk.

    Records compete inside their segment. Only a chunk's first segment, which no
    NaN opened, still competes with what came before the chunk.
    """
    segments = rows.withColumn("segment", F.sum(F.col("nan").cast("int")).over(up_to_here(GROUP)))
    here = up_to_here((*GROUP, "segment"))
    scanned = segments.select(
        *SHOWN,
        CHUNK,
        F.max_by("rec", "rank").over(here).alias("rec_here"),
        F.max("rank").over(here).alias("rank_here"),
        (F.col("segment") == 0).alias("open"),
    )
    # What each chunk ends with, and whether it forgot what came before it.
    ends = scanned.groupBy(*GROUP, CHUNK).agg(
        F.max_by("rec_here", F.struct(*ARRIVAL)).alias("rec"),
        F.max_by("rank_here", F.struct(*ARRIVAL)).alias("rank"),
        F.max(~F.col("open")).alias("reset"),
    )
    in_order = Window.partitionBy(*GROUP).orderBy(CHUNK)
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since_reset = Window.partitionBy(*GROUP, "resets").orderBy(CHUNK).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    states = ends.withColumn("resets", F.sum(F.col("reset").cast("int")).over(running)).select(
        *GROUP,
        CHUNK,
        F.max_by("rec", "rank").over(since_reset).alias("rec"),
        F.max("rank").over(since_reset).alias("rank"),
    )
    carry = states.select(
        *GROUP,
        CHUNK,
        F.lag("rec").over(in_order).alias("rec_before"),
        F.lag("rank").over(in_order).alias("rank_before"),
    ).where(F.col("rank_before").isNotNull())
    return scanned, carry
