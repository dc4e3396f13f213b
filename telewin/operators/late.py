"""Records that arrive after their window closed.

A record is late when its window's end is at or before the stream time less the
grace. Stream time is the greatest event time seen so far in the record's
source partition, the record itself included.

Most chunks of a log hold no late record, and two numbers per chunk show it:
no window in the chunk ends early enough to be closed by the stream time the
chunk reaches. Only the other chunks are scanned record by record, so a log in
rough time order is checked without being shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F

from telewin.operators.scan import (
    ARRIVAL,
    CHUNK,
    CHUNK_OFFSETS,
    earlier_chunks,
    up_to_here,
    with_chunk,
)
from telewin.operators.windows import END, MINUTE_MS, assign_window, grace_ms
from telewin.workspace import stage

LATE = "late"


def stream_times(obs: DataFrame, part: str = "part") -> DataFrame:
    """The stream time each source partition has reached."""
    return obs.groupBy(part).agg(F.max("ts_ms").alias("reached"))


def closed(end_ms: Column, stream_ms: Column, grace: int) -> Column:
    return end_ms <= stream_ms - grace


def flag_late(
    obs: DataFrame,
    size_ms: int = MINUTE_MS,
    part: str = "part",
    grace: int | None = None,
    chunk_offsets: int = CHUNK_OFFSETS,
    reached: DataFrame | None = None,
    work: str | None = None,
    arrived: str | None = None,
) -> DataFrame:
    """Attach the ``late`` flag to every record.

    ``part`` names the column of the partition whose order counts: the source
    partition, or the partition records were re-keyed into. ``reached`` gives
    the stream time per partition from records before these, if there were any.

    Offsets order the records of one source partition only. Where ``part`` brings
    several together, ``arrived`` names the column to order them by, such as the
    topic's append time in ms; chunks are then cut every ``chunk_offsets`` steps of it.
    """
    if obs.isStreaming:
        raise ValueError("the late rule needs the arrival order of a batch; streams run the ledger")
    grace = grace_ms(size_ms) if grace is None else grace
    rows = with_chunk(obs, chunk_offsets, arrived or "off")
    order = (arrived, "part", "off") if arrived else ARRIVAL
    staged = stage(_suspects(rows, size_ms, part, grace, reached), work, "suspects")
    if not staged.count:
        return obs.withColumn(LATE, F.lit(False))
    suspects = staged.sized()

    on = [part, CHUNK]
    clean = rows.join(suspects, on, "left_anti").withColumn(LATE, F.lit(False))
    here = F.max("ts_ms").over(up_to_here([part], order))
    scanned = (
        assign_window(rows, size_ms)
        .join(suspects, on)
        .withColumn(LATE, closed(F.col(END), F.greatest(here, F.col("before")), grace))
    )
    return scanned.select(clean.columns).unionByName(clean).select(*obs.columns, LATE)


def drop_late(obs: DataFrame, size_ms: int = MINUTE_MS, **rule) -> DataFrame:
    """Only the records whose window was still open when they arrived."""
    return flag_late(obs, size_ms, **rule).where(~F.col(LATE)).drop(LATE)


def _suspects(
    rows: DataFrame, size_ms: int, part: str, grace: int, reached: DataFrame | None
) -> DataFrame:
    """Chunks that may hold a late record, with the stream time ``before`` them."""
    chunks = (
        assign_window(rows, size_ms)
        .groupBy(part, CHUNK)
        .agg(F.max("ts_ms").alias("top"), F.min(END).alias("first_end"))
        .withColumn("before", F.max("top").over(earlier_chunks([part])))
    )
    if reached is not None:
        chunks = (
            chunks.join(reached.select(part, F.col("reached")), part, "left")
            .withColumn("before", F.greatest("before", "reached"))
            .drop("reached")
        )
    return chunks.where(
        closed(F.col("first_end"), F.greatest("top", "before"), grace)
    ).select(part, CHUNK, "before")
