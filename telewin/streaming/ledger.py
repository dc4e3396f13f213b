"""Exact windowed tables on a stream.

Spark's watermark is one per query and moves between triggers, and a streaming
aggregate cannot see arrival order. Where late records and NaN readings must
count exactly as in a replay of the log, each trigger is reduced as a batch
with the replay rules, and the partial results are kept by trigger. Combining
them in trigger order gives the table. The source must deliver each partition
in offset order, as a topic does.

Layout under ``path``, one folder per trigger: ``partials`` and ``reached``, the stream times
after it, from which its successor's late flags start.

Every so many triggers the partials are merged (see ``merged``); windows are over once their grace is,
for the partition that is furthest. So a trigger reads a day of windows and a bounded number of partials,
however long the job has run and even if a partition stands still. A partition that lags or starts
late may bring records for closed windows: those rows are found by the marks and combined like any.
"""

from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from telewin.operators.compaction import BATCH
from telewin.operators.counts import count_by_window
from telewin.operators.late import closed, drop_late, stream_times
from telewin.operators.maxima import fold_by_window
from telewin.operators.scan import CHUNK_OFFSETS
from telewin.operators.updates import count_updates, max_updates
from telewin.operators.windows import END, START, grace_ms, window_bounds
from telewin.streaming import merged
from telewin.streaming.merged import Layout, Range, batch_path, batches_in, read_batches, remove
from telewin.streaming.run import to_batches
from telewin.streaming.tables import write_batch
from telewin.workspace import stage

GROUP: Sequence[str] = ("key", START)
LAYOUT = Layout("partials", "base", "closed", "merged")
#: Triggers between merges: an hour at the usual cadence.
MERGE_EVERY = 360

#: Offsets of earlier winners are shifted down by this, below those of any record.
EARLIER = 1 << 62

Emit = Callable[[DataFrame, int], None]


class Kind(NamedTuple):
    """What is kept per key and window.

    ``reduce`` makes the rows of a trigger, ``combine`` brings rows of several triggers together (both
    as ``key``, window start and more), and ``shown`` is what the table shows of them. ``steps`` is
    what it shows after each record of a trigger, given the combined rows of the windows before it.
    """

    reduce: Callable[[DataFrame, str, int], DataFrame]
    combine: Callable[[DataFrame], DataFrame]
    shown: Callable[[DataFrame, int], DataFrame]
    steps: Callable[[DataFrame, DataFrame | None, int], DataFrame]


def _count(obs: DataFrame, work: str, size_ms: int) -> DataFrame:
    return count_by_window(obs, size_ms).select(*GROUP, "n")


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("n").alias("n"))


def _fold(obs: DataFrame, work: str, size_ms: int) -> DataFrame:
    return fold_by_window(obs, size_ms, work=f"{work}/resets")


def _last_folds(rows: DataFrame) -> DataFrame:
    """Only the triggers' winners from the last reset on compete."""
    last = F.max(F.when(F.col("reset"), F.col(BATCH))).over(Window.partitionBy(*GROUP))
    rows = rows.withColumn("last_reset", last)
    return (
        rows.where(F.col("last_reset").isNull() | (F.col(BATCH) >= F.col("last_reset")))
        .groupBy(*GROUP)
        .agg(
            F.max_by("rec", "rank").alias("rec"),
            F.max("rank").alias("rank"),
            F.max("reset").alias("reset"),
        )
    )


def _count_steps(obs: DataFrame, before: DataFrame | None, size_ms: int) -> DataFrame:
    steps = count_updates(obs, size_ms)
    if before is None:
        return steps
    joined = steps.join(before.withColumnRenamed("n", "earlier"), [*GROUP], "left")
    n = F.col("n") + F.coalesce(F.col("earlier"), F.lit(0))
    return joined.select(*[c for c in steps.columns if c != "n"], n.alias("n"))


def _fold_steps(obs: DataFrame, before: DataFrame | None, size_ms: int) -> DataFrame:
    """A window's winner so far competes as a record that arrived before all others."""
    rows = obs.select("key", "value", "part", "off", "ts_ms")
    if before is not None:
        rec = F.col("rec")
        earlier = (rec.getField("off") - EARLIER).alias("off")
        rows = rows.unionByName(
            before.select("key", rec.getField("value").alias("value"), rec.getField("part").alias("part"), earlier, F.col(START).alias("ts_ms"))
        )
    steps = max_updates(rows, size_ms).where(F.col("off") >= 0)
    best = F.col("best.off")
    return steps.select(
        "key", START, END, "part", "off", F.col("best.value").alias("value"),
        F.when(best < 0, best + EARLIER).otherwise(best).alias("best_off"),
    )


COUNTS = Kind(
    _count,
    _sum,
    lambda rows, size_ms: rows.select("key", *window_bounds(rows, size_ms), "n"),
    _count_steps,
)
MAXIMA = Kind(
    _fold,
    _last_folds,
    lambda rows, size_ms: rows.select("key", *window_bounds(rows, size_ms), "rec.*"),
    _fold_steps,
)


def read_rows(spark: SparkSession, path: str, wanted: Range | None = None) -> DataFrame:
    """The kept rows of all triggers, each with the trigger it counts from; see ``merged.read_rows``."""
    rows = merged.read_rows(spark, path, LAYOUT, wanted)
    if rows is None:
        raise ValueError(f"no trigger has written to {path} yet")
    return rows


def read_table(spark: SparkSession, path: str, size_ms: int, kind: Kind) -> DataFrame:
    return kind.shown(kind.combine(read_rows(spark, path)), size_ms)


def _touched(
    spark: SparkSession, path: str, batch_id: int, kind: Kind, before: int | None = None
) -> DataFrame | None:
    """The combined rows of the windows that a trigger touched. Rows of windows before and after all of these are not read."""
    touched = stage(
        read_batches(spark, f"{path}/partials", [batch_id]).select(*GROUP).distinct(),
        batch_path(f"{path}/work", batch_id) + "/touched",
    )
    low, high = touched.rows.agg(F.min(START), F.max(START)).first()
    wanted = Range(0, -1) if low is None else Range(low, high)
    rows = merged.read_rows(spark, path, LAYOUT, wanted, before)
    return None if rows is None else kind.combine(rows.join(touched.sized(), [*GROUP], "left_semi"))


def changed(spark: SparkSession, path: str, batch_id: int, size_ms: int, kind: Kind) -> DataFrame:
    """The table's rows for the windows that trigger ``batch_id`` touched: one update a window."""
    return kind.shown(_touched(spark, path, batch_id, kind), size_ms)


def stepped(
    spark: SparkSession, path: str, batch_id: int, obs: DataFrame, size_ms: int, kind: Kind
) -> DataFrame:
    """The table's row for its window after each record ``obs`` of trigger ``batch_id``: one update a record."""
    return kind.steps(obs, _touched(spark, path, batch_id, kind, batch_id), size_ms)


def merge(spark: SparkSession, path: str, batch_id: int, size_ms: int, kind: Kind) -> None:
    """Bring everything up to trigger ``batch_id`` together."""
    reached = spark.read.parquet(batch_path(f"{path}/reached", batch_id))
    furthest = F.lit(reached.agg(F.max("reached")).first()[0])
    ends = F.col(START) + size_ms
    before = merged.merge(
        spark, path, batch_id, LAYOUT, kind.combine, lambda rows: closed(ends, furthest, grace_ms(size_ms))
    )
    for b in batches_in(spark, f"{path}/reached"):
        if b < before:
            remove(spark, batch_path(f"{path}/reached", b))


def _step(batch: DataFrame, arrived: str) -> int:
    """Steps of the arrival column that hold about as many records as a chunk of offsets."""
    n, first, last = batch.agg(F.count(F.lit(1)), F.min(arrived), F.max(arrived)).first()
    return max(1, (last - first + 1) * CHUNK_OFFSETS // n) if n else 1


def _each(
    batch: DataFrame,
    batch_id: int,
    path: str,
    size_ms: int,
    part: str,
    kind: Kind,
    arrived: str | None = None,
    emit: Emit | None = None,
    merge_every: int = MERGE_EVERY,
    every_record: bool = False,
) -> None:
    spark = batch.sparkSession
    work = batch_path(f"{path}/work", batch_id)
    reached = (
        spark.read.parquet(batch_path(f"{path}/reached", batch_id - 1)) if batch_id else None
    )
    batch = batch.persist()
    try:
        now = stream_times(batch, part)
        if reached is not None:
            now = stream_times(
                now.unionByName(reached).withColumnRenamed("reached", "ts_ms"), part
            )
        write_batch(now, f"{path}/reached", batch_id)
        how = {"arrived": arrived, "chunk_offsets": _step(batch, arrived)} if arrived else {}
        kept = drop_late(batch, size_ms, part=part, reached=reached, work=f"{work}/suspects", **how)
        write_batch(kind.reduce(kept, work, size_ms), f"{path}/partials", batch_id)
        if emit is not None and every_record:
            emit(stepped(spark, path, batch_id, kept, size_ms, kind), batch_id)
    finally:
        batch.unpersist()
    if emit is not None and not every_record:
        emit(changed(spark, path, batch_id, size_ms, kind), batch_id)
    if (batch_id + 1) % merge_every == 0:
        merge(spark, path, batch_id, size_ms, kind)
    remove(spark, work)


def keep_exactly(
    obs: DataFrame,
    kind: Kind,
    size_ms: int,
    path: str,
    name: str,
    checkpoint: str,
    part: str = "part",
    arrived: str | None = None,
    emit: Emit | None = None,
    merge_every: int = MERGE_EVERY,
    every_record: bool = False,
    **run,
) -> StreamingQuery:
    """Keep an exact table of a stream of valid records.

    ``part`` and ``arrived`` are those of ``late.flag_late``. ``emit`` is given the changed rows of every
    trigger, or with ``every_record`` the row of its window after each record; a trigger that runs
    again gives them again.
    """
    each = partial(
        _each,
        path=path,
        size_ms=size_ms,
        part=part,
        kind=kind,
        arrived=arrived,
        emit=emit,
        merge_every=merge_every,
        every_record=every_record,
    )
    return to_batches(obs, each, name, checkpoint, **{"mode": "append", **run})


def count_exactly(
    obs: DataFrame, size_ms: int, path: str, name: str, checkpoint: str, part: str = "part", **how
) -> StreamingQuery:
    """Keep exact counts per key and window of a stream of valid records."""
    wanted = ["key", "part", part, "off", "ts_ms", how.get("arrived")]
    narrow = obs.select(*dict.fromkeys(c for c in wanted if c))
    return keep_exactly(narrow, COUNTS, size_ms, path, name, checkpoint, part, **how)


def max_exactly(
    obs: DataFrame, size_ms: int, path: str, name: str, checkpoint: str, part: str = "part", **how
) -> StreamingQuery:
    """Keep the exact winner per key and window of a stream of valid records."""
    return keep_exactly(obs, MAXIMA, size_ms, path, name, checkpoint, part, **how)


def read_counts(spark: SparkSession, path: str, size_ms: int) -> DataFrame:
    return read_table(spark, path, size_ms, COUNTS)


def read_maxima(spark: SparkSession, path: str, size_ms: int) -> DataFrame:
    return read_table(spark, path, size_ms, MAXIMA)
