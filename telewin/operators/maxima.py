"""The record with the greatest reading per key and tumbling window.

The whole record is kept, and on equal readings the later one wins. A record
that is alone in its window is kept whatever its reading. Missing and
non-numeric readings rank lowest. For NaN there are two rules:

* ``"lowest"``: NaN ranks with the missing readings. One pass; works on streams.
* ``"replay"``: what comparing readings one by one with ``>`` gives. Every
  comparison with NaN is false, so a NaN displaces whatever came before it and
  is displaced by whatever comes next.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from telewin.functions import record
from telewin.operators.scan import (
    ARRIVAL,
    CHUNK,
    CHUNK_OFFSETS,
    arrival,
    with_chunk,
)
from telewin.operators.windows import (
    HALF_MINUTE_MS,
    START,
    assign_window,
    window_bounds,
    window_key,
    with_retention,
)
from telewin.workspace import stage

NAN_RULES = ("lowest", "replay")
GROUP = ("key", START)


def rank(on_bad: str = "null") -> Column:
    """What records compete by: the reading, then the arrival order."""
    number = record.numeric_value(F.col("value"), on_bad)
    return F.struct(F.nanvl(number, F.lit(None).cast("double")).alias("v"), *ARRIVAL)


def winner() -> Column:
    """What is kept of the winning record."""
    return F.struct("value", *ARRIVAL)


def is_nan() -> Column:
    """Whether the reading is NaN; the long branch is only looked at when the double is."""
    reading = record.resource(F.col("value")).getField("value")
    return F.isnan(reading.getField("dbl")) & reading.getField("lng").isNull()


def reduce_by_window(
    obs: DataFrame,
    keys: Sequence[str],
    size_ms: int,
    order_by: Column,
    keep: Column,
    name: str = "rec",
    grace: int | None = None,
) -> DataFrame:
    """Per key and window, ``keep`` of the record that is greatest by ``order_by``.

    ``order_by`` should differ between any two records of a group. Candidates
    are reduced before the shuffle.
    """
    obs = with_retention(obs, size_ms, grace)
    reduced = obs.groupBy(window_key(obs, size_ms), *keys).agg(
        F.max_by(keep, order_by).alias(name)
    )
    return reduced.select(*keys, *window_bounds(reduced, size_ms), name)


def max_by_window(
    obs: DataFrame,
    size_ms: int = HALF_MINUTE_MS,
    nan: str = "lowest",
    on_bad: str = "null",
    chunk_offsets: int = CHUNK_OFFSETS,
    work: str | None = None,
) -> DataFrame:
    """The winning record per key and window: ``key``, bounds, ``value``, ``part``, ``off``."""
    if nan not in NAN_RULES:
        raise ValueError(f"nan must be one of {NAN_RULES}, not {nan!r}")
    if nan == "lowest":
        best = reduce_by_window(obs, ["key"], size_ms, rank(on_bad), winner())
        return best.select("*", "rec.*").drop("rec")
    if obs.isStreaming:
        raise ValueError("nan='replay' needs the exact ledger on a stream")
    folded = fold_by_window(obs, size_ms, on_bad, chunk_offsets, work)
    return folded.select("key", *window_bounds(folded, size_ms), "rec.*")


def fold_by_window(
    obs: DataFrame,
    size_ms: int,
    on_bad: str = "null",
    chunk_offsets: int = CHUNK_OFFSETS,
    work: str | None = None,
) -> DataFrame:
    """The replay rule: per key and window start, ``rec``, its ``rank`` and ``reset``.

    ``reset`` tells whether a NaN displaced everything before it. Only records
    from a group's last NaN on can win. The chunk holding that NaN is read
    again, row by row; every later chunk is reduced before the shuffle, so no
    task sees more than one chunk of a group unreduced.
    """
    rows = with_chunk(assign_window(obs, size_ms), chunk_offsets).select(
        *GROUP,
        CHUNK,
        rank(on_bad).alias("rank"),
        winner().alias("rec"),
        arrival().alias("at"),
        is_nan().alias("nan"),
    )
    nans = rows.where("nan").groupBy(*GROUP).agg(
        F.max("at").alias("reset_at"), F.max(CHUNK).alias("reset_chunk")
    )
    staged = stage(nans, work, "resets")
    if not staged.count:
        return best_of(rows, GROUP).withColumn("reset", F.lit(False))

    resets = staged.sized()
    after = (
        best_of(rows, (*GROUP, CHUNK))
        .join(resets, [*GROUP], "left")
        .where(F.col("reset_chunk").isNull() | (F.col(CHUNK) > F.col("reset_chunk")))
        .select(*GROUP, "rec", "rank", F.col("reset_at").isNotNull().alias("reset"))
    )
    in_chunk = rows.join(resets.withColumnRenamed("reset_chunk", CHUNK), [*GROUP, CHUNK])
    during = best_of(in_chunk.where(F.col("at") >= F.col("reset_at")), GROUP).withColumn(
        "reset", F.lit(True)
    )
    both = after.unionByName(during)
    return both.groupBy(*GROUP).agg(
        F.max_by("rec", "rank").alias("rec"),
        F.max("rank").alias("rank"),
        F.max("reset").alias("reset"),
    )


def best_of(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.max_by("rec", "rank").alias("rec"), F.max("rank").alias("rank")
    )
