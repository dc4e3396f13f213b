"""Every operator as a named query over the ``events`` table.

Results are flat: bounds are epoch milliseconds and a winning record is shown by
its offset, time, paths and reading.
"""

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from telewin.functions import frame, record, windowed_key
from telewin.operators.compaction import latest
from telewin.operators.counts import count_by_window
from telewin.operators.late import drop_late, flag_late
from telewin.operators.records import mark_max, rekey_by_resource, valid_records, with_event_time
from telewin.operators.updates import count_updates
from telewin.operators.windows import (
    END,
    HALF_MINUTE_MS,
    MINUTE_MS,
    START,
    assign_window,
)
from telewin.plans import device_counts, window_max
from telewin.settings import CountSettings, MaxSettings
from telewin.sources import tables
from telewin.streaming import ledger, stores
from telewin.streaming.merged import batches_in, read_batches
from telewin.streaming.run import finish, use_stream_settings
from telewin.streaming.tables import read_latest, read_updates, to_table, write_batch
from telewin.streaming.topics import read_topic_rows, topic_rows
from telewin.workspace import work_dir

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values the oracle repeats.
OUTPUT_TOPIC = "analytics.server1.observations.maxper30sec"
OUTPUT_PARTITIONS = 8
SLICES = 3


# --- views ---------------------------------------------------------------


def obs(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    return tables.observations(tables.read_events(spark, sf_dir, streaming))


def valid(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    return valid_records(obs(spark, sf_dir, streaming))


def with_bad_rows(observations: DataFrame) -> DataFrame:
    """Some keys missing, some times negative, some resource paths missing."""
    no_path = F.when(F.col("off") % 107 != 0, record.resource_path(F.col("value")))
    time = F.when(F.col("off") % 103 == 0, -1).otherwise(F.col("value.timestamp"))
    return observations.withColumns(
        {
            "key": F.when(F.col("off") % 101 != 0, F.col("key")),
            "value": F.col("value")
            .withField("timestamp", time)
            .withField("rep.body.content.path", no_path),
        }
    )


def with_nan(observations: DataFrame) -> DataFrame:
    """Every eleventh reading of a double is NaN."""
    reading = "rep.body.content.value"
    number = F.col(f"value.{reading}.dbl")
    broken = F.when((F.col("off") % 11 == 0) & number.isNotNull(), float("nan")).otherwise(number)
    return observations.withColumn("value", F.col("value").withField(f"{reading}.dbl", broken))


def late(events: DataFrame) -> DataFrame:
    """Valid records on the table's own clock, some of them two days old on arrival.

    ``rpart`` stands for the partition a record lands in once it is re-keyed.
    """
    rpart = ((F.col("user_id") % tables.DEVICES + F.length("event_type")) % tables.PARTITIONS)
    numbered = events.withColumn("rpart", rpart.cast("int"))
    return valid_records(tables.observations(numbered, tables.late_ms(), "rpart"))


# --- flat results --------------------------------------------------------


def ep() -> Column:
    return F.col("key.ep")


def flat_reading(value: str = "value") -> list[Column]:
    whole = record.resource(F.col(value)).getField("value").getField("lng").isNotNull()
    return [record.numeric_value(F.col(value)).alias("v"), whole.alias("is_long")]


def flat_counts(counted: DataFrame, name: str = "ep") -> DataFrame:
    return counted.select(ep().alias(name), START, END, "n")


def flat_winners(winners: DataFrame, *more: str) -> DataFrame:
    value = F.col("value")
    return winners.select(
        ep().alias("ep_path"),
        START,
        END,
        *more,
        F.col("value.timestamp").alias("ts_ms"),
        record.numeric_value(value).alias("v"),
        record.resource_path(value).alias("path"),
        F.col("value.path").alias("value_path"),
    )


# --- sources and decode --------------------------------------------------


def flat_observations(rows: DataFrame) -> DataFrame:
    return rows.select(
        "off",
        F.col("part").cast("bigint").alias("part"),
        ep().alias("ep"),
        F.col("value.path").alias("path"),
        F.col("value.timestamp").alias("ts_ms"),
        *flat_reading(),
    )


def observations_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_observations(obs(spark, sf_dir))


def stream_observations_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_observations(obs(spark, sf_dir, streaming=True))
    return read_updates(spark, run_to_table(spark, rows, "scan", mode="append")).drop("batch_id")


def wire_frame_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    path = F.col("value.path")
    framed = frame.frame(F.encode(path, "UTF-8"), F.length(path).cast("bigint") * 256 + 7)
    return rows.select("off", framed.alias("data")).select(
        "off",
        frame.schema_id(F.col("data")).alias("schema_id"),
        F.decode(frame.body(F.col("data")), "UTF-8").alias("path"),
    )


def event_time_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = with_event_time(obs(spark, sf_dir), record.timestamp_ms(F.col("value")))
    return timed.select("off", F.unix_micros("event_time").alias("event_time_us"))


# --- filters and projections ---------------------------------------------


def valid_records_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = valid_records(with_bad_rows(obs(spark, sf_dir)))
    return kept.select("off", ep().alias("ep"), "ts_ms")


def resource_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = obs(spark, sf_dir).select("off", record.resource(F.col("value")).alias("resource"))
    reading = F.col("resource.value")
    return found.select(
        "off",
        F.col("resource.path").alias("path"),
        record.text(reading.getField("lng")).alias("lng_text"),
        F.coalesce(reading.getField("dbl"), F.lit(-1.0)).alias("dbl_or_minus_one"),
    )


def numeric_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select("off", record.numeric_value(F.col("value")).alias("v"))


def rekey_ep_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rekeyed = rekey_by_resource(valid_records(with_bad_rows(obs(spark, sf_dir))))
    return rekeyed.select("off", ep().alias("ep_path"), "ts_ms")


def map_max_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = mark_max(rekey_by_resource(valid(spark, sf_dir)))
    return mapped.select(
        "off",
        ep().alias("ep_path"),
        F.col("value.path").alias("value_path"),
        record.resource_path(F.col("value")).alias("resource_path"),
        "ts_ms",
        record.numeric_value(F.col("value")).alias("v"),
    )


# --- windows and time ----------------------------------------------------


def tumbling(size_ms: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return assign_window(valid(spark, sf_dir), size_ms).select("off", START, END)

    return query


def late_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_late(late(tables.read_events(spark, sf_dir)), MINUTE_MS)
    return flagged.select("off", F.col("part").cast("bigint").alias("part"), "late")


def late_count_by_ep_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_late(late(tables.read_events(spark, sf_dir)), MINUTE_MS)
    return flat_counts(device_counts.per_device(kept))


def late_count_by_ep_path_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_late(late(tables.read_events(spark, sf_dir)), MINUTE_MS, part="rpart")
    return flat_counts(device_counts.per_resource(kept), "ep_path")


def late_max_by_ep_path_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_late(late(tables.read_events(spark, sf_dir)), HALF_MINUTE_MS, part="rpart")
    return flat_winners(window_max.window_max(kept), "off")


# --- aggregations --------------------------------------------------------


def count_by_ep_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_counts(device_counts.per_device(valid(spark, sf_dir)))


def count_by_ep_path_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_counts(device_counts.per_resource(valid(spark, sf_dir)), "ep_path")


def count_both_levels_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = device_counts.both_levels(valid(spark, sf_dir))
    return counted.select("level", ep().alias("name"), START, END, "n")


def max_by_ep_path_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_winners(window_max.window_max(valid(spark, sf_dir)), "off")


def max_by_ep_path_30s_nan_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_records(with_nan(obs(spark, sf_dir)))
    return nan_winners(window_max.window_max(rows))


def nan_winners(winners: DataFrame) -> DataFrame:
    number = record.numeric_value(F.col("value"))
    return winners.select(
        ep().alias("ep_path"),
        START,
        END,
        "off",
        F.isnan(number).alias("is_nan"),
        F.nanvl(number, F.lit(-1.0)).alias("v_or_minus_one"),
    )


def updates_count_by_ep_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = count_updates(valid(spark, sf_dir), MINUTE_MS)
    return updates.select(ep().alias("ep"), START, END, "off", "n")


def updates_count_by_ep_path_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = count_updates(rekey_by_resource(valid(spark, sf_dir)), MINUTE_MS)
    return updates.select(ep().alias("ep_path"), START, END, "off", "n")


def marked_paths() -> list[Column]:
    value = F.col("value")
    return [record.resource_path(value).alias("path"), F.col("value.path").alias("value_path")]


def updates_max_by_ep_path_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = window_max.window_max_updates(valid(spark, sf_dir))
    best = record.numeric_value(F.col("value")).alias("best_v")
    return updates.select(
        ep().alias("ep_path"), START, END, "off", "best_off", best, *marked_paths()
    )


def updates_max_by_ep_path_30s_nan_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = window_max.window_max_updates(valid_records(with_nan(obs(spark, sf_dir))))
    number = record.numeric_value(F.col("value"))
    return updates.select(
        ep().alias("ep_path"),
        START,
        END,
        "off",
        "best_off",
        F.isnan(number).alias("best_is_nan"),
        F.nanvl(number, F.lit(-1.0)).alias("best_v_or_minus_one"),
        *marked_paths(),
    )


# --- streams -------------------------------------------------------------


def run_to_table(spark: SparkSession, rows: DataFrame, name: str, mode: str = "update") -> str:
    """Run a stream over what its source holds now; returns where its updates are."""
    use_stream_settings(spark)
    base = work_dir(spark, name)
    finish(
        to_table(
            rows, f"{base}/table", base.rsplit("/", 1)[1], f"{base}/checkpoint",
            mode=mode, available_now=True,
        )
    )
    return f"{base}/table"


def run_in_slices(
    spark: SparkSession,
    sf_dir: str,
    base: str,
    start: Callable[[DataFrame], StreamingQuery | list[StreamingQuery]],
) -> None:
    """Let the log grow by offset ranges and resume the same queries after each step.

    Every step is one trigger, so a slice is in order however many files it has. Its rows are dealt over the
    tasks by offset: left where they were read, a slice would lie with a few of them, and so would its trigger.
    """
    events = tables.read_events(spark, sf_dir)
    log = f"{base}/log"
    end = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    for step in range(SLICES):
        low, high = end * step // SLICES, end * (step + 1) // SLICES
        of_step = (F.col("event_id") >= low) & (F.col("event_id") < high)
        events.where(of_step).repartitionByRange("event_id").write.mode("append").parquet(log)
        started = start(spark.readStream.schema(tables.EVENTS).parquet(log))
        for query in started if isinstance(started, list) else [started]:
            finish(query)


def stream_count_by_ep_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = device_counts.per_device(valid(spark, sf_dir, streaming=True))
    return flat_counts(read_latest(spark, run_to_table(spark, counted, "count-ep")))


def stream_count_by_ep_path_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = device_counts.per_resource(valid(spark, sf_dir, streaming=True))
    return flat_counts(read_latest(spark, run_to_table(spark, counted, "count-path")), "ep_path")


def stream_count_both_levels_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = device_counts.both_levels(valid(spark, sf_dir, streaming=True))
    table = read_updates(spark, run_to_table(spark, counted, "count-both"))
    return latest(table, ("level", "key", START, END)).select(
        "level", ep().alias("name"), START, END, "n"
    )


def stream_max_by_ep_path_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    winners = window_max.window_max(valid(spark, sf_dir, streaming=True))
    return flat_winners(read_latest(spark, run_to_table(spark, winners, "max")), "off")


def compacted(
    spark: SparkSession, sf_dir: str, result: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The table a query's updates add up to, after several triggers and restarts."""
    use_stream_settings(spark)
    base = work_dir(spark, "compacted")

    def start(events: DataFrame) -> StreamingQuery:
        return to_table(
            result(valid_records(tables.observations(events))),
            f"{base}/table",
            base.rsplit("/", 1)[1],
            f"{base}/checkpoint",
            merge_every=2,
            available_now=True,
        )

    run_in_slices(spark, sf_dir, base, start)
    return read_latest(spark, f"{base}/table")


def compacted_count_by_ep_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_counts(compacted(spark, sf_dir, device_counts.per_device))


def compacted_count_by_ep_path_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_counts(compacted(spark, sf_dir, device_counts.per_resource), "ep_path")


def compacted_max_by_ep_path_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_winners(compacted(spark, sf_dir, window_max.window_max), "off")


def state_of(spark: SparkSession, result: DataFrame) -> str:
    """Run a query to the end of its source; returns the checkpoint with its state."""
    return run_to_table(spark, result, "store").rsplit("/", 1)[0] + "/checkpoint"


def store_count_by_ep_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = state_of(spark, device_counts.per_device(valid(spark, sf_dir, streaming=True)))
    return flat_counts(stores.read_counts(spark, kept, MINUTE_MS))


def store_count_by_ep_path_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = state_of(spark, device_counts.per_resource(valid(spark, sf_dir, streaming=True)))
    return flat_counts(stores.read_counts(spark, kept, MINUTE_MS), "ep_path")


def store_max_by_ep_path_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = state_of(spark, window_max.window_max(valid(spark, sf_dir, streaming=True)))
    return flat_winners(mark_max(stores.read_maxima(spark, kept, HALF_MINUTE_MS)), "off")


def exact(
    spark: SparkSession,
    sf_dir: str,
    keep: Callable[..., StreamingQuery],
    rows_of: Callable[[DataFrame], DataFrame],
    size_ms: int,
    part: str = "part",
) -> str:
    """Keep an exact table over several triggers and restarts; returns where it is."""
    base = work_dir(spark, "exact")

    def start(events: DataFrame) -> StreamingQuery:
        return keep(
            rows_of(events),
            size_ms,
            f"{base}/table",
            base.rsplit("/", 1)[1],
            f"{base}/checkpoint",
            part=part,
            available_now=True,
        )

    run_in_slices(spark, sf_dir, base, start)
    return f"{base}/table"


def late_by_resource(events: DataFrame) -> DataFrame:
    return rekey_by_resource(late(events))


def stream_late_count_by_ep_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = exact(spark, sf_dir, ledger.count_exactly, late, MINUTE_MS)
    return flat_counts(ledger.read_counts(spark, table, MINUTE_MS))


def stream_late_count_by_ep_path_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = exact(spark, sf_dir, ledger.count_exactly, late_by_resource, MINUTE_MS, "rpart")
    return flat_counts(ledger.read_counts(spark, table, MINUTE_MS), "ep_path")


def stream_late_max_by_ep_path_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = exact(spark, sf_dir, ledger.max_exactly, late_by_resource, HALF_MINUTE_MS, "rpart")
    return flat_winners(mark_max(ledger.read_maxima(spark, table, HALF_MINUTE_MS)), "off")


def stream_max_by_ep_path_30s_nan_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows_of(events: DataFrame) -> DataFrame:
        return rekey_by_resource(valid_records(with_nan(tables.observations(events))))

    table = exact(spark, sf_dir, ledger.max_exactly, rows_of, HALF_MINUTE_MS)
    return nan_winners(ledger.read_maxima(spark, table, HALF_MINUTE_MS))


def late_records(events: DataFrame) -> DataFrame:
    return valid_records(tables.observations(events, tables.late_ms()))


def exact_job_counts_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exact count job has given out, by its last word on each window, over restarts and a merge."""
    base = work_dir(spark, "exact-counts")
    settings = CountSettings(checkpoint=base, exact=True, partitions=tables.PARTITIONS, merge_every=2)

    def to_updates(level: str) -> ledger.Emit:
        return lambda rows, batch_id: write_batch(rows, f"{base}/{level}", batch_id)

    def start(events: DataFrame) -> list[StreamingQuery]:
        return device_counts.start_exact(
            spark, late_records(events), settings, to_updates, available_now=True
        )

    run_in_slices(spark, sf_dir, base, start)
    shown = [
        read_latest(spark, f"{base}/{level}").select(F.lit(name).alias("level"), ep().alias("name"), START, END, "n")
        for level, name in (("ep", "ep"), ("ep-path", "ep_path"))
    ]
    return shown[0].unionByName(shown[1])


def exact_job_updates_count_by_ep_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact count after each record, over restarts and a merge."""
    base = work_dir(spark, "exact-steps")

    def emit(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, f"{base}/steps", batch_id)

    how = {"emit": emit, "every_record": True, "merge_every": 2}
    exact(spark, sf_dir, partial(ledger.count_exactly, **how), late_records, MINUTE_MS)
    steps = read_batches(spark, f"{base}/steps", batches_in(spark, f"{base}/steps"))
    return steps.select(ep().alias("ep"), START, END, "off", "n")


def exact_job_updates_max_by_ep_path_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact winner after each record, NaN readings included, over restarts and a merge."""
    base = work_dir(spark, "exact-steps")

    def emit(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, f"{base}/steps", batch_id)

    def rows_of(events: DataFrame) -> DataFrame:
        return rekey_by_resource(valid_records(with_nan(tables.observations(events))))

    how = {"emit": emit, "every_record": True, "merge_every": 2}
    exact(spark, sf_dir, partial(ledger.max_exactly, **how), rows_of, HALF_MINUTE_MS)
    steps = mark_max(read_batches(spark, f"{base}/steps", batches_in(spark, f"{base}/steps")))
    number = record.numeric_value(F.col("value"))
    return steps.select(
        ep().alias("ep_path"),
        START,
        END,
        "off",
        "best_off",
        F.isnan(number).alias("best_is_nan"),
        F.nanvl(number, F.lit(-1.0)).alias("best_v_or_minus_one"),
        *marked_paths(),
    )


def exact_job_publish_max_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exact max job has published, by the last record of each windowed key, and the partition of it."""
    base = work_dir(spark, "exact-max")
    settings = MaxSettings(
        checkpoint=base,
        exact=True,
        partitions=tables.PARTITIONS,
        output_partitions=OUTPUT_PARTITIONS,
        merge_every=2,
    )

    def emit(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, f"{base}/published", batch_id)

    def start(events: DataFrame) -> StreamingQuery:
        return window_max.start_exact(
            spark, late_records(events), settings, emit, available_now=True
        )

    run_in_slices(spark, sf_dir, base, start)
    published = latest(read_updates(spark, f"{base}/published"), ("key",))
    return flat_winners(read_topic_rows(published, HALF_MINUTE_MS), "topic", "partition")


# --- sinks ---------------------------------------------------------------


def publish_max_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    winners = window_max.window_max(valid(spark, sf_dir, streaming=True))
    rows = topic_rows(winners, OUTPUT_TOPIC, OUTPUT_PARTITIONS)
    published = read_updates(spark, run_to_table(spark, rows, "publish"))
    return flat_winners(
        read_topic_rows(latest(published, ("key",)), HALF_MINUTE_MS), "topic"
    )


def publish_partition_colocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topic_rows(
        window_max.window_max(valid(spark, sf_dir)), OUTPUT_TOPIC, OUTPUT_PARTITIONS
    )
    return (
        read_topic_rows(rows, HALF_MINUTE_MS)
        .groupBy(ep().alias("ep_path"))
        .agg(
            F.count(F.lit(1)).alias("n_windows"),
            F.count_distinct("partition").alias("n_partitions"),
        )
    )


def publish_partition_by_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output partition of every key: the one a producer gives it."""
    rows = topic_rows(
        window_max.window_max(valid(spark, sf_dir)), OUTPUT_TOPIC, OUTPUT_PARTITIONS
    )
    decoded = read_topic_rows(rows, HALF_MINUTE_MS)
    return decoded.groupBy(ep().alias("ep_path"), "partition").agg(
        F.count(F.lit(1)).alias("n_windows")
    )


def encoded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_by_window(rekey_by_resource(valid(spark, sf_dir)), HALF_MINUTE_MS)
    data = windowed_key.encode(F.encode(ep(), "UTF-8"), F.col(START))
    return counted.select(ep().alias("ep_path"), START, data.alias("data"))


def windowed_key_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_keys(spark, sf_dir).select("ep_path", START, F.hex("data").alias("key_hex"))


def windowed_key_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("data")
    start = windowed_key.decode_start_ms(data)
    return encoded_keys(spark, sf_dir).select(
        F.decode(windowed_key.decode_key(data), "UTF-8").alias("ep_path"),
        start.alias(START),
        (start + HALF_MINUTE_MS).alias(END),
    )


QUERIES: dict[str, Query] = {
    "count_by_ep_1m": count_by_ep_1m,
    "count_by_ep_path_1m": count_by_ep_path_1m,
    "count_both_levels_1m": count_both_levels_1m,
    "max_by_ep_path_30s": max_by_ep_path_30s,
    "max_by_ep_path_30s_nan_replay": max_by_ep_path_30s_nan_replay,
    "updates_count_by_ep_1m": updates_count_by_ep_1m,
    "updates_count_by_ep_path_1m": updates_count_by_ep_path_1m,
    "updates_max_by_ep_path_30s": updates_max_by_ep_path_30s,
    "updates_max_by_ep_path_30s_nan_replay": updates_max_by_ep_path_30s_nan_replay,
    "observations_scan": observations_scan,
    "wire_frame_decode": wire_frame_decode,
    "event_time_extract": event_time_extract,
    "valid_records_filter": valid_records_filter,
    "resource_extract": resource_extract,
    "numeric_value": numeric_value,
    "rekey_ep_path": rekey_ep_path,
    "map_max_path": map_max_path,
    "tumbling_assign_1m": tumbling(MINUTE_MS),
    "tumbling_assign_30s": tumbling(HALF_MINUTE_MS),
    "late_flag": late_flag,
    "late_count_by_ep_1m": late_count_by_ep_1m,
    "late_count_by_ep_path_1m": late_count_by_ep_path_1m,
    "late_max_by_ep_path_30s": late_max_by_ep_path_30s,
    "windowed_key_encode": windowed_key_encode,
    "windowed_key_decode": windowed_key_decode,
    "publish_partition_colocation": publish_partition_colocation,
    "publish_partition_by_key_hash": publish_partition_by_key_hash,
    "publish_max_30s": publish_max_30s,
    "stream_observations_scan": stream_observations_scan,
    "stream_count_by_ep_1m": stream_count_by_ep_1m,
    "stream_count_by_ep_path_1m": stream_count_by_ep_path_1m,
    "stream_count_both_levels_1m": stream_count_both_levels_1m,
    "stream_max_by_ep_path_30s": stream_max_by_ep_path_30s,
    "compacted_count_by_ep_1m": compacted_count_by_ep_1m,
    "compacted_count_by_ep_path_1m": compacted_count_by_ep_path_1m,
    "compacted_max_by_ep_path_30s": compacted_max_by_ep_path_30s,
    "store_count_by_ep_1m": store_count_by_ep_1m,
    "store_count_by_ep_path_1m": store_count_by_ep_path_1m,
    "store_max_by_ep_path_30s": store_max_by_ep_path_30s,
    "stream_late_count_by_ep_1m": stream_late_count_by_ep_1m,
    "stream_late_count_by_ep_path_1m": stream_late_count_by_ep_path_1m,
    "stream_late_max_by_ep_path_30s": stream_late_max_by_ep_path_30s,
    "stream_max_by_ep_path_30s_nan_replay": stream_max_by_ep_path_30s_nan_replay,
    "exact_job_counts_1m": exact_job_counts_1m,
    "exact_job_publish_max_30s": exact_job_publish_max_30s,
    "exact_job_updates_count_by_ep_1m": exact_job_updates_count_by_ep_1m,
    "exact_job_updates_max_by_ep_path_30s": exact_job_updates_max_by_ep_path_30s,
}
