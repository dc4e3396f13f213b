"""File tables as batch or streaming sources, and the telemetry view of ``events``."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Fixed values of the view: 2024-01-01T00:00:00Z, and how much faster than the
# table's own clock the derived devices report.
VIEW_START_MS = 1704067200000
VIEW_SPEEDUP = 720
DEVICES = 10
PARTITIONS = 4
LATE_SHIFT_MS = 172800000

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(
    spark: SparkSession, sf_dir: str, streaming: bool = False, **options: str
) -> DataFrame:
    """The ``events`` table, one file or a folder of files, as a batch or a file stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if streaming:
        # A file stream takes a single file only by pattern.
        path = f"{sf_dir}/events.parque[t]"
        return spark.readStream.schema(EVENTS).options(**options).parquet(path)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def fast_ms() -> Column:
    """30 days of events squeezed into one hour, so that windows hold several rows."""
    elapsed = event_ms() - VIEW_START_MS
    return F.lit(VIEW_START_MS) + F.call_function("div", elapsed, F.lit(VIEW_SPEEDUP))


def late_ms() -> Column:
    """The table's own clock, with every 97th reading two days old on arrival."""
    shift = F.when(F.col("event_id") % 97 == 0, LATE_SHIFT_MS).otherwise(0)
    return event_ms() - shift


def observations(events: DataFrame, time: Column | None = None, *more: str) -> DataFrame:
    """``events`` rows as nested observation records, with ``more`` columns kept.

    Click and view readings are longs, the others doubles. The event id is the
    arrival offset, so rows of one device arrive in offset order.
    """
    device = F.col("user_id") % DEVICES
    name = F.concat(F.lit("ep-"), F.lpad(device.cast("string"), 2, "0"))
    whole = F.col("event_type").isin("click", "view")
    # Named first and nested second: a reader of two fields then computes only those.
    flat = events.select(
        F.struct(name.alias("ep")).alias("key"),
        (fast_ms() if time is None else time).alias("timestamp"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(whole, F.get_json_object("props", "$.k").cast("bigint")).alias("lng"),
        F.when(~whole, F.col("value")).alias("dbl"),
        (device % PARTITIONS).cast("int").alias("part"),
        F.col("event_id").alias("off"),
        *more,
    )
    content = F.struct("path", F.struct("lng", "dbl").alias("value"))
    return flat.select(
        "key",
        F.struct(
            "timestamp",
            "path",
            F.struct(F.struct(content.alias("content")).alias("body")).alias("rep"),
        ).alias("value"),
        "part",
        "off",
        *more,
    )
