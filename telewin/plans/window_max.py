"""Job 2: the record with the greatest reading per device and resource, each 30 seconds."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from telewin.operators.maxima import max_by_window
from telewin.operators.records import mark_max, rekey_by_resource
from telewin.operators.updates import max_updates
from telewin.operators.windows import END, HALF_MINUTE_MS, START
from telewin.plans.source import arrival_of, observations, rekeyed, with_properties
from telewin.settings import MaxSettings
from telewin.sources.payloads import avro_response, to_framed_avro
from telewin.streaming import ledger
from telewin.streaming.run import use_stream_settings
from telewin.streaming.topics import publish, to_topic, topic_rows
from telewin.workspace import job_checkpoint


def window_max(
    obs: DataFrame,
    size_ms: int = HALF_MINUTE_MS,
    nan: str | None = None,
    on_bad: str = "null",
    **rule,
) -> DataFrame:
    """Winners of valid records, re-keyed and with both paths marked.

    NaN readings follow the replay rule in a batch and rank lowest on a stream,
    unless ``nan`` says otherwise. Marking only depends on the record itself, so it
    is done on the winners.
    """
    nan = nan or ("lowest" if obs.isStreaming else "replay")
    keyed = rekey_by_resource(obs, on_bad)
    return mark_max(max_by_window(keyed, size_ms, nan, on_bad, **rule))


def window_max_updates(
    obs: DataFrame,
    size_ms: int = HALF_MINUTE_MS,
    nan: str = "replay",
    on_bad: str = "null",
    **rule,
) -> DataFrame:
    """The winner after every record, re-keyed and with both paths marked.

    ``part`` and ``off`` name the record that caused the update, ``value`` is the
    winning record and ``best_off`` its offset.
    """
    updates = max_updates(rekey_by_resource(obs, on_bad), size_ms, nan, **rule)
    shown = updates.select(
        "key", START, END, "part", "off", F.col("best.off").alias("best_off"), "best.value"
    )
    return mark_max(shown, on_bad)


def output_rows(winners: DataFrame, settings: MaxSettings) -> DataFrame:
    """Winners as rows of the output topic."""
    key = value = None
    if settings.output_key_schema:
        key = to_framed_avro(F.col("key"), *settings.output_key_schema)
    if settings.output_value_schema:
        value = to_framed_avro(avro_response(F.col("value")), *settings.output_value_schema)
    return topic_rows(
        winners, settings.output_topic, settings.output_partitions, key, value
    )


def start_exact(
    spark: SparkSession, obs: DataFrame, settings: MaxSettings, emit: ledger.Emit, **run
) -> StreamingQuery:
    """Keep the winners of the stream ``obs`` exactly, and give each trigger's changed topic rows to ``emit``.

    The table lies in ``table`` under the checkpoint; see ``ledger.read_maxima``. Its records are not marked.
    """
    use_stream_settings(spark)
    base = job_checkpoint(spark, settings.checkpoint, settings.name)

    def emit_rows(winners: DataFrame, batch_id: int) -> None:
        if settings.every_record:
            # The updates of a key leave one task in the order of their records.
            winners = winners.repartition("key").sortWithinPartitions("off", "part")
        emit(output_rows(mark_max(winners), settings), batch_id)

    return ledger.max_exactly(
        rekeyed(obs, settings),
        settings.window_ms,
        f"{base}/table",
        settings.name,
        f"{base}/progress",
        "rpart",
        arrived=arrival_of(obs),
        emit=emit_rows,
        merge_every=settings.merge_every,
        every_record=settings.every_record,
        **run,
    )


def start(spark: SparkSession, settings: MaxSettings) -> StreamingQuery:
    """Publish the winners of each window as they change.

    Without the number of output partitions the producer would scatter the windows
    of a key, so the job asks for it.
    """
    if settings.output_partitions is None:
        raise ValueError("set output_partitions to the number of partitions of the output topic")
    settings = with_properties(spark, settings)
    if settings.exact:

        def emit(rows: DataFrame, batch_id: int) -> None:
            publish(rows, settings.brokers, settings.options)

        return start_exact(
            spark, observations(spark, settings), settings, emit, cadence=settings.cadence
        )
    use_stream_settings(spark)
    winners = window_max(
        observations(spark, settings),
        settings.window_ms,
        on_bad="fail" if settings.on_bad == "fail" else "null",
    )
    return to_topic(
        output_rows(winners, settings),
        settings.brokers,
        settings.name,
        job_checkpoint(spark, settings.checkpoint, settings.name),
        settings.options,
        cadence=settings.cadence,
    )
