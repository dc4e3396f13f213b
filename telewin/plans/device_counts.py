"""Job 1: observations per device, and per device and resource, each minute."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from telewin.operators.counts import count_both_levels, count_by_window
from telewin.operators.records import rekey_by_resource
from telewin.operators.windows import MINUTE_MS
from telewin.plans.source import arrival_of, observations, rekeyed, with_properties
from telewin.settings import CountSettings
from telewin.streaming import ledger
from telewin.streaming.run import show, to_console, use_stream_settings
from telewin.workspace import job_checkpoint


def per_device(obs: DataFrame, size_ms: int = MINUTE_MS) -> DataFrame:
    """Counts per device and window of valid records."""
    return count_by_window(obs, size_ms)


def per_resource(obs: DataFrame, size_ms: int = MINUTE_MS, on_bad: str = "null") -> DataFrame:
    """Counts per device, resource and window of valid records."""
    return count_by_window(rekey_by_resource(obs, on_bad), size_ms)


def both_levels(obs: DataFrame, size_ms: int = MINUTE_MS, on_bad: str = "null") -> DataFrame:
    """Both counts from one read of the source."""
    return count_both_levels(obs, size_ms, on_bad)


def results(obs: DataFrame, settings: CountSettings) -> dict[str, DataFrame]:
    """What the job prints, by name: both counts together, or each on its own."""
    size_ms = settings.window_ms
    on_bad = "fail" if settings.on_bad == "fail" else "null"
    if settings.one_read:
        return {"both": both_levels(obs, size_ms, on_bad)}
    return {"ep": per_device(obs, size_ms), "ep-path": per_resource(obs, size_ms, on_bad)}


def start_exact(
    spark: SparkSession,
    obs: DataFrame,
    settings: CountSettings,
    emit: Callable[[str], ledger.Emit] | None = None,
    **run,
) -> list[StreamingQuery]:
    """Keep both counts of the stream ``obs`` exactly.

    Each trigger's changed rows are printed, or given to ``emit`` of the result's name. The tables lie in ``table`` under the checkpoint of each result; see ``ledger.read_counts``.
    """
    use_stream_settings(spark)
    emit = emit or (lambda level: lambda rows, batch_id: show(rows, settings.printed))
    keyed = rekeyed(obs, settings)
    # Devices count in the order of their own partition, re-keyed records in that of arrival.
    levels = (("ep", obs, "part", None), ("ep-path", keyed, "rpart", arrival_of(obs)))
    queries = []
    for level, rows, part, arrived in levels:
        name = f"{settings.name}-{level}"
        base = job_checkpoint(spark, settings.checkpoint, name)
        how = {
            "arrived": arrived,
            "emit": emit(level),
            "merge_every": settings.merge_every,
            "every_record": settings.every_record,
            **run,
        }
        queries.append(
            ledger.count_exactly(rows, settings.window_ms, f"{base}/table", name, f"{base}/progress", part, **how)
        )
    return queries


def start(spark: SparkSession, settings: CountSettings) -> list[StreamingQuery]:
    """Print the counts as they change, each result by a query with its own checkpoint."""
    settings = with_properties(spark, settings)
    if settings.exact:
        return start_exact(spark, observations(spark, settings), settings, cadence=settings.cadence)
    use_stream_settings(spark)
    return [
        to_console(
            counted,
            f"{settings.name}-{name}",
            job_checkpoint(spark, settings.checkpoint, f"{settings.name}-{name}"),
            settings.printed,
            cadence=settings.cadence,
        )
        for name, counted in results(observations(spark, settings), settings).items()
    ]
