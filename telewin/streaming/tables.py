"""Update streams kept as tables in shared storage."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from telewin.operators.compaction import BATCH, TABLE_KEY, latest
from telewin.operators.windows import END, RETENTION_MS
from telewin.streaming import merged
from telewin.streaming.merged import Layout, batch_path, batches_in
from telewin.streaming.run import to_batches

LAYOUT = Layout("", "_base", "_closed", "_merged")


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write one trigger's rows under its id.

    A trigger that is run again after a failure replaces what it wrote before. The
    first trigger of a new checkpoint refuses a table that holds later triggers: its
    rows would be mixed with those of another run.
    """
    if batch_id == 0 and any(b > 0 for b in batches_in(batch.sparkSession, path)):
        raise ValueError(f"{path} holds another run's triggers; a new checkpoint needs a new table")
    batch.write.mode("overwrite").parquet(batch_path(path, batch_id))


def merge_updates(spark: SparkSession, path: str, batch_id: int, by: Sequence[str] = TABLE_KEY) -> None:
    """Keep only the last update of each row of the table up to a trigger.

    Windows that end a day before the furthest one are closed: later updates of theirs still count.
    """

    def over(rows: DataFrame) -> Column:
        if END not in rows.columns:
            return F.lit(False)
        return F.col(END) <= F.lit(rows.agg(F.max(END)).first()[0]) - RETENTION_MS

    merged.merge(spark, path, batch_id, LAYOUT, lambda rows: latest(rows, by), over)


def to_table(
    df: DataFrame,
    path: str,
    name: str,
    checkpoint: str,
    merge_every: int | None = None,
    by: Sequence[str] = TABLE_KEY,
    **run,
) -> StreamingQuery:
    """Append every trigger's updates to the table at ``path``.

    Every ``merge_every`` triggers the updates are merged; without it all of them are kept.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)
        if merge_every and (batch_id + 1) % merge_every == 0:
            merge_updates(batch.sparkSession, path, batch_id, by)

    return to_batches(df, each, name, checkpoint, **run)


def read_updates(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All updates, with the trigger each came from; of merged ones the last, with the trigger of the merge.

    With the ``schema`` of the rows, a table that no trigger has written yet is empty.
    """
    if schema is not None and not batches_in(spark, path):
        return spark.createDataFrame([], StructType([*schema.fields, StructField(BATCH, LongType())]))
    rows = merged.read_rows(spark, path, LAYOUT)
    if rows is None:
        raise ValueError(f"no trigger has written to {path} yet")
    return rows


def read_latest(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The windowed table as it stands after the last trigger."""
    return latest(read_updates(spark, path, schema))
