"""Tables that grow by trigger and are merged from time to time.

Every trigger writes its rows to a folder of its own. A merge brings everything up to its trigger
together: windows that are over go to a closed part, the others to a base. A mark then says that
both are whole, and which window starts were closed. What a merge replaced is kept until the
next one, for those who are reading it, and then removed.

Running a merge again, after a failure at any point or with its trigger, changes nothing: rows count
once their mark is there, and a mark is set once.
"""

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from telewin.operators.compaction import BATCH
from telewin.operators.windows import START


class Layout(NamedTuple):
    """Folders of the parts under a table's path; Spark's readers pass over names with an underscore."""

    rows: str
    base: str
    closed: str
    merged: str


class Range(NamedTuple):
    """Window starts, both ends included."""

    low: int
    high: int


Combine = Callable[[DataFrame], DataFrame]
#: Which of the combined rows are over.
Over = Callable[[DataFrame], Column]


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/{BATCH}={batch_id}"


def part_path(path: str, part: str) -> str:
    return f"{path}/{part}" if part else path


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system: the store may be any that Spark reaches."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def mark(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.mkdirs(folder)


def remove(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The folders of triggers under ``path``."""
    folder, files = _folder(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return [n for n in names if n.startswith(f"{BATCH}=")]


def batches_in(spark: SparkSession, path: str) -> list[int]:
    """The triggers that have a folder under ``path``, ascending."""
    return sorted(int(n.removeprefix(f"{BATCH}=")) for n in names_in(spark, path))


def read_batches(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """The rows that these triggers wrote, with the trigger each came from; other folders are not listed."""
    rows = spark.read.option("basePath", path).parquet(*[batch_path(path, i) for i in ids])
    return rows.withColumn(BATCH, F.col(BATCH).cast("bigint"))


def merges(spark: SparkSession, path: str, layout: Layout) -> dict[int, Range | None]:
    """The triggers after which there was a merge, with the window starts it closed."""
    out = {}
    for name in names_in(spark, part_path(path, layout.merged)):
        batch_id, *ends = map(int, name.removeprefix(f"{BATCH}=").split("-"))
        out[batch_id] = Range(*ends) if ends else None
    return out


def read_rows(
    spark: SparkSession,
    path: str,
    layout: Layout,
    wanted: Range | None = None,
    before: int | None = None,
) -> DataFrame | None:
    """The kept rows of all triggers, each with the trigger it counts from; none if there was no trigger.

    With ``wanted``, only those of windows that start there; files of other closed windows are not looked at.
    With ``before``, only those of earlier triggers than this one, which is not before the last merge but one.
    """
    merged = {b: r for b, r in merges(spark, path, layout).items() if before is None or b < before}
    base = max(merged, default=-1)
    later = [b for b in batches_in(spark, part_path(path, layout.rows)) if b > base and (before is None or b < before)]
    closed = [
        b for b, r in merged.items() if r and (wanted is None or (r.low <= wanted.high and wanted.low <= r.high))
    ]
    parts = [(layout.rows, later), (layout.base, [base] if merged else []), (layout.closed, closed)]
    read = [read_batches(spark, part_path(path, part), ids) for part, ids in parts if ids]
    if not read:
        return None
    whole = read[0]
    for more in read[1:]:
        whole = whole.unionByName(more)
    return whole if wanted is None else whole.where(F.col(START).between(*wanted))


def _by_start(rows: DataFrame) -> DataFrame:
    """Rows sorted by window start over the files, so that a reader of a few windows skips the others.

    The rows of one window may be many: they are cut by a hash of their key.
    """
    if START not in rows.columns:
        return rows
    return rows.repartitionByRange(START, F.xxhash64("key")).sortWithinPartitions(START)


def merge(spark: SparkSession, path: str, batch_id: int, layout: Layout, combine: Combine, over: Over) -> int:
    """Bring everything up to trigger ``batch_id`` together; returns the merge before, -1 for none.

    ``combine`` makes the rows of several triggers one row a window.
    """
    merged = merges(spark, path, layout)
    base = max((b for b in merged if b < batch_id), default=-1)
    if batch_id in merged:
        return base
    rows_path, base_path = part_path(path, layout.rows), part_path(path, layout.base)
    rows = read_batches(spark, rows_path, [b for b in batches_in(spark, rows_path) if base < b <= batch_id])
    if base >= 0:
        rows = rows.unionByName(read_batches(spark, base_path, [base]))
    whole = combine(rows)
    # Worked out once for what follows.
    held = whole.withColumn("over", F.coalesce(over(whole), F.lit(False))).persist()
    name = batch_path(part_path(path, layout.merged), batch_id)
    try:
        still = _by_start(held.where(~F.col("over")).drop("over"))
        still.write.mode("overwrite").parquet(batch_path(base_path, batch_id))
        if START in whole.columns:
            done = held.where("over").drop("over")
            ends = done.agg(F.min(START), F.max(START)).first()
            if ends[0] is not None:
                target = batch_path(part_path(path, layout.closed), batch_id)
                _by_start(done).write.mode("overwrite").parquet(target)
                name = f"{name}-{ends[0]}-{ends[1]}"
    finally:
        held.unpersist()
    mark(spark, name)
    for b in batches_in(spark, rows_path):
        if b <= base:
            remove(spark, batch_path(rows_path, b))
    for b in batches_in(spark, base_path):
        if b < base:
            remove(spark, batch_path(base_path, b))
    return base
