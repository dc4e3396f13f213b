"""Written intermediate tables and row numbers, used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workspace import work_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there."""
    path = work_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(table: DataFrame) -> None:
    """Remove the files of a table that ``written`` gave, once nothing reads them any more."""
    spark = table.sparkSession
    folders = {f.rpartition("/")[0] for f in table.inputFiles()}
    for name in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores appended until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, keys: list[str], spread: list[str], out: str, slices: int = 256) -> DataFrame:
    """Rows of each key numbered from 0 without gaps, with no key in one task.

    A key's rows are dealt to ``slices`` by a hash of ``spread``, numbered
    there, and shifted by the rows of the slices before. Only the counts of
    key and slice are summed over a key. Rows that are equal in ``spread``
    come in no fixed order. Null keys are keys.
    """
    part, before = free_name(df, "slice"), free_name(df, "before")
    sliced = df.withColumn(part, F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(slices)).cast("int"))
    sizes = sliced.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(out))
    running = Window.partitionBy(*keys).orderBy(part)
    shift = sizes.select(*keys, part, (F.sum(out).over(running) - F.col(out)).alias(before))
    within = Window.partitionBy(*keys, part).orderBy(*spread)
    ranked = sliced.withColumn(out, F.row_number().over(within).cast("long") - 1)
    same = [ranked[c].eqNullSafe(shift[c]) for c in [*keys, part]]
    joined = ranked.join(shift, _all(same))
    return joined.select(*[ranked[c] for c in df.columns], (ranked[out] + shift[before]).alias(out))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
