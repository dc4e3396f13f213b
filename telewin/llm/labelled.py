"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no classifier may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], bound: int) -> DataFrame:
    """``doc_id``, ``text`` and the label ``columns`` of about ``bound`` labelled documents, or of all if fewer.

    Rows are chosen by a hash of their id, so the choice is the same on every
    run. Labels that are null in any column are left out; of several labels of an id
    the least of each column counts, of several documents of an id each takes part.
    """
    known = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.min(c).cast("int").alias(c) for c in columns])
    part = min(1.0, bound / max(1, known.count()))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / float(2**53)
    # About ``bound`` rows of a few numbers.
    chosen = F.broadcast(known.where(uniform < part))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
