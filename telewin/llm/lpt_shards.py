"""Balanced shards of groups that stay together: longest processing time first.

Groups (equal texts) are taken from the largest down, each to the shard with the
least bytes so far, through a heap. Groups that hold a fair part of a shard are
placed one by one; there can only be few of them. The others are first tied into
bundles of groups of nearly one size, by a hash, so that what the heap sees is
bounded by the number of shards and ``FINE``, whatever the number of documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import numbered, written

#: A bundle holds about this part of a shard's bytes: shards differ by about as much.
FINE = 500
_NULL = "null"


def least_loaded(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, sizes being given from the largest down."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size in sizes:
        load, shard = heapq.heappop(heap)
        out.append(shard)
        heapq.heappush(heap, (load + size, shard))
    return out


def _placed(spark: SparkSession, groups: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """``key, shard`` of the large groups and of the others."""
    total_bytes, total_rows = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    unit = max(1, (total_bytes or 0) // (shards * FINE))
    many = max(1, (total_rows or 0) // (shards * FINE))
    # At most shards * FINE groups exceed either bound (twice that by rounding).
    large = (F.col("bytes") > unit) | (F.col("rows") > many)
    kind = F.floor(F.log2("bytes") * 4).cast("int")
    small = groups.where(~large).withColumn("kind", kind)
    bundles = small.groupBy("kind").agg(F.ceil(F.sum("bytes") / F.lit(unit)).cast("long").alias("bundles"))
    small = small.join(F.broadcast(bundles), "kind").withColumn("bundle", F.pmod(F.xxhash64("key"), "bundles"))
    sums = small.groupBy("kind", "bundle").agg(F.sum("bytes").alias("bytes")).collect()
    alone = groups.where(large).select("key", "bytes").collect()
    items = [(r["bytes"], (r["kind"], r["bundle"])) for r in sums] + [(r["bytes"], r["key"]) for r in alone]
    items.sort(key=lambda x: (-x[0], str(x[1])))
    shard = least_loaded([x[0] for x in items], shards)
    large_rows = [(k, s) for (_, k), s in zip(items, shard, strict=True) if isinstance(k, str)]
    small_rows = [(*k, s) for (_, k), s in zip(items, shard, strict=True) if not isinstance(k, str)]
    by_key = spark.createDataFrame(large_rows, "key string, shard int")
    by_bundle = spark.createDataFrame(small_rows, "kind int, bundle long, shard int")
    return by_key, small.join(F.broadcast(by_bundle), ["kind", "bundle"]).select("key", "shard")


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 8; rows of equal text share a
    shard. The law is ``bytes``: shards hold nearly equal bytes, as far as
    single groups allow. A null text counts 8 bytes, has no checksum, and all null
    texts are one group, apart from the empty text. ``slot`` numbers the rows of
    a shard from 0. Repeated rows are rows. Empty tables give no rows; columns other
    than ``doc_id`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
            F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit(_NULL)).alias("key"),
        ),
        "sizes",
    )
    groups = written(
        rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups"
    )
    by_key, others = _placed(spark, groups, shards)
    by_key = F.broadcast(by_key)
    placed = rows.join(by_key, "key").unionByName(rows.join(by_key, "key", "left_anti").join(others, "key"))
    # Both the slices and the order within follow the hash of the group and the id.
    out = numbered(placed.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id"], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
