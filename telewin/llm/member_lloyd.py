"""Vector codes of four parts, their codebooks found by Lloyd's rounds over resident members.

A vector is cut into parts, and each part position has a codebook. The rows of
the parts live with their owners: a row is placed by (position, entry, salt), and
entries with many members have several salts, so that no owner holds more than a fair share.
In a round the owners sum up the members that lie with them, one row an entry and task,
which gives the new entries; then every row is held against the new codebook where it
lies. Rows that keep their entry stay; only those that change it are shuffled, to their
new owners. Codebooks are bounded by their definition and travel with the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..workspace import stage
from .shared import discarded, written

#: Of each position: the integer entries, as one matrix.
Codebooks = list[np.ndarray]


def part_widths(dims: int, parts: int) -> list[int]:
    """Equal widths; where ``dims`` is no multiple, the first parts are longer by one."""
    return [dims // parts + (p < dims % parts) for p in range(parts)]


def largest_component(dims: int, parts: int) -> int:
    """Beyond this a component is cut off, so that errors of a vector fit into a long."""
    return math.isqrt(2**60 // (4 * max(part_widths(dims, parts)) or 1))


def as_integers(vectors: DataFrame, scale: int, label: str | None) -> DataFrame:
    """``vec_id, label, x`` of the vectors that are not null and hold no null or non-finite component."""
    finite = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"),
    )


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of integer rows: the nearest entry, of equally near ones the first, and its squared distance; exact."""
    top = max((int(np.abs(a).max()) for a in (rows, entries) if a.size), default=0)
    kind = np.float64 if 4 * rows.shape[1] * top * top < 2**53 else np.int64
    entries = entries.astype(kind)
    own = (entries * entries).sum(1)
    place, far = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), 2048):
        x = rows[at : at + 2048].astype(kind)
        apart = (x * x).sum(1)[:, None] + own - 2 * (x @ entries.T)
        place[at : at + 2048] = apart.argmin(1)
        far[at : at + 2048] = apart.min(1)
    return place, far


def _matrix(column: pa.ListArray, mask: np.ndarray, width: int) -> np.ndarray:
    flat = column.filter(pa.array(mask)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(int(mask.sum()), width)


def _judged(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with ``to``, the entry nearest to each part, and ``far``, its squared distance; nothing moves."""
    at = {c: i for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column(at["position"]).to_numpy()
            to, far = np.zeros(len(position), np.int32), np.zeros(len(position), np.int64)
            for p, book in enumerate(books):
                mask = position == p
                to[mask], far[mask] = nearest(_matrix(batch.column(at["part"]), mask, book.shape[1]), book)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(to), pa.array(far)], names=[*batch.schema.names, "to", "far"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `to` int, far long")


def _parts(kept: DataFrame, widths: list[int], low: int) -> DataFrame:
    """One row for each part of each vector; the first also carries the id and the label of the vector."""
    kind = "array<int>" if low < 2**31 else "array<long>"
    begin = np.concatenate([[0], np.cumsum(widths)]).tolist()
    cut = [F.slice("x", begin[p] + 1, widths[p]).cast(kind) for p in range(len(widths))]
    rows = kept.select("rid", "vec_id", "label", F.posexplode(F.array(*cut)).alias("position", "part"))
    first = F.col("position") == 0
    return rows.select(
        "rid", F.when(first, F.col("vec_id")).alias("vec_id"), F.when(first, F.col("label")).alias("label"), "position", "part"
    )


def _first_entries(kept: DataFrame, widths: list[int], entries: int) -> Codebooks:
    """The parts of the vectors with the least ids: at most ``entries`` rows."""
    chosen = kept.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    x = np.array([r["x"] for r in chosen], dtype=np.int64).reshape(len(chosen), sum(widths))
    return np.split(x, np.cumsum(widths)[:-1], axis=1)


def _migrated(movers: DataFrame, judged: DataFrame, tasks: int) -> DataFrame:
    """``movers`` at their new owners: the only rows of a round that are shuffled.

    The members of an entry are dealt to so many owners that each holds about a quarter of a
    task's fair share at most.
    """
    # One row for each position and entry.
    sizes = judged.groupBy("position", "to").agg(F.count(F.lit(1)).alias("n")).collect()
    fair = max(1, sum(r["n"] for r in sizes) // (4 * tasks))
    salts = [(r["position"], r["to"], -(-r["n"] // fair)) for r in sizes]
    places = judged.sparkSession.createDataFrame(salts, "position int, `to` int, salts int")
    salt = F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int")
    dealt = movers.join(F.broadcast(places), ["position", "to"])
    columns = ["rid", "vec_id", "label", "position", F.col("to").alias("entry"), salt.alias("salt"), "part"]
    return dealt.select(*columns).repartition(tasks, "position", "entry", "salt")


def _updated(residents: DataFrame, books: Codebooks) -> Codebooks:
    """Entries as the floored means of their members; those without members stay."""
    wide = max(b.shape[1] for b in books)
    sums = [F.sum(F.get("part", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(wide)]
    # At most one row for each position and entry.
    rows = residents.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    books = [b.copy() for b in books]
    for r in rows:
        book = books[r["position"]]
        book[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(book.shape[1])]
    return books


def digest(books: Codebooks) -> str:
    """sha256 of the decimal components by position, entry and place."""
    text = ",".join(str(c) for book in books for c in book.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def compress(kept: DataFrame, dims: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """``rid, vec_id, label, code, error`` of vectors of one length, and the codebooks.

    ``kept`` has ``rid`` (unique), ``vec_id``, ``label`` and ``x``, an array of ``dims`` longs. ``code`` has two
    hex digits for each part.
    """
    spark = kept.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    widths, low = part_widths(dims, parts), largest_component(dims, parts)
    kept = kept.withColumn("x", F.transform("x", lambda c: F.greatest(F.lit(-low), F.least(F.lit(low), c))))
    top = kept.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()[0] or 0
    books = _first_entries(kept, widths, entries)
    judged = written(_judged(_parts(kept, widths, top), books).drop("far"), "judged")
    for turn in range(rounds):
        stays = F.col("to") == F.col("entry") if turn else F.lit(False)
        moved = written(_migrated(judged.where(~stays), judged, tasks), "moved")
        residents = judged.where(stays).drop("to").unionByName(moved) if turn else moved
        books = _updated(residents, books)
        found = _judged(residents, books)
        read, judged = (judged, moved), written(found if turn == rounds - 1 else found.drop("far"), "judged")
        for table in read:
            discarded(table)
    digits = [
        F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("to"))))), 2, "0") for p in range(parts)
    ]
    codes = judged.groupBy("rid").agg(
        F.max("vec_id").alias("vec_id"),
        F.first("label", ignorenulls=True).alias("label"),
        F.concat(*digits).alias("code"),
        F.sum("far").alias("error"),
    )
    return codes, books


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that takes part.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; other columns are not read. Vectors that are
    null or hold null or non-finite components are left out. Components become floor(``scale`` * x); those
    beyond ``largest_component`` are cut off there. ``error`` is the squared distance of a vector from its
    entries, ``label_error`` its sum over equal labels, null labels together (null beyond a long).

    Repeated ids are rows of their own; rows without an id count as the greatest. Of equal ids the lesser
    vector comes first among the first entries. Fewer rows than ``entries`` give as many entries. Vectors
    of each length have codebooks of their own; of a length that ``parts`` does not divide, the first parts
    are longer by one. An empty vector has code zero and no error. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(as_integers(vectors, scale, "label").withColumn("rid", F.monotonically_increasing_id()), "integers")
    lengths = sorted(r["n"] for r in rows.select(F.size("x").alias("n")).distinct().collect())
    out = None
    for dims in lengths:
        codes, books = compress(rows.where(F.size("x") == dims), dims, parts, entries, rounds)
        codes = codes.withColumn("codebooks_sha256", F.lit(digest(books)))
        out = codes if out is None else out.unionByName(codes)
    if out is None:
        return _empty(spark)
    codes = written(out, "codes")
    sums = stage(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), name="llm-labels").sized()
    both = codes.join(sums.withColumnRenamed("label", "same"), F.col("label").eqNullSafe(F.col("same")))
    return both.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
