"""Running aggregates over arrival order without putting a whole key in one task.

A key's records are cut into chunks of consecutive arrival offsets. Each chunk
is scanned on its own, and what the earlier chunks of the key amount to is
worked out from one pre-aggregated row per chunk. The largest sort is one
chunk, however many rows the key has.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CHUNK = "_chunk"
# Offsets per chunk. Offsets are unique in a source partition, which bounds the
# rows of a chunk; at a trillion rows the chunk table has some 15 million.
CHUNK_OFFSETS = 1 << 16

# Arrival order: the offset, and the source partition where two keys meet.
ARRIVAL = ("off", "part")


def with_chunk(obs: DataFrame, chunk_offsets: int = CHUNK_OFFSETS, by: str = "off") -> DataFrame:
    """Cut the log every ``chunk_offsets`` steps of the column that orders arrivals."""
    return obs.withColumn(CHUNK, F.call_function("div", F.col(by), F.lit(chunk_offsets)))


def arrival() -> Column:
    return F.struct(*ARRIVAL)


def up_to_here(by: Sequence[str], order: Sequence[str] = ARRIVAL) -> WindowSpec:
    """The records of a chunk up to the current one."""
    return (
        Window.partitionBy(*by, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def earlier_chunks(by: Sequence[str]) -> WindowSpec:
    """The chunk rows of a key before the current chunk."""
    return Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def join_carry(scanned: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach what came before a chunk; the first chunk of a key has no carry.

    The scan left the records partitioned and sorted by ``by`` and the chunk, so
    only the small carry side moves.
    """
    return scanned.join(carry, [*by, CHUNK], "left")
