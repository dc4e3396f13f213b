"""Binary form of a windowed key: key bytes followed by the window start.

The start is epoch milliseconds as 8 big-endian bytes. The end is not stored;
a reader adds the window size it knows.
"""

from pyspark.sql import Column, functions as F

START_BYTES = 8


def long_bytes(number: Column, width: int = START_BYTES) -> Column:
    """A non-negative long as ``width`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def bytes_long(data: Column) -> Column:
    """Big-endian bytes as a long."""
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def encode(key_bytes: Column, window_start_ms: Column) -> Column:
    return F.concat(key_bytes, long_bytes(window_start_ms))


def decode_key(data: Column) -> Column:
    return F.substring(data, F.lit(1), F.length(data) - START_BYTES)


def decode_start_ms(data: Column) -> Column:
    return bytes_long(F.substring(data, F.length(data) - (START_BYTES - 1), F.lit(START_BYTES)))
