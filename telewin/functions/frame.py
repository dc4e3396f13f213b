"""Schema-registry framing of a payload: one zero byte, a 4-byte id, the body."""

from pyspark.sql import Column, functions as F

from telewin.functions.windowed_key import bytes_long, long_bytes

# Fixed values of the wire format.
MAGIC = "00"
ID_BYTES = 4
BODY_START = 6


def is_framed(data: Column) -> Column:
    return (F.length(data) >= BODY_START - 1) & (F.hex(F.substring(data, 1, 1)) == MAGIC)


def _framed_only(data: Column, found: Column, on_bad: str) -> Column:
    if on_bad == "null":
        return F.when(is_framed(data), found)
    if on_bad == "fail":
        return F.when(
            data.isNotNull() & ~is_framed(data), F.raise_error(F.lit("payload is not framed"))
        ).otherwise(found)
    raise ValueError(f"on_bad must be 'null' or 'fail', not {on_bad!r}")


def schema_id(data: Column, on_bad: str = "fail") -> Column:
    return _framed_only(data, bytes_long(F.substring(data, 2, ID_BYTES)), on_bad)


def body(data: Column, on_bad: str = "fail") -> Column:
    return _framed_only(data, F.substring(data, F.lit(BODY_START), F.length(data)), on_bad)


def frame(payload: Column, schema: Column | int) -> Column:
    number = schema if isinstance(schema, Column) else F.lit(schema)
    return F.concat(F.unhex(F.lit(MAGIC)), long_bytes(number, ID_BYTES), payload)
