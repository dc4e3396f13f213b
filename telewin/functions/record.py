"""Column expressions over one observation record."""

from pyspark.sql import Column, functions as F

RESOURCE_FIELD = "rep.body.content"

ON_BAD = ("null", "fail")


def _checked(found: Column, bad: Column, message: str, on_bad: str) -> Column:
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}, not {on_bad!r}")
    if on_bad == "null":
        return found
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(found)


def text(col: Column) -> Column:
    """The column as text, with a missing value spelled ``null``."""
    return F.coalesce(col.cast("string"), F.lit("null"))


def resource(value: Column, on_bad: str = "null") -> Column:
    """The single resource a response carries; null on any other union branch."""
    found = value.getField("rep").getField("body").getField("content")
    return _checked(found, found.isNull(), "response does not carry a single resource", on_bad)


def resource_path(value: Column, on_bad: str = "null") -> Column:
    return resource(value, on_bad).getField("path")


def numeric_value(value: Column, on_bad: str = "null") -> Column:
    """The reading as a double: longs widened, doubles as they are."""
    reading = resource(value, on_bad).getField("value")
    number = F.coalesce(reading.getField("lng").cast("double"), reading.getField("dbl"))
    return _checked(number, number.isNull(), "reading is neither a long nor a double", on_bad)


def timestamp_ms(value: Column, on_bad: str = "null") -> Column:
    """Event time from the payload; a missing payload is the caller's to drop or fail on."""
    return _checked(value.getField("timestamp"), value.isNull(), "record has no value", on_bad)


def ep_path(key: Column, value: Column, on_bad: str = "null") -> Column:
    """``<device>.<resource path>``; a missing part prints as ``null``."""
    return F.concat(
        text(key.getField("ep")), F.lit("."), text(resource_path(value, on_bad))
    )


def max_path(value: Column, on_bad: str = "null") -> Column:
    """``<resource path>-max``."""
    return F.concat(text(resource_path(value, on_bad)), F.lit("-max"))


def with_path(value: Column, path: Column) -> Column:
    """Rewrite both paths of a response, keeping every other field."""
    return value.withField("path", path).withField(f"{RESOURCE_FIELD}.path", path)
