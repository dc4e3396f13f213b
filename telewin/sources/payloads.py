"""Turn payload bytes into record structs and back.

Avro needs Spark's separate Avro module on the class path and the schema text
from the caller. JSON needs neither.
"""

from collections.abc import Mapping

from pyspark.sql import Column, functions as F, types as T

from telewin import schema
from telewin.functions import frame, record
from telewin.functions.bound import bound

# Branch names Spark gives to Avro union members under this option.
AVRO_OPTIONS = {"enableStableIdentifiersForUnionType": "true"}


def from_framed_avro(
    data: Column, schemas: Mapping[int, str], reader_schema: str | None = None
) -> Column:
    """Decode registry-framed Avro, picking the writer schema by the id in the frame.

    An id without a schema fails the query, as an unreadable record does.
    With more than one writer schema, ``reader_schema`` is the common shape.
    """
    from pyspark.sql.avro.functions import from_avro

    if not schemas:
        raise ValueError("at least one writer schema is needed")
    if len(schemas) > 1 and reader_schema is None:
        raise ValueError("several writer schemas need a reader_schema")
    options = dict(AVRO_OPTIONS)
    if reader_schema is not None:
        options["avroSchema"] = reader_schema
    number = frame.schema_id(data)
    decoded = None
    for known, text in schemas.items():
        body = from_avro(frame.body(data), text, options)
        decoded = F.when(number == known, body) if decoded is None else decoded.when(
            number == known, body
        )
    return decoded.when(
        data.isNotNull(), F.raise_error(F.format_string("no schema for id %s", number))
    )


def to_framed_avro(value: Column, schema_id: int, schema_text: str) -> Column:
    from pyspark.sql.avro.functions import to_avro

    return frame.frame(to_avro(value, schema_text), schema_id)


def union_reading(
    union: Column, lng: str = "member_long", dbl: str = "member_double"
) -> Column:
    """The two numeric branches of a decoded union as the ``lng``/``dbl`` struct."""
    return F.struct(
        union.getField(lng).cast("bigint").alias("lng"),
        union.getField(dbl).cast("double").alias("dbl"),
    )


# Union branches a response is read from, as the reader names them.
READ_BRANCH = "member_avroreadresponsebody"
RESOURCE_BRANCH = "member_avroresource"


def union_response(
    value: Column, read: str = READ_BRANCH, resource: str = RESOURCE_BRANCH
) -> Column:
    """A decoded Avro response with the resource it carries added as ``rep.body.content``.

    Records on other branches get a null content. All decoded fields stay.
    """
    branch = value.getField("rep").getField("body").getField(read)
    found = branch.getField("content").getField(resource)
    content = F.when(
        found.isNotNull(), found.withField("value", union_reading(found.getField("value")))
    )
    return value.withField("rep.body.content", content)


def avro_response(
    value: Column, read: str = READ_BRANCH, resource: str = RESOURCE_BRANCH
) -> Column:
    """Back to the decoded shape, with the resource's current path in its branch."""
    body = value.getField("rep").getField("body")
    path = body.getField("content").getField("path")
    return value.withField(
        "rep.body",
        body.withField(f"{read}.content.{resource}.path", path).dropFields("content"),
    )


# The response shape with the reading left open: JSON spells both numeric
# branches as a bare number.
OPEN_RESPONSE = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField(
            "rep",
            T.StructType(
                [
                    T.StructField(
                        "body",
                        T.StructType(
                            [
                                T.StructField(
                                    "content",
                                    T.StructType(
                                        [
                                            T.StructField("path", T.StringType()),
                                            T.StructField("value", T.VariantType()),
                                        ]
                                    ),
                                )
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)


NOT_FINITE = ("NaN", "Infinity", "-Infinity")
_CORRUPT = "_corrupt"


def _json_mode(on_bad: str) -> dict[str, str]:
    return {"mode": "FAILFAST" if on_bad == "fail" else "PERMISSIVE"}


def split_number(number: Column) -> Column:
    """A JSON value as ``lng`` (whole numbers) or ``dbl``; any other value is kept as ``other``."""

    def split(kind: Column) -> Column:
        whole = kind == "BIGINT"
        # JSON has no spelling for NaN and infinities; they are written as these texts.
        odd = (kind == "STRING") & F.try_variant_get(number, "$", "string").isin(*NOT_FINITE)
        odd = F.coalesce(odd, F.lit(False))
        real = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT") | odd
        return F.struct(
            F.when(whole, F.try_variant_get(number, "$", "bigint")).alias("lng"),
            F.when(odd, F.try_variant_get(number, "$", "string").try_cast("double"))
            .when(real, F.try_variant_get(number, "$", "double"))
            .alias("dbl"),
            F.when(~whole & ~real, number).alias("other"),
        )

    return bound(F.schema_of_variant(number), split)


def from_json_response(
    data: Column, shape: T.StructType = OPEN_RESPONSE, on_bad: str = "null"
) -> Column:
    """Decode a JSON response. Malformed text gives null fields or fails the query.

    ``shape`` may name further fields to carry along.
    """

    def with_reading(parsed: Column) -> Column:
        number = parsed.getField("rep").getField("body").getField("content").getField("value")
        return parsed.withField(f"{record.RESOURCE_FIELD}.value", split_number(number))

    return bound(F.from_json(data.cast("string"), shape, _json_mode(on_bad)), with_reading)


def to_json_response(value: Column, has_other: bool = False) -> Column:
    """Encode a response as JSON, the reading as a bare value.

    ``has_other`` tells that readings carry the ``other`` member of ``split_number``.
    """
    reading = record.resource(value).getField("value")
    branches = [reading.getField("lng").cast("variant"), reading.getField("dbl").cast("variant")]
    if has_other:
        branches.append(reading.getField("other"))
    return F.to_json(value.withField(f"{record.RESOURCE_FIELD}.value", F.coalesce(*branches)))


def reading_has_other(df_schema: T.StructType, column: str = "value") -> bool:
    """Whether a frame's readings keep values that are not numbers."""
    shape = df_schema[column].dataType
    for name in [*record.RESOURCE_FIELD.split("."), "value"]:
        shape = shape[name].dataType
    return "other" in shape.names


def from_json_key(
    data: Column, shape: T.StructType = schema.KEY, on_bad: str = "null"
) -> Column:
    """Decode a JSON key. Malformed text gives a null key, which is no device, or fails the query."""
    if on_bad == "fail":
        return F.from_json(data.cast("string"), shape, _json_mode(on_bad))
    watched = T.StructType([*shape.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {**_json_mode(on_bad), "columnNameOfCorruptRecord": _CORRUPT}
    return bound(
        F.from_json(data.cast("string"), watched, options),
        lambda parsed: F.when(parsed.getField(_CORRUPT).isNull(), parsed.dropFields(_CORRUPT)),
    )


def to_json_key(key: Column) -> Column:
    return F.to_json(key).cast("binary")
