import pytest
from pyspark.sql import Row, functions as F, types as T

from records import BASE_MS, frame_of, observation
from telewin import schema
from telewin.functions import frame, record, windowed_key
from telewin.sources import payloads

def reading_of():
    return F.col("value")


def one(df, column):
    return df.select(column.alias("x")).collect()[0].x


def test_reading_widens_longs_and_keeps_doubles(spark):
    df = frame_of(
        spark,
        [
            observation(0, 1, lng=2**53 + 1),
            observation(1, 1, dbl=0.1),
            observation(2, 1),
            observation(3, 1, lng=-4),
        ],
    )
    got = [r.v for r in df.orderBy("off").select(record.numeric_value(reading_of()).alias("v")).collect()]
    assert got == [float(2**53), 0.1, None, -4.0]


@pytest.mark.parametrize("body", [None, Row(content=None)])
def test_other_branch_is_null_or_fails(spark, body):
    row = observation(0, 1)
    value = Row(timestamp=1, path="/p", rep=Row(body=body))
    df = frame_of(spark, [Row(key=row.key, value=value, part=0, off=0)])
    assert one(df, record.resource(reading_of())) is None
    assert one(df, record.ep_path(F.col("key"), reading_of())) == "a.null"
    with pytest.raises(Exception, match="single resource"):
        one(df, record.resource(reading_of(), "fail"))
    with pytest.raises(ValueError, match="on_bad"):
        record.resource(reading_of(), "ignore")


def test_names_print_missing_parts(spark):
    df = frame_of(
        spark, [observation(0, 1, ep=None, path=None), observation(1, 1, ep="x", path="/y")]
    )
    got = df.orderBy("off").select(
        record.ep_path(F.col("key"), reading_of()), record.max_path(reading_of())
    ).collect()
    assert [tuple(r) for r in got] == [("null.null", "null-max"), ("x./y", "/y-max")]


def test_paths_are_rewritten_and_other_fields_stay(spark):
    df = frame_of(spark, [observation(0, 5, lng=3)]).withColumn(
        "value",
        reading_of().withField("extra", F.lit("kept")).withField(
            "rep.body.content.unit", F.lit("C")
        ),
    )
    got = one(df, record.with_path(reading_of(), F.lit("new")))
    assert (got.path, got.extra, got.timestamp) == ("new", "kept", 5)
    assert got.rep.body.content.path == "new"
    assert got.rep.body.content.unit == "C"
    assert got.rep.body.content.value.lng == 3


def test_a_missing_resource_stays_missing(spark):
    value = Row(timestamp=1, path="/p", rep=Row(body=Row(content=None)))
    df = frame_of(spark, [Row(key=Row(ep="a"), value=value, part=0, off=0)])
    got = one(df, record.with_path(reading_of(), F.lit("new")))
    assert got.path == "new" and got.rep.body.content is None


def test_windowed_key_layout(spark):
    rows = [(bytearray(b"ab\x00c"), BASE_MS), (bytearray(b""), 0)]
    df = spark.createDataFrame(rows, "k binary, s bigint")
    data = windowed_key.encode(F.col("k"), F.col("s"))
    got = df.select(
        data.alias("d"),
        windowed_key.decode_key(data).alias("k"),
        windowed_key.decode_start_ms(data).alias("s"),
    ).collect()
    assert bytes(got[0].d) == b"ab\x00c" + BASE_MS.to_bytes(8, "big")
    assert (bytes(got[0].k), got[0].s) == (b"ab\x00c", BASE_MS)
    assert (bytes(got[1].k), got[1].s) == (b"", 0)


def test_frame(spark):
    df = spark.createDataFrame([(bytearray(b"body"), 258)], "b binary, i bigint")
    data = frame.frame(F.col("b"), F.col("i"))
    assert bytes(one(df, data)) == b"\x00\x00\x00\x01\x02body"
    assert one(df, frame.schema_id(data)) == 258
    assert bytes(one(df, frame.body(data))) == b"body"
    assert bytes(one(df, frame.frame(F.col("b"), 7))) == b"\x00\x00\x00\x00\x07body"


@pytest.mark.parametrize("data", [b"\x01\x00\x00\x00\x07x", b"\x00\x00", b""])
def test_unframed_payload(spark, data):
    df = spark.createDataFrame([(bytearray(data),)], "d binary")
    with pytest.raises(Exception, match="not framed"):
        one(df, frame.body(F.col("d")))
    assert one(df, frame.body(F.col("d"), "null")) is None
    assert one(df, frame.schema_id(F.col("d"), "null")) is None


def test_tombstone_frame_is_null(spark):
    df = spark.createDataFrame([(None,)], "d binary")
    assert one(df, frame.body(F.col("d"))) is None


READINGS = ["5", "5.0", "0.1", "1.0E300", "9007199254740993", '"on"', "true", "-7"]


@pytest.mark.parametrize("reading", READINGS)
def test_json_response_round_trip(spark, reading):
    text = (
        '{"timestamp":5,"path":"/a","rep":{"body":{"content":{"path":"/a","value":%s}}}}' % reading
    )
    df = spark.createDataFrame([(bytearray(text.encode()),)], "d binary")
    parsed = df.select(payloads.from_json_response(F.col("d")).alias("value"))
    assert payloads.reading_has_other(parsed.schema)
    assert one(parsed, payloads.to_json_response(reading_of(), has_other=True)) == text
    value = one(parsed, record.numeric_value(reading_of()))
    assert value == (None if reading in ('"on"', "true") else float(reading))


def test_json_carries_named_extra_fields(spark):
    shape = T.StructType([*payloads.OPEN_RESPONSE.fields, T.StructField("code", T.StringType())])
    df = spark.createDataFrame([('{"timestamp":1,"code":"CONTENT"}',)], "d string")
    assert one(df, payloads.from_json_response(F.col("d"), shape)).code == "CONTENT"


def test_malformed_json(spark):
    df = spark.createDataFrame([("{oops",)], "d string")
    assert one(df, payloads.from_json_response(F.col("d"))).timestamp is None
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        one(df, payloads.from_json_response(F.col("d"), on_bad="fail"))


AVRO_SHAPE = (
    "struct<timestamp:bigint,path:string,code:string,rep:struct<body:struct<"
    "member_avroreadresponsebody:struct<content:struct<"
    "member_avroresource:struct<id:int,path:string,value:struct<"
    "member_string:string,member_long:bigint,member_double:double>>,"
    "member_avroobject:struct<path:string>>>,"
    "member_other:struct<x:int>>>>"
)


def avro_value(content=None, other=None):
    read = None if content is None else Row(content=content)
    return Row(
        timestamp=1,
        path="/a",
        code="C",
        rep=Row(body=Row(member_avroreadresponsebody=read, member_other=other)),
    )


def test_avro_unions_resolve_and_go_back(spark):
    reading = Row(member_string=None, member_long=8, member_double=None)
    resource = Row(id=3, path="/a", value=reading)
    single = avro_value(Row(member_avroresource=resource, member_avroobject=None))
    several = avro_value(Row(member_avroresource=None, member_avroobject=Row(path="/o")))
    foreign = avro_value(other=Row(x=1))
    df = spark.createDataFrame(
        [(0, single), (1, several), (2, foreign)], f"i int, value {AVRO_SHAPE}"
    ).orderBy("i")
    resolved = df.withColumn("value", payloads.union_response(reading_of()))
    assert [r.v for r in resolved.select(record.numeric_value(reading_of()).alias("v")).collect()] == [
        8.0,
        None,
        None,
    ]
    marked = resolved.withColumn("value", record.with_path(reading_of(), F.lit("/a-max")))
    back = marked.select(payloads.avro_response(reading_of()).alias("value"))
    assert back.schema["value"].dataType.simpleString() == AVRO_SHAPE
    got = [r.value for r in back.collect()]
    branch = got[0].rep.body.member_avroreadresponsebody.content.member_avroresource
    assert branch == Row(id=3, path="/a-max", value=reading)
    assert (got[0].path, got[0].code) == ("/a-max", "C")
    assert got[1].rep == several.rep
    assert got[2].rep == foreign.rep


def test_key_round_trip(spark):
    df = spark.createDataFrame([Row(key=Row(ep="d1"))], "key struct<ep:string>")
    assert one(df, payloads.from_json_key(payloads.to_json_key(F.col("key")))) == Row(ep="d1")


def test_avro_needs_schemas():
    with pytest.raises(ValueError, match="at least one"):
        payloads.from_framed_avro(F, {})
    with pytest.raises(ValueError, match="reader_schema"):
        payloads.from_framed_avro(F, {1: "{}", 2: "{}"})


def test_schema_matches_accessors():
    assert schema.OBSERVATION.fieldNames() == ["key", "value", "part", "off"]


def test_malformed_keys_are_null_and_not_finite_readings_return(spark):
    from telewin.sources.payloads import from_json_key, from_json_response

    keys = spark.createDataFrame([('{"ep":"a"}',), ("{broken",), ("{}",)], "k string")
    got = [r[0] for r in keys.select(from_json_key(F.col("k"))).collect()]
    assert [None if k is None else k.ep for k in got] == ["a", None, None]
    assert got[1] is None
    body = '{"timestamp":1,"path":"/p","rep":{"body":{"content":{"path":"/p","value":%s}}}}'
    texts = [body % v for v in ('"NaN"', '"Infinity"', '"-Infinity"', "1.5", '"on"')]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(from_json_response(F.col("v")).alias("v"))
    values = [str(r[0]) for r in rows.select("v.rep.body.content.value.dbl").collect()]
    assert values == ["nan", "inf", "-inf", "1.5", "None"]


@pytest.mark.parametrize(
    "name,want", [("acks", "kafka.acks"), ("retries", "kafka.retries"), ("maxOffsetsPerTrigger", "maxOffsetsPerTrigger")]
)
def test_client_properties_reach_the_client(name, want):
    from telewin.sources.options import client_option

    assert client_option(name) == want
