"""The two jobs from topic rows to topic rows, and their settings."""

import pytest
from pyspark.sql import Row, functions as F

from records import BASE_MS, frame_of, observation, pairs
from telewin.app import parse
from telewin.operators.compaction import latest
from telewin.operators.records import valid_records
from telewin.operators.windows import END, HALF_MINUTE_MS, MINUTE_MS, START
from telewin.plans import device_counts, window_max
from telewin.plans.source import decoded, with_properties
from telewin.settings import CountSettings, MaxSettings
from telewin.sources.options import overlay, properties_file
from telewin.sources.payloads import to_json_key, to_json_response
from telewin.sources.topics import read_topic, topic_options
from telewin.streaming.run import finish
from telewin.streaming.tables import read_updates, to_table, write_batch
from telewin.streaming.topics import read_topic_rows, topic_rows
from telewin.workspace import job_checkpoint, shared_base, stage, work_dir


def topic_of(spark, rows):
    """Observations the way a topic delivers them."""
    return frame_of(spark, rows).select(
        to_json_key(F.col("key")).alias("key"),
        to_json_response(F.col("value")).cast("binary").alias("value"),
        F.lit("in").alias("topic"),
        F.col("part").alias("partition"),
        F.col("off").alias("offset"),
    )


ROWS = [
    observation(0, BASE_MS, lng=5),
    observation(1, BASE_MS + 10, dbl=7.5),
    observation(2, BASE_MS + 20, lng=7),
    observation(3, BASE_MS + HALF_MINUTE_MS, lng=1),
    observation(4, BASE_MS, ep="b", path="/q", lng=2),
]


def test_max_job_from_topic_to_topic(spark, tmp_path):
    topic_of(spark, ROWS).write.parquet(f"{tmp_path}/in")
    settings = MaxSettings(checkpoint=f"{tmp_path}/cp", output_partitions=3)
    records = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(
        f"{tmp_path}/in"
    )
    winners = window_max.window_max(valid_records(decoded(records, settings)))
    out = window_max.output_rows(winners, settings)
    assert out.columns == ["key", "value", "topic", "partition"]
    finish(to_table(out, f"{tmp_path}/out", "job", f"{tmp_path}/cp", available_now=True), 120)
    published = latest(read_updates(spark, f"{tmp_path}/out"), ("key",))
    got = pairs(
        read_topic_rows(published, HALF_MINUTE_MS),
        "key.ep", START, END, "value.timestamp", "value.path", "topic",
    )
    second = BASE_MS + HALF_MINUTE_MS
    topic = settings.output_topic
    assert got == {
        ("a./p", BASE_MS, second, BASE_MS + 10, "/p-max", topic),
        ("a./p", second, second + HALF_MINUTE_MS, second, "/p-max", topic),
        ("b./q", BASE_MS, second, BASE_MS, "/q-max", topic),
    }


def test_published_text_keeps_the_whole_record(spark):
    obs = valid_records(decoded(topic_of(spark, ROWS[:1]), MaxSettings(checkpoint="x")))
    row = topic_rows(window_max.window_max(obs), "out").collect()[0]
    assert bytes(row.key) == b'{"ep":"a./p"}' + BASE_MS.to_bytes(8, "big")
    assert bytes(row.value).decode() == (
        '{"timestamp":%d,"path":"/p-max","rep":{"body":{"content":'
        '{"path":"/p-max","value":5}}}}' % BASE_MS
    )


def test_readings_that_are_not_numbers_are_published_too(spark):
    records = topic_of(spark, ROWS[:1]).withColumn(
        "value",
        F.lit(
            '{"timestamp":%d,"rep":{"body":{"content":{"path":"/s","value":"on"}}}}' % BASE_MS
        ).cast("binary"),
    )
    obs = valid_records(decoded(records, MaxSettings(checkpoint="x")))
    row = topic_rows(window_max.window_max(obs), "out").collect()[0]
    assert '"value":"on"' in bytes(row.value).decode()


def test_windows_of_a_key_share_a_partition(spark):
    rows = [
        observation(i, BASE_MS + i * HALF_MINUTE_MS // 2, ep=f"d{i % 7}", lng=i) for i in range(200)
    ]
    winners = window_max.window_max(valid_records(frame_of(spark, rows)))
    out = read_topic_rows(topic_rows(winners, "out", 5), HALF_MINUTE_MS)
    per_key = out.groupBy("key").agg(
        F.count_distinct("partition").alias("p"), F.count(F.lit(1)).alias("n")
    )
    assert {(r.p, r.n > 1) for r in per_key.collect()} == {(1, True)}
    assert all(0 <= r.partition < 5 for r in out.collect())


def test_count_job_from_topic(spark):
    settings = CountSettings(checkpoint="x")
    obs = valid_records(decoded(topic_of(spark, ROWS), settings))
    assert pairs(device_counts.per_device(obs, settings.window_ms), "key.ep", "n") == {
        ("a", 4),
        ("b", 1),
    }
    assert pairs(device_counts.per_resource(obs, settings.window_ms), "key.ep", "n") == {
        ("a./p", 4),
        ("b./q", 1),
    }


@pytest.mark.parametrize("one_read,names", [(True, {"both"}), (False, {"ep", "ep-path"})])
def test_count_job_results(spark, one_read, names):
    settings = CountSettings(checkpoint="x", one_read=one_read)
    obs = valid_records(decoded(topic_of(spark, ROWS), settings))
    results = device_counts.results(obs, settings)
    assert set(results) == names
    rows = set().union(*(pairs(r, "key.ep", "n") for r in results.values()))
    assert rows == {("a", 4), ("b", 1), ("a./p", 4), ("b./q", 1)}


@pytest.mark.parametrize("one_read", [True, False])
def test_count_job_can_fail_on_other_branches(spark, one_read):
    settings = CountSettings(checkpoint="x", one_read=one_read, on_bad="fail")
    records = topic_of(spark, ROWS[:1]).withColumn(
        "value", F.lit('{"timestamp":%d,"rep":{"body":null}}' % BASE_MS).cast("binary")
    )
    obs = valid_records(decoded(records, settings), settings.on_bad)
    with pytest.raises(Exception, match="single resource"):
        for counted in device_counts.results(obs, settings).values():
            counted.collect()


def test_defaults():
    count, best = CountSettings(checkpoint="c"), MaxSettings(checkpoint="c")
    assert count.brokers == best.brokers == "localhost:9092"
    assert count.topic == best.topic == "iot.server1.observations"
    assert best.output_topic == "analytics.server1.observations.maxper30sec"
    assert (count.window_ms, best.window_ms) == (MINUTE_MS, HALF_MINUTE_MS)
    assert count.cadence == best.cadence == "10 seconds"
    assert count.name != best.name


def test_a_properties_file_is_read_like_java_reads_it(spark, tmp_path):
    path = tmp_path / "client.properties"
    path.write_text("# comment\nsecurity.protocol = SSL\nssl.key.password:a\\\n  b=c\nplain\nname=\\u00e9\n", "latin-1")
    found = properties_file(spark, str(path))
    assert found == {"security.protocol": "SSL", "ssl.key.password": "ab=c", "plain": "", "name": "\u00e9"}
    assert properties_file(spark, f"file://{tmp_path}/none.properties") == {}
    settings = MaxSettings(properties=str(path), options={"plain": "mine", "topic": "t"})
    whole = with_properties(spark, settings)
    assert whole.options == {**found, "plain": "mine", "topic": "t"} and whole.properties is None
    assert with_properties(spark, MaxSettings()) == MaxSettings()
    options = topic_options("b:1", "in", whole.options)
    assert options["kafka.security.protocol"] == "SSL" and options["kafka.plain"] == "mine"


def test_overlay_wins_and_may_be_absent():
    assert topic_options("b:1", "t") == {
        "kafka.bootstrap.servers": "b:1",
        "subscribe": "t",
        "startingOffsets": "earliest",
    }
    got = topic_options(
        "b:1",
        "t",
        {
            "startingOffsets": "latest",
            "security.protocol": "SSL",
            "ssl.truststore.location": "/ts",
            "sasl.mechanism": "PLAIN",
            "kafka.ssl.key.password": "x",
            "maxOffsetsPerTrigger": 1000,
            "request.timeout.ms": 5000,
            "fetchOffset.numRetries": 4,
        },
    )
    assert got == {
        "kafka.bootstrap.servers": "b:1",
        "subscribe": "t",
        "startingOffsets": "latest",
        "kafka.security.protocol": "SSL",
        "kafka.ssl.truststore.location": "/ts",
        "kafka.sasl.mechanism": "PLAIN",
        "kafka.ssl.key.password": "x",
        "maxOffsetsPerTrigger": "1000",
        "kafka.request.timeout.ms": "5000",
        "fetchOffset.numRetries": "4",
    }
    moved = topic_options("b:1", "t", {"bootstrap.servers": "c:2"})
    assert moved["kafka.bootstrap.servers"] == "c:2"
    assert overlay({"a": "1"}, None) == {"a": "1"}
    assert overlay({"a": "1"}, {"a": "2"}) == {"a": "2"}


@pytest.mark.parametrize("streaming", [True, False])
def test_a_missing_connector_is_named(spark, streaming):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_topic(spark, "localhost:9092", "t", streaming=streaming)


class Session:
    """The parts of a session that name the shared folder."""

    def __init__(self, master, setting=None, checkpoint_dir=None):
        self.master, self.folder, self.setting = master, checkpoint_dir, setting
        self.conf = self.sparkContext = self

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_work_goes_to_the_folder_the_session_names():
    session = Session("yarn", "hdfs://n/shared/", "hdfs://other")
    first, second = work_dir(session, "x"), work_dir(session, "x")
    assert first.startswith("hdfs://n/shared/x-") and first != second
    assert work_dir(Session("yarn", None, "hdfs://set"), "x").startswith("hdfs://set/x-")


def test_a_job_returns_to_its_checkpoint():
    session = Session("yarn", "hdfs://n/shared")
    assert job_checkpoint(session, None, "job") == "hdfs://n/shared/job"
    assert job_checkpoint(session, "s3a://b/cp/", "job") == "s3a://b/cp/job"
    with pytest.raises(ValueError, match="checkpoint"):
        job_checkpoint(Session("local[2]"), None, "job")


def test_max_job_asks_for_the_output_partitions(spark):
    with pytest.raises(ValueError, match="output_partitions"):
        window_max.start(spark, MaxSettings(checkpoint="x"))


def test_a_new_checkpoint_refuses_the_table_of_another_run(spark, tmp_path):
    path = f"{tmp_path}/table"
    for batch_id in (0, 0, 1):
        write_batch(spark.range(2), path, batch_id)
    with pytest.raises(ValueError, match="another run"):
        write_batch(spark.range(2), path, 0)


def test_positional_arguments_and_their_defaults():
    assert parse(["counts"]) == ("counts", CountSettings())
    assert parse(["max"]) == ("max", MaxSettings())
    job, settings = parse(
        ["max", "b:1", "in", "out", "/cp", "--option", "ssl.key.password=a=b",
         "--option", "maxOffsetsPerTrigger=10"]
    )
    assert job == "max"
    assert settings == MaxSettings(
        checkpoint="/cp",
        brokers="b:1",
        topic="in",
        output_topic="out",
        options={"ssl.key.password": "a=b", "maxOffsetsPerTrigger": "10"},
    )
    with pytest.raises(SystemExit):
        parse(["max", "--option", "nothing"])


def test_schema_files(tmp_path):
    for name in ("key", "value", "out"):
        (tmp_path / name).write_text(f'"{name}"')
    _, settings = parse(
        ["max", "--key-schema", f"3={tmp_path}/key", "--value-schema", f"7={tmp_path}/value",
         "--output-value-schema", f"9={tmp_path}/out", "--output-partitions", "16"]
    )
    assert settings.key_schemas == {3: '"key"'}
    assert settings.value_schemas == {7: '"value"'}
    assert settings.output_value_schema == (9, '"out"')
    assert settings.output_partitions == 16


def test_only_a_local_master_may_use_a_temporary_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_base(Session("spark://host:7077"))
    session = Session("local[2]")
    assert shared_base(session) == shared_base(session) == session.folder


def test_staged_tables_keep_rows_and_types(spark):
    df = spark.createDataFrame([Row(a=1, b=Row(c="x"))])
    staged = stage(df)
    assert staged.count == 1
    assert staged.rows.schema.simpleString() == df.schema.simpleString()
    assert staged.rows.collect() == df.collect()
    assert "FileScan" in staged.rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "size,join",
    [
        ({"count": 1}, "BroadcastHashJoin"),
        ({"count": 10**9}, "SortMergeJoin"),
        ({"bytes": 10**9}, "SortMergeJoin"),
    ],
)
def test_only_counted_small_tables_are_broadcast(spark, size, join):
    staged = stage(spark.range(5))._replace(**size)
    assert stage(spark.range(5)).bytes > 0
    joined = spark.range(100).join(staged.sized(), "id")
    assert join in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 5
