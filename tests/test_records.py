import pytest
from pyspark.sql import Row, functions as F

from records import BASE_MS, frame_of, observation, pairs, valid
from telewin import schema
from telewin.operators.counts import count_both_levels, count_by_window
from telewin.operators.records import mark_max, rekey_by_resource, valid_records
from telewin.operators.windows import END, HALF_MINUTE_MS, MINUTE_MS, START, assign_window


def bad_rows():
    good = observation(0, BASE_MS)
    return [
        good,
        Row(key=None, value=good.value, part=0, off=1),
        observation(2, -1),
        observation(3, 0),
        observation(4, BASE_MS, path=None),
        observation(5, BASE_MS, ep=None),
        observation(6, None),
    ]


def test_only_missing_keys_and_negative_times_are_dropped(spark):
    assert {r.off for r in valid(spark, bad_rows()).collect()} == {0, 3, 4, 5}


def test_tombstone_is_dropped_or_fails(spark):
    rows = [observation(0, BASE_MS), Row(key=Row(ep="a"), value=None, part=0, off=1)]
    df = spark.createDataFrame(rows, schema.OBSERVATION)
    assert [r.off for r in valid_records(df).collect()] == [0]
    with pytest.raises(Exception, match="no value"):
        valid_records(df, "fail").collect()
    with pytest.raises(Exception, match="no value"):
        count_by_window(valid_records(df, "fail")).collect()
    with pytest.raises(ValueError, match="on_bad"):
        valid_records(df, "null")


def test_event_time_is_the_payload_time(spark):
    got = valid(spark, [observation(0, BASE_MS + 123)]).select(
        "ts_ms", F.unix_micros("event_time")
    )
    assert tuple(got.collect()[0]) == (BASE_MS + 123, (BASE_MS + 123) * 1000)


@pytest.mark.parametrize("size", [MINUTE_MS, HALF_MINUTE_MS])
def test_windows_are_half_open(spark, size):
    rows = [observation(i, BASE_MS + ms) for i, ms in enumerate([0, size - 1, size])]
    got = assign_window(valid(spark, rows), size)
    assert pairs(got, "off", START, END) == {
        (0, BASE_MS, BASE_MS + size),
        (1, BASE_MS, BASE_MS + size),
        (2, BASE_MS + size, BASE_MS + 2 * size),
    }


def test_counts_group_by_the_whole_key(spark):
    rows = frame_of(spark, [observation(i, BASE_MS) for i in range(4)])
    site = F.when(F.col("off") < 3, "north").otherwise("south")
    obs = valid_records(rows.withColumn("key", F.col("key").withField("site", site)))
    counted = pairs(count_by_window(obs), "key.ep", "key.site", "n")
    assert counted == {("a", "north", 3), ("a", "south", 1)}
    by_resource = pairs(count_by_window(rekey_by_resource(obs)), "key.ep", "key.site", "n")
    assert by_resource == {("a./p", "north", 3), ("a./p", "south", 1)}


def test_equal_names_of_different_pairs_are_one_key(spark):
    rows = [
        observation(0, BASE_MS, ep="a.b", path="c"),
        observation(1, BASE_MS, ep="a", path="b.c"),
    ]
    obs = valid(spark, rows)
    assert pairs(count_by_window(rekey_by_resource(obs)), "key.ep", "n") == {("a.b.c", 2)}
    both = pairs(count_both_levels(obs), "level", "key.ep", "n")
    assert both == {("ep_path", "a.b.c", 2), ("ep", "a", 1), ("ep", "a.b", 1)}


def test_both_levels_equal_the_two_counts(spark):
    rows = [
        observation(i, BASE_MS + i * 999, ep=f"d{i % 3}", path=f"/{i % 5}") for i in range(300)
    ]
    obs = valid(spark, rows)
    both = count_both_levels(obs)
    for level, counted in (
        ("ep", count_by_window(obs)),
        ("ep_path", count_by_window(rekey_by_resource(obs))),
    ):
        columns = ["key.ep", START, END, "n"]
        assert pairs(both.where(F.col("level") == level), *columns) == pairs(counted, *columns)


def test_mark_max_uses_the_resource_path(spark):
    df = frame_of(spark, [observation(0, BASE_MS)]).withColumn(
        "value", F.col("value").withField("path", F.lit("/response"))
    )
    got = mark_max(valid_records(df)).collect()[0].value
    assert (got.path, got.rep.body.content.path) == ("/p-max", "/p-max")
