"""What the plans must look like to hold on large and skewed data."""

import pytest

from telewin.plans.catalog import QUERIES, SLICES, run_in_slices, valid
from telewin.sources.tables import read_events
from telewin.streaming.topics import read_topic_rows, topic_rows
from telewin.plans.window_max import window_max

SF_DIR = "/root/testdata/sf0.001"
BATCH = [n for n in QUERIES if not n.startswith(("stream_", "compacted_", "store_", "publish_max"))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan):
    schemas = [part.split(">", 1)[0] for part in plan.split("ReadSchema: struct<")[1:]]
    return [{field.split(":")[0] for field in s.split(",") if field} for s in schemas]


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, old)


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for bad in ("Python", "Pandas", "Cartesian", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in plan


@pytest.mark.parametrize(
    "name,columns",
    [
        ("count_by_ep_1m", {"ts", "user_id"}),
        ("count_by_ep_path_1m", {"ts", "user_id", "event_type"}),
        ("count_both_levels_1m", {"ts", "user_id", "event_type"}),
        ("tumbling_assign_1m", {"event_id", "ts"}),
        ("event_time_extract", {"event_id", "ts"}),
        ("updates_count_by_ep_1m", {"event_id", "ts", "user_id"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    assert all(c == columns for c in read_columns(plan_of(QUERIES[name](spark, SF_DIR))))


def test_late_check_reads_no_payload(spark):
    plan = plan_of(QUERIES["late_count_by_ep_1m"](spark, SF_DIR))
    for columns in read_columns(plan):
        assert not columns & {"props", "value", "event_type"}


@pytest.mark.parametrize(
    "name,partial",
    [
        ("count_by_ep_1m", "partial_count"),
        ("count_by_ep_path_1m", "partial_count"),
        ("count_both_levels_1m", "partial_count"),
        ("max_by_ep_path_30s", "partial_max_by"),
    ],
)
def test_groups_are_reduced_before_the_one_shuffle(spark, name, partial):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") < plan.index(partial)


@pytest.mark.parametrize(
    "name",
    [
        "updates_count_by_ep_1m",
        "updates_count_by_ep_path_1m",
        "updates_max_by_ep_path_30s",
        "updates_max_by_ep_path_30s_nan_replay",
    ],
)
def test_running_rows_are_shuffled_once(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    above, below = plan.split("SortMergeJoin", 1)
    second_side = "\n" + " " * len(above.rsplit("\n", 1)[1]) + "+- "
    rows, carry = below.split("+- Window", 1)[1].split(second_side, 1)
    assert rows.count("Exchange") == 1
    # Every shuffle that carries rows has the chunk in its key.
    assert "_chunk" in rows.split("Exchange hashpartitioning(", 1)[1].split(")", 1)[0]
    assert "partial_" in carry


def test_counts_of_a_log_without_late_records_are_not_shuffled_for_the_check(spark):
    from telewin.operators.late import drop_late

    plan = plan_of(drop_late(valid(spark, SF_DIR)))
    assert "Exchange" not in plan and "Join" not in plan


def test_publishing_adds_no_shuffle(spark):
    winners = window_max(valid(spark, SF_DIR))
    assert plan_of(topic_rows(winners, "out", 8)).count("Exchange") == plan_of(winners).count(
        "Exchange"
    )


def test_published_rows_are_parsed_once(spark):
    rows = spark.createDataFrame([], "key binary, value binary")
    assert plan_of(read_topic_rows(rows, 30_000)).count("from_json(") == 2


def test_slices_of_the_log_are_dealt_over_tasks(spark, tmp_path):
    """One input file makes one reading task; a slice of it has as many files as there are shuffle partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        run_in_slices(spark, SF_DIR, f"{tmp_path}", lambda events: [])
    finally:
        spark.conf.set(name, old)
    log, events = spark.read.parquet(f"{tmp_path}/log"), read_events(spark, SF_DIR)
    per_file = log.groupBy(log["_metadata.file_path"]).count().collect()
    assert len(per_file) == SLICES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in per_file) < log.count() / SLICES / 2
    assert sorted(log.collect()) == sorted(events.collect())
