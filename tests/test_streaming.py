import math
import os
import random
import uuid

import pytest
from pyspark.sql import Row, functions as F

from records import (
    BASE_MS,
    fold_steps,
    frame_of,
    late_offsets,
    observation,
    pairs,
    random_observations,
    valid,
)
from telewin import schema
from telewin.operators.compaction import latest
from telewin.operators.counts import count_by_window
from telewin.operators.maxima import max_by_window
from telewin.operators.records import rekey_by_resource, valid_records
from telewin.operators.windows import (
    END,
    HALF_MINUTE_MS,
    MINUTE_MS,
    START,
    grace_ms,
    with_retention,
)
from telewin.plans import device_counts, window_max
from telewin.streaming import ledger
from telewin.streaming.run import finish, to_console, use_stream_settings
from telewin.streaming.tables import read_latest, read_updates, to_table, write_batch


class Log:
    """A folder of observation files, read in the order they were added."""

    def __init__(self, spark, path):
        self.spark, self.path, self.files = spark, str(path), 0
        os.makedirs(self.path, exist_ok=True)

    def add(self, rows):
        """Add one file whose time stamp is after all earlier ones."""
        before = set(os.listdir(self.path))
        frame_of(self.spark, rows).coalesce(1).write.mode("append").parquet(self.path)
        self.files += 1
        for name in set(os.listdir(self.path)) - before:
            if name.endswith(".parquet"):
                stamp = 1_700_000_000 + self.files
                os.utime(f"{self.path}/{name}", (stamp, stamp))

    def stream(self, files=1):
        rows = (
            self.spark.readStream.schema(schema.OBSERVATION)
            .option("maxFilesPerTrigger", files)
            .parquet(self.path)
        )
        return valid_records(rows)


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path / "log")


def run(query):
    finish(query, 120)
    return query


def table_of(df, base, name="t"):
    path = f"{base}/{name}"
    run(to_table(df, path, f"{name}-{uuid.uuid4().hex}", f"{base}/{name}-cp", available_now=True))
    return path


def in_pieces(rows, n):
    size = math.ceil(len(rows) / n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


COUNT = ("key.ep", START, END, "n")
BEST = ("key.ep", START, END, "off", "value.path")


@pytest.mark.parametrize("files", [1, 2])
def test_stream_equals_batch(spark, log, tmp_path, files):
    rows = random_observations(21, n=600, missing=0.05)
    for piece in in_pieces(rows, 5):
        log.add(piece)
    obs = valid(spark, rows)
    stream = log.stream(files)

    counts = table_of(device_counts.per_device(stream), tmp_path, "ep")
    assert pairs(read_latest(spark, counts), *COUNT) == pairs(device_counts.per_device(obs), *COUNT)
    assert read_updates(spark, counts).select("batch_id").distinct().count() >= 5 // files

    paths = table_of(device_counts.per_resource(stream), tmp_path, "path")
    assert pairs(read_latest(spark, paths), *COUNT) == pairs(
        device_counts.per_resource(obs), *COUNT
    )
    best = table_of(window_max.window_max(stream), tmp_path, "max")
    assert pairs(read_latest(spark, best), *BEST) == pairs(window_max.window_max(obs), *BEST)


def test_a_trigger_updates_a_key_at_most_once(spark, log, tmp_path):
    for piece in in_pieces(random_observations(22, n=300), 3):
        log.add(piece)
    updates = read_updates(spark, table_of(device_counts.per_device(log.stream()), tmp_path))
    assert updates.groupBy("key", START, "batch_id").count().where("count > 1").count() == 0


def test_restart_resumes_without_reading_again(spark, log, tmp_path):
    use_stream_settings(spark)
    rows = random_observations(23, n=400)
    pieces = in_pieces(rows, 4)
    read, ids = 0, set()
    for pair in (pieces[:2], pieces[2:]):
        for piece in pair:
            log.add(piece)
        query = run(
            to_table(
                device_counts.per_device(log.stream()),
                f"{tmp_path}/t",
                "resumed",
                f"{tmp_path}/cp",
                available_now=True,
            )
        )
        ids.add(query.id)
        read += sum(p["numInputRows"] for p in query.recentProgress)
    assert read == len(rows)
    assert len(ids) == 1
    got = pairs(read_latest(spark, f"{tmp_path}/t"), *COUNT)
    assert got == pairs(count_by_window(valid(spark, rows)), *COUNT)


def test_a_repeated_trigger_replaces_its_rows(spark, tmp_path):
    counted = count_by_window(valid(spark, random_observations(24, n=50)))
    for _ in range(2):
        write_batch(counted, f"{tmp_path}/t", 0)
    assert read_updates(spark, f"{tmp_path}/t").count() == counted.count()


@pytest.mark.parametrize(
    "count", [device_counts.per_device, device_counts.per_resource, device_counts.both_levels]
)
def test_state_is_forgotten_a_day_after_window_start(spark, log, tmp_path, count):
    use_stream_settings(spark)
    day = BASE_MS + 24 * 60 * MINUTE_MS
    log.add([observation(0, BASE_MS), observation(1, BASE_MS + MINUTE_MS)])
    log.add([observation(2, day)])
    # The watermark takes effect on late rows one trigger after it moved.
    log.add([observation(3, day)])
    log.add([observation(4, BASE_MS), observation(5, BASE_MS + MINUTE_MS)])
    counts = table_of(count(log.stream()), tmp_path)
    # At stream time BASE + 1 day the first window is closed and the second is not.
    by = [c for c in ("level", "key", START, END) if c in count(log.stream()).columns]
    assert pairs(latest(read_updates(spark, counts), by), START, "n") == {
        (BASE_MS, 1),
        (BASE_MS + MINUTE_MS, 2),
        (day, 2),
    }
    state = spark.read.format("statestore").load(f"{tmp_path}/t-cp")
    starts = {r.s for r in state.select(F.unix_millis("key.window.start").alias("s")).collect()}
    assert starts == {BASE_MS + MINUTE_MS, day}


def late_rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for off in range(n):
        ms = BASE_MS + 10**9 + off * 400_000
        if rng.random() < 0.1:
            ms -= rng.randrange(2 * grace_ms(MINUTE_MS))
        rows.append(
            observation(off, ms, ep=f"d{off % 2}", part=off % 2, lng=rng.randrange(3))
        )
    return rows


def test_ledger_drops_late_records_exactly(spark, log, tmp_path):
    rows = late_rows(31)
    late = late_offsets(rows, MINUTE_MS, grace_ms(MINUTE_MS))
    assert 0 < len(late) < len(rows)
    for piece in in_pieces(rows, 7):
        log.add(piece)
    run(
        ledger.count_exactly(
            log.stream(2), MINUTE_MS, f"{tmp_path}/t", "exact", f"{tmp_path}/cp", available_now=True
        )
    )
    kept = valid(spark, [r for r in rows if r.off not in late])
    got = pairs(ledger.read_counts(spark, f"{tmp_path}/t", MINUTE_MS), *COUNT)
    assert got == pairs(count_by_window(kept), *COUNT)


def test_ledger_folds_nan_across_triggers(spark, log, tmp_path):
    rows = random_observations(32, n=400, nan=0.05)
    _, best = fold_steps(rows, HALF_MINUTE_MS)
    for piece in in_pieces(rows, 6):
        log.add(piece)
    run(
        ledger.max_exactly(
            log.stream(), HALF_MINUTE_MS, f"{tmp_path}/t", "fold", f"{tmp_path}/cp",
            available_now=True,
        )
    )
    got = ledger.read_maxima(spark, f"{tmp_path}/t", HALF_MINUTE_MS)
    assert {(r.key.ep, r[START]): r.off for r in got.collect()} == best


def test_ledger_trigger_can_run_again(spark, tmp_path):
    rows = late_rows(33, 120)
    pieces = in_pieces(rows, 3)
    for batch_id, piece in enumerate(pieces):
        for _ in range(2):
            ledger._each(
                valid(spark, piece), batch_id, f"{tmp_path}/t", MINUTE_MS, "part", ledger.COUNTS
            )
    late = late_offsets(rows, MINUTE_MS, grace_ms(MINUTE_MS))
    kept = valid(spark, [r for r in rows if r.off not in late])
    got = pairs(ledger.read_counts(spark, f"{tmp_path}/t", MINUTE_MS), *COUNT)
    assert got == pairs(count_by_window(kept), *COUNT)


def test_replay_rule_on_a_stream_needs_the_ledger(log):
    log.add([observation(0, BASE_MS)])
    with pytest.raises(ValueError, match="ledger"):
        max_by_window(rekey_by_resource(log.stream()), nan="replay")


def test_console_sink(log, tmp_path):
    log.add([observation(0, BASE_MS)])
    counted = device_counts.per_device(log.stream())
    query = run(to_console(counted, "console", f"{tmp_path}/cp", available_now=True))
    assert query.name == "console"
    first = query.recentProgress[0]
    assert "Console" in first["sink"]["description"]
    assert first["numInputRows"] == 1


def test_failures_reach_the_caller(log, tmp_path):
    log.add([Row(key=Row(ep="a"), value=None, part=0, off=0)])
    rows = log.spark.readStream.schema(schema.OBSERVATION).parquet(log.path)
    counted = device_counts.per_device(valid_records(rows, "fail"))
    with pytest.raises(Exception, match="no value"):
        table_of(counted, tmp_path)


def test_retention_leaves_a_batch_alone(spark):
    obs = valid(spark, [observation(0, BASE_MS)])
    assert with_retention(obs, MINUTE_MS) is obs
