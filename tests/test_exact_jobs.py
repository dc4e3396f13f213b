"""Exact tables over many triggers: merging, change streams, failures, and the jobs that keep them."""

import math

import pyarrow.parquet as pq
import pytest

from records import BASE_MS, fold_steps, frame_of, late_offsets, observation, pairs, random_observations, valid
from telewin import schema
from telewin.operators.compaction import latest
from telewin.operators.counts import count_by_window
from telewin.operators.late import drop_late
from telewin.operators.records import mark_max, valid_records
from telewin.operators.windows import END, HALF_MINUTE_MS, MINUTE_MS, START, grace_ms
from telewin.plans import device_counts, window_max
from telewin.plans.source import rekeyed
from telewin.settings import CountSettings, MaxSettings
from telewin.streaming import ledger, merged, tables
from telewin.streaming.merged import Range, batches_in, merges
from telewin.streaming.run import finish
from telewin.streaming.tables import merge_updates, read_latest, read_updates, to_table, write_batch
from telewin.streaming.topics import read_topic_rows
from test_streaming import COUNT, in_pieces, late_rows


def kept_rows(rows, size_ms=MINUTE_MS):
    late = late_offsets(rows, size_ms, grace_ms(size_ms))
    assert late
    return [r for r in rows if r.off not in late]


def trigger(spark, path, batch_id, piece, kind=ledger.COUNTS, size_ms=MINUTE_MS, **how):
    ledger._each(valid(spark, piece), batch_id, path, size_ms, "part", kind, **how)


def test_merging_keeps_the_table_and_bounds_the_folders(spark, tmp_path):
    rows, path = late_rows(41, 400), f"{tmp_path}/t"
    for batch_id, piece in enumerate(in_pieces(rows, 9)):
        trigger(spark, path, batch_id, piece, merge_every=2)
    merged = merges(spark, path, ledger.LAYOUT)
    assert sorted(merged) == [1, 3, 5, 7]
    assert batches_in(spark, f"{path}/partials") == [6, 7, 8]
    assert batches_in(spark, f"{path}/base") == [5, 7]
    assert batches_in(spark, f"{path}/reached") == [5, 6, 7, 8]
    assert batches_in(spark, f"{path}/work") == []
    # Records span more than a day: some windows are closed and no longer read by a merge.
    assert spark.read.parquet(f"{path}/base/batch_id=7").count() > 0
    assert batches_in(spark, f"{path}/closed") == sorted(b for b, r in merged.items() if r)
    for batch_id, (low, high) in ((b, r) for b, r in merged.items() if r):
        starts = {r[START] for r in spark.read.parquet(f"{path}/closed/batch_id={batch_id}").collect()}
        assert (min(starts), max(starts)) == (low, high)
    for file in (tmp_path / "t/base/batch_id=7").glob("*.parquet"):
        starts = pq.read_table(file).column(START).to_pylist()
        assert starts == sorted(starts)
    early = ledger.read_rows(spark, path, Range(BASE_MS, BASE_MS)).inputFiles()
    assert not any("/closed/" in f for f in early)
    want = pairs(count_by_window(valid(spark, kept_rows(rows))), *COUNT)
    assert pairs(ledger.read_counts(spark, path, MINUTE_MS), *COUNT) == want


@pytest.mark.parametrize("broken", ["mark", "remove", "merge"])
def test_a_failed_merge_can_run_again(spark, tmp_path, monkeypatch, broken):
    """Wherever a merge stops, the trigger that runs again leaves the same table."""
    rows, path = late_rows(42, 200), f"{tmp_path}/t"

    def fail(*args):
        raise OSError("lost")

    for batch_id, piece in enumerate(in_pieces(rows, 6)):
        if batch_id in (1, 3):
            with monkeypatch.context() as patch, pytest.raises(OSError, match="lost"):
                patch.setattr(merged, broken, fail)
                if broken == "remove":
                    patch.setattr(ledger, broken, fail)
                trigger(spark, path, batch_id, piece, merge_every=2)
        for _ in range(2):
            trigger(spark, path, batch_id, piece, merge_every=2)
    want = pairs(count_by_window(valid(spark, kept_rows(rows))), *COUNT)
    assert pairs(ledger.read_counts(spark, path, MINUTE_MS), *COUNT) == want


def test_a_partition_that_starts_late_still_reaches_closed_windows(spark, tmp_path):
    day = 24 * 60 * MINUTE_MS
    old = [observation(i, BASE_MS + i * 1000, lng=1) for i in range(5)]
    new = [observation(10 + i, BASE_MS + 3 * day + i * 1000, lng=1) for i in range(5)]
    other = [observation(20 + i, BASE_MS + i * 1000, lng=1, part=1) for i in range(3)]
    path = f"{tmp_path}/t"
    for batch_id, piece in enumerate((old, new, other, new[:0])):
        trigger(spark, path, batch_id, piece, merge_every=1)
    assert set(merges(spark, path, ledger.LAYOUT).values()) == {None, (BASE_MS, BASE_MS)}
    got = ledger.read_counts(spark, path, MINUTE_MS)
    assert pairs(got, START, "n") == {(BASE_MS, 8), (BASE_MS + 3 * day, 5)}


def test_folds_with_resets_survive_merges(spark, tmp_path):
    rows, path = random_observations(43, n=400, nan=0.05), f"{tmp_path}/t"
    _, best = fold_steps(rows, HALF_MINUTE_MS)
    for batch_id, piece in enumerate(in_pieces(rows, 8)):
        trigger(spark, path, batch_id, piece, ledger.MAXIMA, HALF_MINUTE_MS, merge_every=3)
    got = ledger.read_maxima(spark, path, HALF_MINUTE_MS)
    assert {(r.key.ep, r[START]): r.off for r in got.collect()} == best


def test_changes_are_the_windows_a_trigger_touched(spark, tmp_path):
    rows, path, seen = random_observations(44, n=300, nan=0.03), f"{tmp_path}/t", []
    pieces = in_pieces(rows, 6)

    def emit(changes, batch_id):
        seen.append({(r.key.ep, r[START]): r.off for r in changes.collect()})

    for batch_id, piece in enumerate(pieces):
        trigger(spark, path, batch_id, piece, ledger.MAXIMA, HALF_MINUTE_MS, emit=emit, merge_every=2)
        _, best = fold_steps(sum(pieces[: batch_id + 1], []), HALF_MINUTE_MS)
        touched = {(r.key.ep, r.value.timestamp // HALF_MINUTE_MS * HALF_MINUTE_MS) for r in piece}
        assert seen[-1] == {w: best[w] for w in touched}


def test_rekeyed_records_count_in_the_order_they_arrived(spark, tmp_path, monkeypatch):
    """Two source partitions brought into one, the busier one far ahead in offsets; chunks of any size."""
    day = 24 * 60 * MINUTE_MS
    rows = [observation(i, BASE_MS + i * day // 100, ep="busy", part=0) for i in range(300)]
    rows += [observation(i, BASE_MS + (i * 10 + 5) * day // 100, ep="calm", part=1) for i in range(30)]
    # One record of the calm partition is two days behind when it arrives.
    rows[320] = observation(20, BASE_MS + 5 * day // 100, ep="calm", part=1)
    arrived = {(0, i): i * 10 for i in range(300)} | {(1, i): i * 100 + 55 for i in range(30)}
    order = sorted(rows, key=lambda r: arrived[r.part, r.off])
    reached, late = -1, []
    for r in order:
        reached = max(reached, r.value.timestamp)
        if r.value.timestamp // MINUTE_MS * MINUTE_MS + MINUTE_MS <= reached - grace_ms(MINUTE_MS):
            late.append(r)
    assert [(r.part, r.off) for r in late] == [(1, 20)]
    times = spark.createDataFrame([(p, o, t) for (p, o), t in arrived.items()], "part int, off long, arrived_ms long")
    for chunk in (1, 7, 1 << 16):
        monkeypatch.setattr(ledger, "CHUNK_OFFSETS", chunk)
        path = f"{tmp_path}/{chunk}"
        for batch_id, piece in enumerate(in_pieces(order, 3)):
            batch = valid(spark, piece).join(times, ["part", "off"]).selectExpr("*", "0 as rpart")
            ledger._each(batch, batch_id, path, MINUTE_MS, "rpart", ledger.COUNTS, arrived="arrived_ms")
        want = pairs(count_by_window(valid(spark, [r for r in rows if r not in late])), *COUNT)
        assert pairs(ledger.read_counts(spark, path, MINUTE_MS), *COUNT) == want


def test_update_tables_are_merged(spark, tmp_path):
    """Two days of windows in six triggers: the last update of each stays, the files don't pile up."""
    path, size = f"{tmp_path}/t", 60
    rows = [observation(i, BASE_MS + (i // 2) * 24 * MINUTE_MS, ep=f"d{i % 3}", lng=1) for i in range(6 * size)]
    seen = []
    for batch_id in range(6):
        seen += rows[batch_id * size : (batch_id + 1) * size]
        # Every trigger repeats what the last one touched, with higher counts.
        touched = valid(spark, seen[-2 * size :])
        write_batch(count_by_window(touched), path, batch_id)
        if batch_id % 2:
            for _ in range(2):
                merge_updates(spark, path, batch_id)
    assert batches_in(spark, path) == [4, 5]
    assert batches_in(spark, f"{path}/_base") == [3, 5]
    found = merges(spark, path, tables.LAYOUT)
    assert sorted(found) == [1, 3, 5] and any(found.values())
    want = pairs(count_by_window(valid(spark, rows)), *COUNT)
    assert pairs(read_latest(spark, path), *COUNT) == want


def test_a_stream_merges_its_update_table(spark, tmp_path):
    rows = random_observations(47, n=300)
    obs = log_stream(spark, f"{tmp_path}/log", rows)
    path = f"{tmp_path}/t"
    query = to_table(
        device_counts.per_device(obs), path, "merged", f"{tmp_path}/cp", merge_every=2, available_now=True
    )
    finish(query, 200)
    assert sorted(merges(spark, path, tables.LAYOUT)) == [1, 3]
    assert batches_in(spark, path) == [2, 3, 4]
    assert pairs(read_latest(spark, path), *COUNT) == pairs(count_by_window(valid(spark, rows)), *COUNT)


def test_an_update_for_each_record(spark, tmp_path):
    """Every record's update, over merges and a trigger that runs again after its merge."""
    rows, path = random_observations(48, n=240, nan=0.05, missing=0.03), f"{tmp_path}/t"
    steps, _ = fold_steps(rows, HALF_MINUTE_MS)
    got, counts, seen = {}, {}, {}

    def emit(updates, batch_id):
        got.update({r.off: r.best_off for r in updates.collect()})

    def emit_counts(updates, batch_id):
        counts.update({r.off: r.n for r in updates.collect()})

    for batch_id, piece in enumerate(in_pieces(rows, 6)):
        for _ in range(2):
            how = {"merge_every": 2, "every_record": True}
            trigger(spark, path, batch_id, piece, ledger.MAXIMA, HALF_MINUTE_MS, emit=emit, **how)
            trigger(spark, f"{path}-n", batch_id, piece, size_ms=HALF_MINUTE_MS, emit=emit_counts, **how)
    assert got == dict(steps)
    for r in rows:
        window = (r.key.ep, r.value.timestamp // HALF_MINUTE_MS)
        seen[window] = seen.get(window, 0) + 1
        assert counts[r.off] == seen[window]


def test_reading_before_any_trigger_says_so(spark, tmp_path):
    with pytest.raises(ValueError, match="no trigger"):
        ledger.read_rows(spark, f"{tmp_path}/t")


def log_stream(spark, folder, rows, files=5):
    """The rows as files of a log, in order, read one file a trigger."""
    size = math.ceil(len(rows) / files)
    for i in range(files):
        frame_of(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    stream = spark.readStream.schema(schema.OBSERVATION).option("maxFilesPerTrigger", 1)
    return valid_records(stream.parquet(f"{folder}/*"))


def test_exact_count_job_prints_what_a_replay_counts(spark, tmp_path):
    rows = late_rows(45, 240)
    settings = CountSettings(checkpoint=f"{tmp_path}/cp", exact=True, partitions=3, merge_every=2)

    def emit(level):
        return lambda changes, batch_id: write_batch(changes, f"{tmp_path}/{level}", batch_id)

    obs = log_stream(spark, f"{tmp_path}/log", rows)
    for query in device_counts.start_exact(spark, obs, settings, emit, available_now=True):
        finish(query, 200)
    whole = valid(spark, rows)
    wanted = {
        "ep": count_by_window(drop_late(whole, MINUTE_MS)),
        "ep-path": count_by_window(drop_late(rekeyed(whole, settings), MINUTE_MS, part="rpart")),
    }
    for level, want in wanted.items():
        updates = read_updates(spark, f"{tmp_path}/{level}")
        assert pairs(latest(updates), *COUNT) == pairs(want, *COUNT)
        table = f"{tmp_path}/cp/{settings.name}-{level}/table"
        assert pairs(ledger.read_counts(spark, table, MINUTE_MS), *COUNT) == pairs(want, *COUNT)
        assert merges(spark, table, ledger.LAYOUT)


def test_exact_max_job_publishes_what_a_replay_keeps(spark, tmp_path):
    rows = random_observations(46, n=300, nan=0.05)
    settings = MaxSettings(checkpoint=f"{tmp_path}/cp", exact=True, partitions=3, output_partitions=4, merge_every=2)
    obs = log_stream(spark, f"{tmp_path}/log", rows)
    query = window_max.start_exact(
        spark, obs, settings, lambda out, batch_id: write_batch(out, f"{tmp_path}/out", batch_id), available_now=True
    )
    finish(query, 200)
    published = latest(read_updates(spark, f"{tmp_path}/out"), ("key",))
    shown = ("key.ep", START, END, "value.timestamp", "value.path", "topic")
    got = pairs(read_topic_rows(published, HALF_MINUTE_MS), *shown)
    _, best = fold_steps(rows, HALF_MINUTE_MS)
    offsets = set(best.values())
    winners = mark_max(rekeyed(valid(spark, [r for r in rows if r.off in offsets]), settings)).collect()
    assert {(g[0], g[3]) for g in got} == {(r.key.ep, r.value.timestamp) for r in winners}
    assert {g[4] for g in got} == {"/p-max"} and {g[5] for g in got} == {settings.output_topic}


def test_exact_jobs_print_to_the_console(spark, tmp_path):
    settings = CountSettings(checkpoint=f"{tmp_path}/cp", exact=True, partitions=2)
    obs = log_stream(spark, f"{tmp_path}/log", [observation(0, BASE_MS), observation(1, BASE_MS)], files=1)
    for query in device_counts.start_exact(spark, obs, settings, available_now=True):
        finish(query, 100)
        assert query.exception() is None
