import math

import pytest

from records import BASE_MS, fold_steps, observation, pairs, random_observations, valid
from telewin import workspace
from telewin.operators.compaction import latest
from telewin.operators.maxima import max_by_window
from telewin.operators.updates import count_updates, max_updates
from telewin.operators.windows import HALF_MINUTE_MS, START

SIZE = HALF_MINUTE_MS


def winners(df):
    return {(r.key.ep, r[START]): r.off for r in df.collect()}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
@pytest.mark.parametrize("seed,nan", [(1, 0.0), (2, 0.1), (3, 0.6)])
def test_replay_equals_fold(spark, seed, nan, chunk):
    rows = random_observations(seed, nan=nan)
    _, best = fold_steps(rows, SIZE)
    got = max_by_window(valid(spark, rows), SIZE, nan="replay", chunk_offsets=chunk)
    assert winners(got) == best


@pytest.mark.parametrize("rows_allowed", [0, 10**6])
def test_both_join_ways_agree(spark, monkeypatch, rows_allowed):
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", rows_allowed)
    rows = random_observations(12, nan=0.1)
    _, best = fold_steps(rows, SIZE)
    assert winners(max_by_window(valid(spark, rows), SIZE, nan="replay", chunk_offsets=8)) == best


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
@pytest.mark.parametrize("seed,nan", [(4, 0.0), (5, 0.1), (6, 0.6)])
def test_max_updates_equal_fold_steps(spark, seed, nan, chunk):
    rows = random_observations(seed, nan=nan)
    steps, _ = fold_steps(rows, SIZE)
    got = max_updates(valid(spark, rows), SIZE, nan="replay", chunk_offsets=chunk)
    assert sorted((r.off, r.best.off) for r in got.collect()) == steps


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_plain_updates_equal_fold_steps_without_nan(spark, chunk):
    rows = random_observations(7, missing=0.1)
    steps, _ = fold_steps(rows, SIZE)
    got = max_updates(valid(spark, rows), SIZE, nan="lowest", chunk_offsets=chunk)
    assert sorted((r.off, r.best.off) for r in got.collect()) == steps


@pytest.mark.parametrize("nan", ["lowest", "replay"])
def test_rules_agree_without_nan(spark, nan):
    rows = random_observations(8, missing=0.1)
    _, best = fold_steps(rows, SIZE)
    assert winners(max_by_window(valid(spark, rows), SIZE, nan=nan, chunk_offsets=9)) == best


def test_replay_with_missing_and_nan(spark):
    rows = random_observations(9, nan=0.2, missing=0.2)
    _, best = fold_steps(rows, SIZE)
    assert winners(max_by_window(valid(spark, rows), SIZE, nan="replay", chunk_offsets=4)) == best


def test_last_update_is_the_table(spark):
    obs = valid(spark, random_observations(10, nan=0.1))
    updates = max_updates(obs, SIZE, nan="replay", chunk_offsets=6)
    last = latest(updates.select("key", START, "window_end_ms", "off", "best"), version="off")
    table = max_by_window(obs, SIZE, nan="replay")
    assert {(r.key.ep, r[START]): r.best.off for r in last.collect()} == winners(table)


def test_nan_displaces_and_is_displaced(spark):
    ms = BASE_MS
    rows = [
        observation(0, ms, lng=9),
        observation(1, ms, dbl=math.nan),
        observation(2, ms, lng=1),
        observation(3, ms, ep="b", lng=9),
        observation(4, ms, ep="b", dbl=math.nan),
    ]
    obs = valid(spark, rows)
    assert winners(max_by_window(obs, SIZE, nan="replay")) == {("a", ms): 2, ("b", ms): 4}
    assert winners(max_by_window(obs, SIZE, nan="lowest")) == {("a", ms): 0, ("b", ms): 3}


def test_equal_readings_across_branches_keep_the_later(spark):
    ms = BASE_MS
    rows = [
        observation(0, ms, dbl=float(2**53)),
        observation(1, ms, lng=2**53 + 1),
        observation(2, ms, ep="z", dbl=0.0),
        observation(3, ms, ep="z", dbl=-0.0),
    ]
    assert winners(max_by_window(valid(spark, rows), SIZE)) == {("a", ms): 1, ("z", ms): 3}


def test_single_record_is_kept_whatever_its_reading(spark):
    rows = [observation(0, BASE_MS), observation(1, BASE_MS, ep="b", dbl=math.nan)]
    for nan in ("lowest", "replay"):
        assert len(winners(max_by_window(valid(spark, rows), SIZE, nan=nan))) == 2


def test_missing_reading_can_fail(spark):
    obs = valid(spark, [observation(0, BASE_MS, lng=1), observation(1, BASE_MS)])
    assert winners(max_by_window(obs, SIZE)) == {("a", BASE_MS): 0}
    with pytest.raises(Exception, match="neither a long nor a double"):
        max_by_window(obs, SIZE, on_bad="fail").collect()


def test_the_whole_record_is_kept(spark):
    rows = [observation(0, BASE_MS + 5, lng=4), observation(1, BASE_MS + 7, lng=3)]
    got = max_by_window(valid(spark, rows), SIZE).collect()
    assert [(r.value, r.off, r.part) for r in got] == [(rows[0].value, 0, 0)]


@pytest.mark.parametrize("chunk", [1, 10, 1 << 16])
def test_count_updates(spark, chunk):
    rows = random_observations(11)
    seen, want = {}, set()
    for row in rows:
        group = (row.key.ep, row.value.timestamp // SIZE * SIZE)
        seen[group] = seen.get(group, 0) + 1
        want.add((row.off, seen[group]))
    assert pairs(count_updates(valid(spark, rows), SIZE, chunk), "off", "n") == want


def test_unknown_rule_is_refused(spark):
    obs = valid(spark, [observation(0, BASE_MS)])
    with pytest.raises(ValueError, match="nan must be"):
        max_by_window(obs, SIZE, nan="drop")
    with pytest.raises(ValueError, match="nan must be"):
        max_updates(obs, SIZE, nan="drop")
