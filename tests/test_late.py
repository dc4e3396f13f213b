import random

import pytest

from records import BASE_MS, late_offsets, observation, valid
from telewin import workspace
from telewin.operators.late import drop_late, flag_late, stream_times
from telewin.operators.windows import MINUTE_MS, grace_ms

SIZE = MINUTE_MS


def flagged(obs, **rule):
    return {r.off for r in flag_late(obs, SIZE, **rule).where("late").collect()}


@pytest.mark.parametrize("by", [-1, 0, 1])
def test_boundary(spark, by):
    grace = grace_ms(SIZE)
    first_end = BASE_MS + SIZE
    rows = [
        observation(0, first_end + grace + by),
        observation(1, first_end - 1),
    ]
    assert flagged(valid(spark, rows)) == ({1} if by >= 0 else set())


def test_default_grace_is_a_day_from_window_start():
    assert grace_ms(MINUTE_MS) == 24 * 60 * MINUTE_MS - MINUTE_MS


@pytest.mark.parametrize("chunk", [1, 8, 64, 1 << 16])
@pytest.mark.parametrize("stray", [0.0, 0.02, 0.5])
def test_equals_record_by_record(spark, chunk, stray):
    rng = random.Random(chunk)
    rows = []
    for off in range(500):
        ms = BASE_MS + 10**7 + off * 2000
        if rng.random() < stray:
            ms -= rng.randrange(10**6)
        rows.append(observation(off, ms, part=rng.choice([0, 0, 0, 1, 2])))
    want = late_offsets(rows, SIZE, 120_000)
    assert bool(want) == (stray > 0)
    assert flagged(valid(spark, rows), grace=120_000, chunk_offsets=chunk) == want


@pytest.mark.parametrize("rows_allowed", [0, 10**6])
def test_both_join_ways_agree(spark, monkeypatch, rows_allowed):
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", rows_allowed)
    rows = [observation(o, BASE_MS + (o * 7919) % 10**6, part=o % 3) for o in range(200)]
    want = late_offsets(rows, SIZE, 1000)
    assert want and flagged(valid(spark, rows), grace=1000, chunk_offsets=16) == want


def test_every_record_is_flagged_once(spark):
    rows = [observation(o, BASE_MS + (o * 7919) % 10**6, part=o % 3) for o in range(200)]
    got = flag_late(valid(spark, rows), SIZE, grace=1000, chunk_offsets=16)
    assert sorted(r.off for r in got.collect()) == list(range(200))


def test_partitions_have_their_own_stream_time(spark):
    rows = [
        observation(0, BASE_MS + 10 * SIZE, part=0),
        observation(1, BASE_MS, part=1),
        observation(2, BASE_MS, part=0),
    ]
    assert flagged(valid(spark, rows), grace=0) == {2}


def test_stream_time_carries_over(spark):
    first = [observation(0, BASE_MS + 10 * SIZE, part=0), observation(1, BASE_MS, part=1)]
    second = [observation(2, BASE_MS, part=0), observation(3, BASE_MS + 1, part=1)]
    reached = stream_times(valid(spark, first))
    assert flagged(valid(spark, second), grace=0, reached=reached) == {2}
    kept = drop_late(valid(spark, second), SIZE, grace=0, reached=reached)
    assert [r.off for r in kept.collect()] == [3]


def test_rekeyed_records_are_ordered_by_arrival(spark):
    """Two source partitions in perfect order, one ten times busier, brought into one partition."""
    rows = [observation(i, BASE_MS + i * 1000, part=0) for i in range(1000)]
    rows += [observation(i, BASE_MS + i * 10_000, part=1) for i in range(100)]
    obs = valid(spark, rows).selectExpr("*", "0 as rpart", "ts_ms as arrived")
    by_offset = flag_late(obs, SIZE, part="rpart", grace=0).where("late").count()
    by_arrival = flag_late(obs, SIZE, part="rpart", grace=0, arrived="arrived", chunk_offsets=60_000)
    assert by_offset > 0
    assert by_arrival.where("late").count() == 0 and by_arrival.count() == len(rows)
