"""The producer's partition of a key."""

import random

import pytest
from pyspark.sql import functions as F

from records import BASE_MS, observation, valid
from telewin.functions.partitioning import key_partition, murmur2
from telewin.operators.records import rekey_by_resource, with_rekeyed_partition
from telewin.plans import window_max
from telewin.plans.source import rekeyed
from telewin.settings import CountSettings
from telewin.sources.payloads import to_json_key
from telewin.streaming.topics import topic_rows

# Published values of the hash, as signed numbers.
KNOWN = {
    b"21": -973932308,
    b"foobar": -790332482,
    b"a-little-bit-long-string": -985981536,
    b"a-little-bit-longer-string": -1486304829,
    b"lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971,
    b"abc": 479470107,
}


def plain(data):
    """The hash, byte by byte."""
    mask, factor = 0xFFFFFFFF, 0x5BD1E995
    whole = len(data) // 4 * 4
    h = 0x9747B28C ^ len(data)
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * factor & mask
        k = (k ^ k >> 24) * factor & mask
        h = h * factor & mask ^ k
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * factor & mask
    h = (h ^ h >> 13) * factor & mask
    return h ^ h >> 15


def test_known_hashes(spark):
    df = spark.createDataFrame([(k,) for k in KNOWN], "data binary")
    got = {bytes(r.data): r.h for r in df.select("data", murmur2(F.col("data")).alias("h")).collect()}
    assert {k: h - 2**32 if h >= 2**31 else h for k, h in got.items()} == KNOWN


def test_hashes_of_any_bytes(spark):
    dice = random.Random(3)
    data = [bytes(dice.randrange(256) for _ in range(n)) for n in [*range(40)] * 3]
    df = spark.createDataFrame([(d,) for d in [*data, None]], "data binary")
    rows = df.select("data", murmur2(F.col("data")).alias("h"), key_partition(F.col("data"), 7).alias("p")).collect()
    for r in rows:
        h = None if r.data is None else plain(bytes(r.data))
        assert r.h == h
        assert r.p == (None if h is None else (h & 0x7FFFFFFF) % 7)


def test_windows_of_a_key_go_where_its_producer_puts_the_key(spark):
    rows = [observation(i, BASE_MS + 30_000 * i, ep=f"d{i % 9}", lng=i) for i in range(60)]
    published = topic_rows(window_max.window_max(valid(spark, rows)), "out", 5).collect()
    assert len({r.partition for r in published}) > 1
    for r in published:
        assert r.partition == (plain(bytes(r.key)[:-8]) & 0x7FFFFFFF) % 5


def test_rekeyed_records_are_dealt_by_the_new_key(spark):
    obs = valid(spark, [observation(i, BASE_MS, ep=f"d{i}", lng=i) for i in range(20)])
    for r in rekeyed(obs, CountSettings(partitions=6)).collect():
        assert r.rpart == (plain(b'{"ep":"%s"}' % r.key.ep.encode()) & 0x7FFFFFFF) % 6
    own = with_rekeyed_partition(rekey_by_resource(obs), 6, F.encode("key.ep", "UTF-8"), "p")
    assert all(r.p == (plain(r.key.ep.encode()) & 0x7FFFFFFF) % 6 for r in own.collect())
    with pytest.raises(ValueError, match="partitions"):
        rekeyed(obs, CountSettings())


def test_a_key_is_encoded_once_for_its_hash(spark):
    obs = rekey_by_resource(valid(spark, [observation(0, BASE_MS, lng=1)]))
    plan = obs.select(key_partition(to_json_key(F.col("key")), 4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StructsToJson") == 1
