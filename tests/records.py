"""Small hand-made observations, and the plain folds results are compared with."""

import math
import random

from pyspark.sql import Row, functions as F

from telewin import schema
from telewin.operators.records import valid_records

BASE_MS = 1704067200000


def observation(off, ms, ep="a", path="/p", lng=None, dbl=None, part=0):
    return Row(
        key=Row(ep=ep),
        value=Row(
            timestamp=ms,
            path=path,
            rep=Row(body=Row(content=Row(path=path, value=Row(lng=lng, dbl=dbl)))),
        ),
        part=part,
        off=off,
    )


def frame_of(spark, rows):
    return spark.createDataFrame(rows, schema.OBSERVATION)


def valid(spark, rows):
    return valid_records(frame_of(spark, rows))


def random_observations(seed, n=400, nan=0.0, missing=0.0, keys=3, span_ms=60_000):
    """Readings from a few values so that ties are common, with NaN, -0.0 and huge longs."""
    rng = random.Random(seed)
    rows = []
    for off in range(n):
        kind = rng.random()
        lng = dbl = None
        if kind < nan:
            dbl = math.nan
        elif kind < nan + missing:
            pass
        elif rng.random() < 0.5:
            lng = rng.choice([0, 1, 2, 2**53, 2**53 + 1, 2**60])
        else:
            dbl = rng.choice([-0.0, 0.0, 1.0, 2.0, 1.5, float(2**53)])
        rows.append(
            observation(
                off,
                BASE_MS + rng.randrange(span_ms),
                ep=f"d{rng.randrange(keys)}",
                lng=lng,
                dbl=dbl,
            )
        )
    return rows


def reading(row):
    content = row.value.rep.body.content
    number = content.value.lng if content.value.lng is not None else content.value.dbl
    return None if number is None else float(number)


def group_of(row, size_ms):
    return row.key.ep, row.value.timestamp // size_ms * size_ms


def fold_steps(rows, size_ms):
    """The winner of every group after each record, comparing one by one with ``>``.

    A missing reading loses against everything that is not missing.
    """
    best, steps = {}, []
    for row in sorted(rows, key=lambda r: r.off):
        group = group_of(row, size_ms)
        old = best.get(group)
        if old is None:
            best[group] = row
        else:
            a, b = reading(old), reading(row)
            a_wins = (
                a > b
                if a is not None and b is not None
                else a is not None and b is None and not math.isnan(a)
            )
            best[group] = old if a_wins else row
        steps.append((row.off, best[group].off))
    return steps, {group: row.off for group, row in best.items()}


def late_offsets(rows, size_ms, grace_ms, reached=None):
    """Offsets of records whose window had closed when they arrived."""
    stream, late = dict(reached or {}), set()
    for row in sorted(rows, key=lambda r: r.off):
        ms = row.value.timestamp
        stream[row.part] = max(stream.get(row.part, -1), ms)
        if ms // size_ms * size_ms + size_ms <= stream[row.part] - grace_ms:
            late.add(row.off)
    return late


def pairs(df, *columns):
    chosen = [F.col(c) if isinstance(c, str) else c for c in columns]
    return {tuple(r) for r in df.select(*chosen).collect()}
