"""Vector codes against rounds on one matrix, and what moves in a round."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telewin.llm import member_lloyd

SCHEMA = "vec_id long, embedding array<float>, label string, rid int, position string, part int, error int"


def nearest(rows, book):
    far = ((rows[:, None, :] - book[None]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


def brute(rows, entries=256, rounds=4):
    """``vec_id, code, error, label_error, sha256`` of rows of (vec_id, integer vector, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tuple(r[1])))
    x = np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), -1)
    dims = x.shape[1]
    cuts = np.cumsum([dims // 4 + (p < dims % 4) for p in range(4)])[:-1]
    books = [b.copy() for b in np.split(x[:entries], cuts, axis=1)]
    for _ in range(rounds):
        for part, book in zip(np.split(x, cuts, axis=1), books, strict=True):
            near, _ = nearest(part, book)
            for e in set(near.tolist()):
                book[e] = part[near == e].sum(0) // (near == e).sum()
    found = [nearest(part, book) for part, book in zip(np.split(x, cuts, axis=1), books, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    error = sum(f[1] for f in found)
    return [(r[0], "".join("%02x" % f[0][i] for f in found), int(error[i]), r[2], sha) for i, r in enumerate(rows)]


def with_label_errors(rows):
    total = {}
    for _, _, error, label, _ in rows:
        total[label] = total.get(label, 0) + error
    return sorted([(*r[:3], total[r[3]], r[4]) for r in rows], key=str)


def integers(v):
    return np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_codes_equal_rounds_on_one_matrix(spark):
    random = np.random.default_rng(4)
    centers = random.normal(size=(40, 8))
    vectors = np.round(centers[random.integers(0, 40, 700)] + random.normal(scale=0.3, size=(700, 8)), 3)
    vectors[100:350] = vectors[100]  # a third of all rows are one vector
    rows = [(i, v.tolist(), None if i % 5 == 0 else f"l{i % 3}") for i, v in enumerate(vectors)]
    rows += [(7, vectors[9].tolist(), "again"), rows[3], (None, vectors[11].tolist(), "l0")]
    bad = [(900, None, "l0"), (901, [1.0, None] * 4, "l0"), (902, [float("nan")] * 8, "l1"), (903, [float("inf")] * 8, None)]
    df = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in [*rows, *bad]], SCHEMA)
    want = with_label_errors(brute([(i, integers(v), label) for i, v, label in rows]))
    out = member_lloyd.compressed(df)
    assert rows_of(out) == want
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_each_length_has_codebooks_of_its_own(spark):
    random = np.random.default_rng(5)
    rows = [(i, np.round(random.normal(size=(0, 3, 8, 9)[i % 4]), 2).tolist(), "a" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA)
    want = [x for n in (0, 3, 8, 9) for x in brute([(i, integers(v), s) for i, v, s in rows if len(v) == n])]
    assert rows_of(member_lloyd.compressed(df)) == with_label_errors(want)
    assert member_lloyd.compressed(df.limit(0)).count() == 0
    assert member_lloyd.compressed(df.where("vec_id < 0")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_large_components_are_exact_and_cut_off(spark):
    top = member_lloyd.largest_component(8, 4)
    rows = [(i, [float(2 ** (12 + i)), -float(2 ** (13 + i)), 3.0, 1e30 if i % 2 else -1e30] * 2, None) for i in range(9)]
    df = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA)
    cut = [(i, [int(max(-top, min(top, float(x)))) for x in np.array(v, dtype=object) * 1024], s) for i, v, s in rows]
    got = rows_of(member_lloyd.compressed(df, entries=3).select("vec_id", "code", "error"))
    assert got == sorted([r[:3] for r in brute(cut, entries=3)], key=str)


def test_nearest_takes_the_first_of_equally_near_entries():
    book = np.array([[4, 0], [0, 0], [2, 2], [0, 0]])
    place, far = member_lloyd.nearest(np.array([[2, 0], [0, 1], [4, 4], [2**27, 2**27]]), book)
    assert place.tolist() == [0, 1, 2, 2] and far[:3].tolist() == [4, 1, 8]
    assert far[3] == 2 * (2**27 - 2) ** 2


def test_only_parts_that_change_entry_move(spark, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(i, np.round(random.normal(size=8), 2).tolist(), None, 1, "p", 2, 3) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    moved, migrated = [], member_lloyd._migrated

    def counted(movers, judged, tasks):
        moved.append((movers.count(), judged.count()))
        out = migrated(movers, judged, tasks)
        # Owners of an entry with many members share them.
        shares = out.groupBy("position", "entry", "salt").count().agg(F.max("count")).first()[0] or 0
        assert shares <= judged.count() / (4 * tasks) * 2 + 10
        return out

    monkeypatch.setattr(member_lloyd, "_migrated", counted)
    member_lloyd.compressed(df, entries=16).count()
    assert moved[0] == (1600, 1600) and len(moved) == 4
    assert all(0 < m < 0.5 * n for m, n in moved[1:])


@pytest.mark.parametrize("dims", [0, 1, 4, 7, 64, 4096])
def test_cut_off_keeps_errors_in_a_long(dims):
    low = member_lloyd.largest_component(dims, 4)
    assert sum(w * (2 * low) ** 2 for w in member_lloyd.part_widths(dims, 4)) < 2**63
