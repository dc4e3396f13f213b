"""The parity-sketch join against all pairs."""

import random
import re

import numpy as np
import pytest

from telewin.llm import linking, parity_join

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, percent):
    """``doc_id, n_shingles, component_id`` of rows with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    copies = {}
    for i, s in sets.items():
        if s:
            copies.setdefault(s, []).append(i)
    root = {min(ids): min(ids) for ids in copies.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(((len(s), min(ids), s) for s, ids in copies.items()), key=lambda x: x[:2])
    for at, (n, a, x) in enumerate(ordered):
        for m, b, y in ordered[at + 1 :]:
            if 100 * n < percent * m:
                break
            both = len(x & y)
            if both and 100 * both >= percent * (n + m - both):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return sorted((i, len(s), find(min(copies[s])) if s else i) for i, s in sets.items())


def families(seed=3, sizes=(3, 11, 14, 30, 90, 300, 1500), members=50):
    """Edited copies around the threshold, of texts of different lengths."""
    dice = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"w{dice.randrange(10**6)}" for _ in range(size)]
        for _ in range(members):
            words = list(base)
            for _ in range(dice.randrange(0, max(2, size // 20))):
                words[dice.randrange(size)] = f"x{dice.randrange(10**6)}"
            if dice.random() < 0.3:
                words += [f"y{dice.randrange(10**6)}" for _ in range(size // dice.randrange(9, 30))]
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize(("stars", "cell", "percent"), [((1, 8), (1024, 4096), 90), ((), (2, 3), 90), ((1, 8), (1024, 4096), 80)])
def test_components_equal_all_pairs(spark, monkeypatch, stars, cell, percent):
    monkeypatch.setattr(linking, "STARS", stars)
    monkeypatch.setattr(linking, "CELL", cell)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, percent)
    assert len({r[2] for r in want}) < len(rows)
    assert sorted(tuple(r) for r in parity_join.ngram_components(df, percent).collect()) == want


def test_documents_equal_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 90)
    assert sorted(tuple(r) for r in parity_join.ngram_components(docs, 90).collect()) == want


def test_odd_rows(spark):
    long = " ".join(f"word{i % 997}x{i}" for i in range(40_000))
    rows = [
        (1, "A b c d"), (2, "a\tb  C d"), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "ONE two"), (8, "one"),
        (9, long), (10, long + " tail"), (11, "a b c d"), (11, "a b c d"), (None, "a b c d"), (None, None), (12, "a b c d a b c d"),
    ]
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, band string, n int, a int, rep int")
    out = parity_join.ngram_components(df, 90)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert got == sorted(
        [
            (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 39_998, 9), (10, 39_999, 9),
            (11, 2, 1), (11, 2, 1), (None, 2, None), (None, 0, None), (12, 4, 12),
        ],
        key=str,
    )
    assert parity_join.ngram_components(df.limit(0)).count() == 0


def test_sketches_bound_the_difference_and_agree_on_a_word():
    """Of any two sets that may be linked: the bound holds in a common band, and one word is equal there."""
    dice = np.random.default_rng(2)
    for percent in (80, 90):
        edges = parity_join.band_edges(5000)
        words = parity_join.sketch_words(edges, percent)
        assert (edges[1:] > edges[:-1]).all() and edges[-3] <= 5000 < edges[-2]
        for n in (9, 10, 19, 57, 200, 2000):
            x = dice.integers(0, 2**63, n, dtype=np.uint64)
            most = n * (100 - percent) // (100 + percent)
            y = np.concatenate([x[most:], dice.integers(0, 2**63, most, dtype=np.uint64)])
            band = np.searchsorted(edges, n, side="right") - 1
            sketch = [parity_join._parities(s, np.zeros(n, np.int64), words[band : band + 1]).view(np.uint64) for s in (x, y)]
            differ = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
            assert differ <= 2 * most < words[band]
            assert (sketch[0] == sketch[1]).any()


def test_near_keeps_what_sizes_and_sketches_allow():
    dice = np.random.default_rng(5)
    rows = 40
    base = dice.integers(0, 2**64, parity_join.FOLD, dtype=np.uint64)
    fold = np.tile(base, (rows, 1))
    for i in range(rows):
        for bit in dice.choice(parity_join.FOLD * 64, int(dice.integers(0, 6)) * 12, replace=False):
            fold[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    n = dice.integers(400, 600, rows)
    side = [np.arange(rows), np.arange(rows) // 2, n, fold]
    want = {
        (i, j)
        for i in range(rows)
        for j in range(rows)
        if i // 2 != j // 2
        and min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 85
        and sum((int(p) ^ int(q)).bit_count() for p, q in zip(fold[i], fold[j])) * 185 <= (n[i] + n[j]) * 15
    }
    assert 0 < len(want) < rows * (rows - 1)
    assert set(zip(*(x.tolist() for x in parity_join._near(side, side, 85)))) == want
