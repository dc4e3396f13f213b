"""The manifest against trees built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from telewin.llm import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string, part int, place long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def tree(digests):
    """The last node, and of each digest the runs above it as (place, siblings)."""
    paths, own = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, below = [], []
        for i in range(0, len(digests), 3):
            run = digests[i : i + 3]
            for j in range(len(run)):
                for x in own[i + j]:
                    paths[x].append((j, run[:j] + run[j + 1 :]))
            above.append(sha("".join(run)))
            below.append(sum(own[i : i + 3], []))
        digests, own = above, below
    return digests[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    trees = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees.append((mine, *tree([leaf_of(r, r["text"]) for r in mine])))
    if not trees:
        return []
    root, tops = tree([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(mine, paths, strict=True):
            whole, text = path + top, r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf_of(r, text)
            for j, siblings in whole:
                node = sha("".join([*siblings[:j], node, *siblings[j:]]))
            proof = sha("".join(s for _, siblings in whole for s in siblings))
            out.append((r["doc_id"], leaf_of(r, r["text"]), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def documents(n, sources=(None, "a", "é", "b")):
    rows = []
    for i in range(n):
        text = None if i % 5 == 0 else f"x{i}\n\r\n{'é' * i}" * (i % 3)
        rows.append((i * 7 % 1000 if i % 11 else None, sources[i % 7 % len(sources)], None if i % 3 else "en", i, text, 1, "t", 2, 3))
    return rows + rows[5:6] * 4


@pytest.mark.parametrize("n", [0, 1, 2, 4, 10, 90, 300])
def test_manifest_equals_trees_built_node_by_node(spark, n):
    df = spark.createDataFrame(documents(n), SCHEMA)
    out = merkle_manifest.manifest(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(r) for r in out.collect()], key=str) == brute([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("sources", [("one",), tuple(f"s{i}" for i in range(7))])
def test_single_sources_and_single_leaves(spark, sources):
    rows = documents(40, sources)[:40] if len(sources) == 1 else [(i, s, "en", 1, "a\nb", 1, "t", 2, 3) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted([tuple(r) for r in merkle_manifest.manifest(df).collect()], key=str)
    assert got == brute([r.asDict() for r in df.collect()])


def test_jumps_without_broadcasts_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "BROADCAST_ROWS", 0)
    rows = [*documents(200), (5000, "big", "en", 9, "line\n" * 400_000, 1, "t", 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle_manifest.manifest(df).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute([r.asDict() for r in df.collect()])
    assert 0 < sum(r.verified for r in got) < len(got)


def test_ranks_follow_the_order_over_all_ranges(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("x"), "id")
    rows = merkle_manifest.ranked(df, ["x", "id"], "rank").collect()
    assert [r.rank for r in sorted(rows, key=lambda r: (r.x, r.id))] == list(range(1000))
    assert len({r.part for r in rows}) > 1


def test_heights(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 9, 10, 27, 28, 3**20, 3**20 + 1)], "n long")
    got = [r.h for r in rows.select(merkle_manifest.height_of(F.col("n")).alias("h")).collect()]
    assert got == [0, 1, 1, 2, 2, 3, 3, 4, 20, 21]
