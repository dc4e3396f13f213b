"""Steps of a join of similar texts: shingle sets, buckets held against centers, confirmation, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import stage
from .components import components
from .shared import written
from .words import SPACED, Block, blocks, grams

#: Centers of a bucket in the rounds before the last.
STARS = (1, 8)
#: Most outsiders and members, about, that meet in one cell of the last round.
CELL = (1024, 4096)
#: Pairs whose whole sets a task holds at a time.
CONFIRMED = 256
#: Over how many tasks the copies of one set are dealt.
SLICES = 64


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles by text, ascending, and where each text begins."""
    found, owner = grams(block.hashes(), block.doc, block.texts, k)
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=block.texts))])
    for i in range(block.texts):
        found[at[i] : at[i + 1]].sort()
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=block.texts))])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CONFIRMED):
            part = batch.slice(at, CONFIRMED)
            sides = []
            for column in (2, 3):
                sets = []
                for block in blocks(part.column(column), SPACED):
                    found, begin = shingles(block, k)
                    sets += [found[begin[i] : begin[i + 1]] for i in range(block.texts)]
                sides.append(sets)
            good = np.zeros(part.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield part.select([0, 1]).filter(pa.array(good))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Those of ``pairs`` (``u``, ``v``) that are near enough by their whole shingle sets."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    wanted = stage(ids, name="llm-wanted").sized()
    texts = docs.select(F.col("doc_id").cast("long").alias("x"), F.col("text").alias("t")).join(wanted, "x", "left_semi")
    first = pairs.join(texts.select(F.col("x").alias("u"), F.col("t").alias("s")), "u")
    whole = first.join(texts.withColumnRenamed("x", "v"), "v").select("u", "v", "s", "t")
    return whole.mapInArrow(lambda batches: _confirm(batches, k, percent), "u long, v long")


def still_open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``members`` (``band``, ``rep`` and more) with ``root``, of the buckets that hold several components."""
    placed = members.join(comps, "rep", "left").select(*members.columns, F.coalesce("root", "rep").alias("root"))
    roots = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    # Written, so that the join has an exchange on both sides and large buckets can be split.
    several = written(roots.select("band"), "several")
    return placed.join(several, "band", "left_semi")


def centers_of(live: DataFrame, stars: int, turn: int, columns: list[str] = ()) -> DataFrame:
    """Up to ``stars`` centers of every bucket, with their ``center_root`` and ``center_`` of other columns."""
    deal = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(stars))
    more = [F.min_by(c, "rep").alias(f"center_{c}") for c in ("root", *columns)]
    least = live.groupBy("band", deal.alias("deal")).agg(F.min("rep").alias("center"), *more)
    return least.drop("deal")


def cells(live: DataFrame) -> DataFrame:
    """Rows outside their bucket's largest component, and all rows, dealt to the cells of a grid.

    An outsider meets every row of its bucket in exactly one cell.
    """
    sizes = live.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    grid = sizes.groupBy("band").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("rows"), F.max("size").alias("most")
    )
    grid = grid.select(
        "band",
        "main",
        F.ceil((F.col("rows") - F.col("most")) / CELL[0]).cast("int").alias("blocks"),
        F.ceil(F.col("rows") / CELL[1]).cast("int").alias("slices"),
    )
    dealt = live.join(written(grid, "grid"), "band")

    def own(seed: int, of: str) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(of)).cast("int")

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    key = ["band", "rep", "root"]
    outsiders = dealt.where("root <> main").select(*key, own(1, "blocks").alias("block"), each("slices").alias("slice"), F.lit(True).alias("outsider"))
    return outsiders.unionByName(
        dealt.select(*key, each("blocks").alias("block"), own(2, "slices").alias("slice"), F.lit(False).alias("outsider"))
    )


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after ``links`` between their nodes, or nodes not in them yet."""
    lead = comps.select(F.col("rep").alias("x"), "root")
    ends = links.join(lead.select(F.col("x").alias("u"), F.col("root").alias("ru")), "u", "left").join(
        lead.select(F.col("x").alias("v"), F.col("root").alias("rv")), "v", "left"
    )
    merged = components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
    moved = comps.join(merged.select(F.col("u").alias("root"), F.col("root").alias("to")), "root", "left").select(
        "rep", F.coalesce("to", "root").alias("root")
    )
    return moved.unionByName(merged.select(F.col("u").alias("rep"), "root").join(comps, "rep", "left_anti"))


def with_components(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``sets`` (``doc_id, n, a, b``, the last two standing for the set).

    ``roots`` has ``rep`` and ``root`` of the least documents of the sets that are linked. The copies of
    a set are dealt to ``SLICES`` before anything brings them together. Rows without a set or an id are their own.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("part")
    rows = sets.select("doc_id", "n", "a", "b", part)
    full = rows.where("n > 0 and doc_id is not null")
    parts = full.groupBy("a", "b", "part").agg(F.min("doc_id").alias("rep"))
    classes = parts.groupBy("a", "b").agg(F.min("rep").alias("rep")).join(roots, "rep", "left")
    classes = classes.select("a", "b", F.coalesce("root", "rep").alias("component_id"))
    # A set has SLICES rows here at most, whatever its copies.
    known = parts.drop("rep").join(classes, ["a", "b"])
    found = full.join(known, ["a", "b", "part"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(rest)
