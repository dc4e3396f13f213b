"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

A document is the set of its 5-word shingles. Every distinct set is sampled by
MinHash. Bands of samples propose candidates; the samples of a document, each
together with its place, are folded into a bitmap of parities (an odd sketch).
The population count of two bitmaps' XOR gives the size of the samples'
symmetric difference, hence the similarity, and drops the candidates that are
far off. A second odd sketch, of the whole set, bounds the difference of the
sets from below and so drops others with certainty. Both are conditions of the
join that pairs a bucket with its centers. What is left is confirmed on whole sets.

No bucket is ever paired with itself. First the members of a bucket are held
against one center of it, then against a few. By then almost all of a group of copies
are one component, and members of one component need no further look. A last
round holds those outside a bucket's largest component against its members, in
a grid of bounded cells. So no candidate pair of different components stays unlooked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import stage
from .components import components
from .shared import written
from .words import SPACED, Block, blocks, grams, mix

#: Samples in a band; the number of bands follows from the threshold and ``MISSED``.
ROWS = 5
#: Chance that a pair exactly at the threshold meets in no band.
MISSED = 1e-6
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 5.5
SKETCH_BITS = 512
#: Of the sketch of the whole set.
PARITY_BITS = 1024
#: Centers of a bucket in the rounds before the last.
STARS = (1, 8)
#: Most outsiders and members, about, that meet in one cell of the last round.
CELL = (1024, 4096)
#: Pairs whose whole sets a task holds at a time.
CONFIRMED = 256

_U = np.uint64


def bands_for(percent: int) -> int:
    t = percent / 100
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - t**ROWS))) if t < 1 else 1


def _shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles by text, ascending, and where each text begins."""
    found, owner = grams(block.hashes(), block.doc, block.texts, k)
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=block.texts))])
    for i in range(block.texts):
        found[at[i] : at[i + 1]].sort()
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=block.texts))])


def _sketched(block: Block, k: int, bands: int) -> dict[str, np.ndarray]:
    found, at = _shingles(block, k)
    size = np.diff(at)
    has = np.flatnonzero(size)
    begin = at[:-1][has]
    samples = bands * ROWS
    random = np.random.default_rng(11)
    factor = random.integers(1, 2**63, samples, dtype=np.uint64) * _U(2) + _U(1)
    shift = random.integers(1, 2**63, samples, dtype=np.uint64)
    least = np.empty((samples, len(has)), dtype=np.uint64)
    for j in range(samples if len(has) else 0):
        least[j] = np.minimum.reduceat(found * factor[j] + shift[j], begin)
    out = {"n": size}
    for name, salt in (("a", 1), ("b", 2)):  # 128 bits that stand for the set
        total = np.zeros(block.texts, dtype=np.uint64)
        if len(has):
            total[has] = np.add.reduceat(mix(found + _U(salt) * factor[0]), begin)
        out[name] = total.view(np.int64)
    keys = np.zeros((block.texts, bands), dtype=np.uint64)
    for i in range(bands):
        key = np.full(len(has), i + 1, dtype=np.uint64)
        for j in range(ROWS):
            key = mix(key ^ least[i * ROWS + j]) + _U(j)
        keys[has, i] = key
    out["bands"] = keys.view(np.int64)
    place = mix(least ^ mix(np.arange(1, samples + 1, dtype=np.uint64))[:, None])
    out["odd"] = _parities(place.ravel(), np.tile(has, samples), block.texts, SKETCH_BITS)
    out["parity"] = _parities(mix(found + factor[1]), np.repeat(np.arange(block.texts), size), block.texts, PARITY_BITS)
    return out


def _parities(values: np.ndarray, owner: np.ndarray, texts: int, bits: int) -> np.ndarray:
    """Of every text, one bit for each of ``bits`` places: whether an odd number of its values fell there."""
    cell = (values % _U(bits)).astype(np.int64) + owner * bits
    odd = (np.bincount(cell, minlength=texts * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(texts, bits), axis=1).view(np.int64)


def sketches(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``doc_id, n, a, b, bands, odd, parity`` of every document.

    ``n`` is the size of the shingle set, ``a`` and ``b`` stand for the set,
    ``bands`` are the keys under which near sets meet, ``odd`` and ``parity`` are the odd
    sketches of the samples and of the whole set, as longs.
    """
    bands = bands_for(percent)
    schema = "doc_id long, n long, a long, b long, bands array<long>, odd array<long>, parity array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), SPACED):
                x = _sketched(block, k, bands)
                lists = [
                    pa.ListArray.from_arrays(
                        np.arange(0, len(v) * v.shape[1] + 1, v.shape[1], dtype=np.int32), pa.array(v.ravel())
                    )
                    for v in (x["bands"], x["odd"], x["parity"])
                ]
                ids = batch.column(0).slice(block.first, block.texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(x["n"]), pa.array(x["a"]), pa.array(x["b"]), *lists],
                    names=["doc_id", "n", "a", "b", "bands", "odd", "parity"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def differing(left: str, right: str, bits: int) -> Column:
    """Population count of the XOR of two bitmaps."""
    words = [F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(bits // 64)]
    return sum(words[1:], words[0])


def possible(percent: int, samples: int) -> Column:
    """Whether the rows' sizes and sketches (``n``, ``odd``, ``parity``, and ``c_`` of the center) allow a link.

    Sizes and the sketch of the whole set rule out with certainty: every odd
    place of the XOR holds a shingle that only one of the sets has.
    """
    sizes = F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * percent
    apart = differing("parity", "c_parity", PARITY_BITS) * (100 + percent) <= (F.col("n") + F.col("c_n")) * (100 - percent)
    return sizes & apart & (differing("odd", "c_odd", SKETCH_BITS) <= most_differing(percent, samples))


def estimate(differ: int, samples: int) -> float:
    """Similarity of two documents whose odd sketches differ in so many bits."""
    inner = 1 - 2 * differ / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * samples) * math.log(inner) if inner > 0 else -math.inf


def most_differing(percent: int, samples: int) -> int:
    """The most bits in which odd sketches differ whose estimate is not too low."""
    least = least_estimate(percent, samples)
    return max(d for d in range(SKETCH_BITS) if estimate(d, samples) >= least)


def least_estimate(percent: int, samples: int) -> float:
    t = percent / 100
    difference = 2 * samples * (1 - t)
    bits = SKETCH_BITS / 4 * (1 - math.exp(-4 * difference / SKETCH_BITS))
    spread = t * (1 - t) / samples + bits / (2 * samples) ** 2
    return t - SLACK * math.sqrt(spread)


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CONFIRMED):
            part = batch.slice(at, CONFIRMED)
            sides = []
            for column in (2, 3):
                sets = []
                for block in blocks(part.column(column), SPACED):
                    found, begin = _shingles(block, k)
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


def linked(docs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """``rep``, ``root`` for the representatives of distinct sets that have a link."""
    spark = docs.sparkSession
    samples = bands_for(percent) * ROWS
    full = sets.where("n > 0 and doc_id is not null")
    first = full.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    reps = written(
        full.join(first, ["a", "b", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n", "bands", "odd", "parity"),
        "reps",
    )
    sketch = reps.select("rep", "n", "odd", "parity")
    keys = reps.select(F.explode("bands").alias("band"), "rep")
    shared = keys.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("band")
    members = written(keys.join(shared, "band", "left_semi"), "members")
    comps = spark.createDataFrame([], "rep long, root long")
    tested = spark.createDataFrame([], "u long, v long")
    for turn, stars in enumerate((*STARS, None)):
        placed = members.join(comps, "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("root"))
        open_ = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        live = written(placed.join(open_.select("band"), "band", "left_semi"), "live")
        if live.isEmpty():
            break
        if stars:
            centers = written(_stars(live, stars, turn), "centers")
            members = live.select("band", "rep").join(
                centers.select("band", F.col("center").alias("rep")), ["band", "rep"], "left_anti"
            )
            held = centers.join(
                sketch.select(F.col("rep").alias("center"), *[F.col(c).alias(f"c_{c}") for c in ("n", "odd", "parity")]),
                "center",
            )
            near = (F.col("root") != F.col("center_root")) & possible(percent, samples)
            pairs = live.join(sketch, "rep").join(held, "band").where(near)
            pairs = pairs.select(F.least("rep", "center").alias("u"), F.greatest("rep", "center").alias("v"))
        else:
            cells = _cells(live).join(sketch, "rep").repartition("band", "block", "slice")
            cells = cells.sortWithinPartitions("band", "block", "slice", F.desc("outsider")).select(*CELL_COLUMNS)
            pairs = cells.mapInArrow(lambda batches: _in_cells(batches, percent, samples), "u long, v long")
        pairs = written(pairs.distinct().join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        comps = written(_joined(comps, confirmed(pairs, docs, percent, k)), "comps")
    return comps


def _stars(live: DataFrame, stars: int, turn: int) -> DataFrame:
    """Up to ``stars`` centers of every bucket."""
    deal = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(stars))
    least = live.groupBy("band", deal.alias("deal")).agg(F.min("rep").alias("center"), F.min_by("root", "rep").alias("center_root"))
    return least.select("band", "center", "center_root")


def _cells(live: DataFrame) -> DataFrame:
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


CELL_COLUMNS = ("band", "block", "slice", "outsider", "rep", "root", "n", "odd", "parity")


def _in_cells(batches: Iterator[pa.RecordBatch], percent: int, samples: int) -> Iterator[pa.RecordBatch]:
    """Pairs of an outsider and a member of its cell that may be linked; rows come by cell, outsiders first."""
    most, cell, held = most_differing(percent, samples), None, []
    for batch in batches:
        flat = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        band, block, part, outsider = flat[:4]
        lists = [batch.column(i).flatten().to_numpy().view(_U).reshape(batch.num_rows, -1) for i in (7, 8)]
        rows = (*flat[4:], *lists)
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (band[1:] != band[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (outsider[1:] != outsider[:-1])
        edges = [*np.flatnonzero(new), batch.num_rows]
        found = []
        for lo, hi in zip(edges, edges[1:]):
            here = (band[lo], block[lo], part[lo])
            if here != cell:
                cell, held = here, []
            run = [x[lo:hi] for x in rows]
            if outsider[lo]:
                held.append(run)
                continue
            for centers in held:
                step = max(1, 65_536 // len(centers[0]))
                found += [_near(centers, [x[i : i + step] for x in run], percent, most) for i in range(0, hi - lo, step)]
        u, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _near(centers: list[np.ndarray], members: list[np.ndarray], percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs for which ``possible`` holds."""
    (c_rep, c_root, c_n, c_odd, c_parity), (rep, root, n, odd, parity) = centers, members
    sizes = np.minimum(c_n[:, None], n) * 100 >= np.maximum(c_n[:, None], n) * percent
    i, j = np.nonzero(sizes & (c_root[:, None] != root))
    for left, right, limit in (
        (c_parity, parity, (c_n[i] + n[j]) * (100 - percent) // (100 + percent)),
        (c_odd, odd, np.full(len(i), most)),
    ):
        differ = np.zeros(len(i), dtype=np.int64)
        for word in range(left.shape[1]):
            differ += np.bitwise_count(left[i, word] ^ right[j, word])
        good = differ <= limit[: len(i)]
        i, j = i[good], j[good]
    return c_rep[i], rep[j]


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
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


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Two documents are linked when their sets of ``k``-word shingles share at
    least ``percent`` hundredths of their union. ``component_id`` is the least
    id reachable by links; ``kept`` marks the documents that bear it.

    Texts that are null, empty or without words have an empty set and no link.
    A text of fewer than ``k`` words is one shingle. Equal sets are always
    linked, whatever their number. Rows without an id are linked with nothing
    and have no component; they are kept. Rows that repeat an id and a set share
    one component. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(sketches(docs, percent, k), "sketches")
    roots = linked(docs, sets, percent, k)
    full = sets.where("n > 0 and doc_id is not null")
    classes = full.groupBy("a", "b").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(roots, "rep", "left").select(
        F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("root", "rep").alias("component_id")
    )
    here = (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    joined = sets.select("doc_id", "n", "a", "b").join(classes, here, "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component of near duplicates, the one with the least id.

    Of rows that repeat an id one stays. Rows without an id all stay.
    """
    found = near_duplicates(docs, percent)
    copies = stage(found.where("not kept").select("doc_id").distinct(), name="llm-copies").sized()
    repeats = stage(found.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), name="llm-repeats")
    stay = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    if not repeats.count:
        return stay
    again = stay.join(repeats.sized(), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return stay.join(repeats.sized(), "doc_id", "left_anti").select(*docs.columns).unionByName(again)
