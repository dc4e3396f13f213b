"""Jaccard join of word n-grams over parity sketches.

A document is the set of its distinct ``k``-word shingles. Sets that share
``percent`` hundredths of their union differ in at most (100 - percent) / (100 + percent) of the
sum of their sizes. Sizes fall into bands, and in each band that bound is a number d. Every
shingle flips one bit of a sketch of d + 1 words of 64 bits. What two sets share
cancels out, so the Hamming distance of their sketches is a lower bound of the size of their symmetric
difference: it is d at most for linked sets, and then one of the d + 1 words is equal. Sets of a
band that have a word in common are candidates, those whose sketches differ in more bits than their
sizes allow are dropped, and the rest is verified on whole sets. A set near the upper end of its band
also gets a sketch of the next one. So no link is lost.

No bucket of equal words is paired with itself: see ``linking``. Its last round has a second sketch
of a fixed size at hand, which bounds the difference in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import linking
from .shared import written
from .words import SPACED, Block, blocks, mix

#: Sizes of a band differ by a fifth at most, or not at all.
BAND = (6, 5)
#: Words of the sketch of fixed size.
FOLD = 16

_U = np.uint64


def band_edges(largest: int) -> np.ndarray:
    """The least size of each band from 1 to that of ``largest``, and of the two after it."""
    edges = [1, 2, 3]
    while edges[-2] <= largest:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * BAND[0] // BAND[1])))
    return np.array(edges, dtype=np.int64)


def most_apart(sizes: np.ndarray | Column, percent: int) -> np.ndarray | Column:
    """100 + ``percent`` times the largest symmetric difference that linked sets have, from the sum of their sizes."""
    return sizes * (100 - percent)


def sketch_words(edges: np.ndarray, percent: int) -> np.ndarray:
    """Words of the sketches of each band but the last: one more than the bits in which linked sets may differ."""
    return most_apart(2 * (edges[1:] - 1), percent) // (100 + percent) + 1


def _parities(spread: np.ndarray, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sketches, one after the other: of owner i, ``words[i]`` words into which its values' bits are XORed."""
    out = np.zeros(int(words.sum()), dtype=np.uint64)
    if len(spread):
        begin = np.concatenate([[0], np.cumsum(words)])[:-1]
        word = begin[owner] + (spread % words[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        word, bit = word[order], _U(1) << (spread[order] >> _U(58))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_xor.reduceat(bit, first)
    return out.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))


def _sketched(block: Block, k: int, percent: int) -> list[pa.Array]:
    found, at = linking.shingles(block, k)
    size = np.diff(at)
    owner = np.repeat(np.arange(block.texts), size)
    columns = [pa.array(size)]
    has = np.flatnonzero(size)
    for salt in (0xA24BAED4963EE407, 0x2545F4914F6CDD1D):  # 128 bits that stand for the set
        total = np.zeros(block.texts, dtype=np.uint64)
        if len(has):
            total[has] = np.add.reduceat(mix(found + _U(salt)), at[:-1][has])
        columns.append(pa.array(total.view(np.int64)))
    spread = mix(found ^ _U(0x9FB21C651E98DF25))
    edges = band_edges(int(size.max(initial=1)))
    words = sketch_words(edges, percent)
    band = np.searchsorted(edges, np.maximum(size, 1), side="right") - 1
    # A band whose sketch has a single word holds no links between different sets.
    own = np.where((size > 0) & (words[band] > 1), words[band], 0)
    reaches = (size > 0) & (100 * size >= percent * edges[band + 1]) & (words[band + 1] > 1)
    above = np.where(reaches, words[band + 1], 0)
    columns.append(pa.array(band.astype(np.int32)))
    for count in (own, above):
        mine = count[owner] > 0
        columns.append(_lists(_parities(spread[mine], owner[mine], count), count))
    fold = np.full(block.texts, FOLD)
    columns.append(_lists(_parities(spread, owner, fold), fold))
    return columns


def sketches(docs: DataFrame, percent: int = 80, k: int = 3) -> DataFrame:
    """``doc_id, n, a, b, band, words, above, fold`` of every document.

    ``n`` is the size of the shingle set, ``a`` and ``b`` stand for it; ``words`` is its sketch in ``band``, ``above`` that
    in the next band, empty where no links can be; ``fold`` is the sketch of fixed size.
    """
    names = ["doc_id", "n", "a", "b", "band", "words", "above", "fold"]
    schema = "doc_id long, n long, a long, b long, band int, words array<long>, above array<long>, fold array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), SPACED):
                ids = batch.column(0).slice(block.first, block.texts)
                yield pa.RecordBatch.from_arrays([ids, *_sketched(block, k, percent)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _in_bands(reps: DataFrame) -> DataFrame:
    """``rep, n, in_band, words``: the sketches that there are."""
    own = reps.select("rep", "n", F.col("band").alias("in_band"), "words")
    above = reps.select("rep", "n", (F.col("band") + 1).alias("in_band"), F.col("above").alias("words"))
    return own.unionByName(above).where(F.size("words") > 0)


def differing(left: str, right: str) -> Column:
    """Hamming distance of two sketches of a band."""
    bits = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def _may_link(pairs: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``u, v, in_band``) whose sketches differ in no more bits than linked sets would."""
    left = bands.select(F.col("rep").alias("u"), "in_band", F.col("n").alias("nu"), F.col("words").alias("wu"))
    right = bands.select(F.col("rep").alias("v"), "in_band", F.col("n").alias("nv"), F.col("words").alias("wv"))
    both = pairs.join(left, ["u", "in_band"]).join(right, ["v", "in_band"])
    near = differing("wu", "wv") * (100 + percent) <= most_apart(F.col("nu") + F.col("nv"), percent)
    return both.where(near).select("u", "v")


_CELL_COLUMNS = ("band", "block", "slice", "outsider", "rep", "root", "n", "fold")


def _in_cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of an outsider and a member of its cell that may be linked; rows come by cell, outsiders first."""
    cell, held = None, []
    for batch in batches:
        flat = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        fold = batch.column(7).flatten().to_numpy().view(_U).reshape(batch.num_rows, FOLD)
        rows = (*flat[4:], fold)
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in flat[:4]])
        edges = [*np.flatnonzero(new), batch.num_rows]
        found = []
        for lo, hi in zip(edges, edges[1:]):
            here = tuple(x[lo] for x in flat[:3])
            if here != cell:
                cell, held = here, []
            run = [x[lo:hi] for x in rows]
            if flat[3][lo]:
                held.append(run)
                continue
            for outsiders in held:
                step = max(1, 65_536 // len(outsiders[0]))
                found += [_near(outsiders, [x[i : i + step] for x in run], percent) for i in range(0, hi - lo, step)]
        u, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _near(outsiders: list[np.ndarray], members: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components whose sizes and sketches allow a link."""
    (o_rep, o_root, o_n, o_fold), (rep, root, n, fold) = outsiders, members
    sizes = np.minimum(o_n[:, None], n) * 100 >= np.maximum(o_n[:, None], n) * percent
    i, j = np.nonzero(sizes & (o_root[:, None] != root))
    differ = np.bitwise_count(o_fold[i] ^ fold[j]).sum(1, dtype=np.int64)
    good = differ * (100 + percent) <= most_apart(o_n[i] + n[j], percent)
    return o_rep[i[good]], rep[j[good]]


def linked(docs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """``rep, root`` for the least documents of the distinct sets that have a link to another set."""
    spark = docs.sparkSession
    full = sets.where("n > 0 and doc_id is not null")
    first = full.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    chosen = full.join(first, ["a", "b", "doc_id"], "left_semi")
    reps = written(chosen.select(F.col("doc_id").alias("rep"), "n", "band", "words", "above", "fold"), "reps")
    bands = _in_bands(reps)
    # What is called a band in ``linking`` is a bucket here: one word of the sketches of a band.
    keys = bands.select("rep", "in_band", F.posexplode("words").alias("at", "word"))
    keys = keys.select(F.xxhash64("in_band", "at", "word").alias("band"), "rep")
    shared = keys.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("met > 1").drop("met")
    # Only what is left of the keys gets the sizes and the own bands of its documents.
    sizes = reps.select("rep", "n", F.col("band").alias("in_band"))
    members = written(written(shared, "shared").join(sizes, "rep"), "members")
    comps = spark.createDataFrame([], "rep long, root long")
    tested = spark.createDataFrame([], "u long, v long")
    for turn, stars in enumerate((*linking.STARS, None)):
        live = written(linking.still_open(members, comps), "live")
        if live.isEmpty():
            break
        if stars:
            centers = written(linking.centers_of(live, stars, turn, ["n", "in_band"]), "centers")
            members = live.drop("root").join(centers.select("band", F.col("center").alias("rep")), ["band", "rep"], "left_anti")
            sizes = F.least("n", "center_n") * 100 >= F.greatest("n", "center_n") * percent
            met = live.join(centers, "band").where(sizes & (F.col("root") != F.col("center_root")))
            # Documents that meet have sketches in the greater of their own bands.
            both = F.greatest("in_band", "center_in_band").alias("in_band")
            met = met.select(F.least("rep", "center").alias("u"), F.greatest("rep", "center").alias("v"), both)
            met = met.distinct().join(tested, ["u", "v"], "left_anti")
            pairs = _may_link(met, bands, percent)
        else:
            dealt = linking.cells(live).join(reps.select("rep", "n", "fold"), "rep").repartition("band", "block", "slice")
            dealt = dealt.sortWithinPartitions("band", "block", "slice", F.desc("outsider")).select(*_CELL_COLUMNS)
            pairs = dealt.mapInArrow(lambda batches: _in_cells(batches, percent), "u long, v long")
            pairs = pairs.distinct().join(tested, ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        tested = tested.unionByName(pairs)
        comps = written(linking.joined(comps, linking.confirmed(pairs, docs, percent, k)), "comps")
    return comps


def ngram_components(docs: DataFrame, percent: int = 80, k: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two documents are linked when their sets of distinct ``k``-word shingles share at least ``percent``
    hundredths of their union; ``component_id`` is the least id reachable by links, the own one included.

    Texts that are null, empty or without words have an empty set and no link. A text of fewer than
    ``k`` words is one shingle. Equal sets are linked, whatever their number. Rows without an id are linked with
    nothing and have no component. Rows that repeat an id and a set share one component. An empty table
    gives no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(sketches(docs, percent, k), "sketches")
    return linking.with_components(sets, linked(docs, sets, percent, k))
