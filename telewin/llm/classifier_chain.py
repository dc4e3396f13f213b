"""Toxicity by a chain of linear classifiers over words and word beginnings.

Categories are predicted one after another. Each is a logistic regression whose
inputs are the words and word beginnings of a text (present or not) and the
probabilities of the categories before. While training, those probabilities are
out of fold: a document's come from models that have not seen it, as will be the case for
new documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import labelled_sample
from .shared import written
from .words import LETTERS_DIGITS, Block, blocks, mix

#: Labelled documents that are learned from, at most (about), and inputs that are kept.
TRAINING_ROWS, INPUTS = 12_000, 2_000
#: Bytes of the word beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS = 5
_TABLE = 2**20


class Chain(NamedTuple):
    inputs: np.ndarray  # hashes of words and beginnings, ascending
    names: list[str]
    weights: list[np.ndarray]  # by category: inputs, earlier probabilities, intercept


def _kinds(block: Block) -> Iterator[np.ndarray]:
    """Hashes of the whole words, then of their beginnings (whole words that are too short repeat)."""
    yield block.hashes()
    for n in BEGINNINGS:
        yield mix(block.hashes(n) + np.uint64(n))


def _present(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct inputs of the texts of a block, with their texts."""
    found = np.concatenate(list(_kinds(block)))
    owner = np.tile(block.doc, 1 + len(BEGINNINGS))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def _inputs(sample: DataFrame, columns: list[str]) -> DataFrame:
    """``doc_id``, the labels and ``inputs``, the distinct inputs of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), LETTERS_DIGITS):
                found, owner = _present(block)
                at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=block.texts))]).astype(np.int32)
                part = batch.slice(block.first, block.texts)
                lists = pa.ListArray.from_arrays(at, pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], lists], names=["doc_id", *columns, "inputs"]
                )

    kinds = ", ".join(f"{c} int" for c in columns)
    return sample.select("doc_id", "text", *columns).mapInArrow(run, f"doc_id long, {kinds}, inputs array<long>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Matrix(NamedTuple):
    """Sparse 0/1 rows with a few dense columns."""

    row: np.ndarray
    column: np.ndarray
    n: int
    width: int
    dense: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.bincount(self.row, w[self.column], minlength=self.n)
        return out + self.dense @ w[self.width : -1] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.column, r[self.row], minlength=self.width)
        return np.concatenate([sparse, self.dense.T @ r, [r.sum()]])

    def take(self, keep: np.ndarray) -> _Matrix:
        where = np.cumsum(keep) - 1
        has = keep[self.row]
        return _Matrix(where[self.row[has]], self.column[has], int(keep.sum()), self.width, self.dense[keep])


def _regress(x: _Matrix, y: np.ndarray, penalty: float = 0.3, rounds: int = 200) -> np.ndarray:
    """Logistic regression with squared penalty, by accelerated gradients scaled by column."""
    w = np.zeros(x.width + x.dense.shape[1] + 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    size = x.back(np.ones(x.n))
    size[x.width : -1] = (x.dense**2).sum(0)
    # Rows of many inputs would overshoot: each column's step is divided by the mean number of inputs.
    per_row = 1 + len(x.row) / max(1, x.n)
    step = 1 / (0.25 * size * per_row + penalty)
    limit = np.full(len(w), penalty)
    limit[-1] = 0
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        slope = x.back(_sigmoid(x.times(ahead)) - y) + limit * ahead
        new = ahead - step * slope
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        back = new - w
        if float(slope @ back) > 0:  # past the least: begin anew
            t_new, ahead = 1.0, new.copy()
        else:
            ahead = new + (t - 1) / t_new * back
        w, t = new, t_new
    return w


def fit(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, bound: int = TRAINING_ROWS) -> Chain:
    """A chain over the 0/1 columns ``categories`` of ``labels``, in that order; the last one decides.

    With the single column ``toxic`` (the default) two kinds of it go before: ``insult``,
    toxic documents that hold a word found in toxic documents only, and ``veiled``,
    toxic documents that hold none. Learns from at most about ``bound``
    labelled documents. Without labels of both kinds the probability is constant.
    """
    categories = categories or ["toxic"]
    decisive = categories[-1]
    sample = written(_inputs(labelled_sample(docs, labels, categories, bound), categories), "inputs")
    n, bad = sample.agg(F.count(F.lit(1)), F.sum(decisive)).first()
    bad = bad or 0
    share = (bad + 0.5) / (n + 1)
    counts = sample.select(decisive, F.explode("inputs").alias("x")).groupBy("x").agg(
        F.count(F.lit(1)).alias("n"), F.sum(decisive).alias("bad")
    )
    excess = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    chosen = counts.where("n >= 3").withColumn("z", excess).where("z >= 3").orderBy(F.desc("z"), "x").limit(INPUTS).collect()
    inputs = np.array(sorted(r["x"] for r in chosen), dtype=np.int64)
    certain = np.array(sorted(r["x"] for r in chosen if r["bad"] == r["n"] and r["n"] >= 5), dtype=np.int64)
    rows = _narrowed(sample, categories, inputs).orderBy("doc_id").collect()  # as many as the sample has
    y = {c: np.array([r[c] for r in rows], dtype=float) for c in categories}
    if len(categories) == 1:
        marked = np.array([bool(np.isin(r["inputs"], certain).any()) for r in rows], dtype=bool)
        y = {"insult": y[decisive] * marked, "veiled": y[decisive] * ~marked, decisive: y[decisive]}
    row = np.repeat(np.arange(len(rows)), [len(r["inputs"]) for r in rows])
    column = np.searchsorted(inputs, np.array([x for r in rows for x in r["inputs"]], dtype=np.int64))
    fold = np.array([(r["doc_id"] * 2654435761 % 2**32 >> 7) % FOLDS for r in rows], dtype=int)
    dense = np.zeros((len(rows), 0))
    weights = []
    for target in y.values():
        x = _Matrix(row, column, len(rows), len(inputs), dense)
        weights.append(_regress(x, target))
        unseen = np.zeros(len(rows))
        for k in range(FOLDS):
            out = fold == k
            if out.any():
                unseen[out] = _sigmoid(x.take(out).times(_regress(x.take(~out), target[~out])))
        dense = np.column_stack([dense, unseen])
    return Chain(inputs.view(np.uint64), list(y), weights)


def _narrowed(sample: DataFrame, categories: list[str], inputs: np.ndarray) -> DataFrame:
    """``sample`` with only those of its ``inputs`` that are among the chosen ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(categories) + 1)
            value = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            good = np.isin(value, inputs)
            at = np.concatenate([[0], np.cumsum(np.bincount(owner[good], minlength=len(lists)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(categories) + 1], pa.ListArray.from_arrays(at, pa.array(value[good]))],
                names=batch.schema.names,
            )

    return sample.select("doc_id", *categories, "inputs").mapInArrow(run, sample.schema)


class _Scorer:
    """A chain with a table that tells which hashes may be inputs."""

    def __init__(self, chain: Chain):
        self.chain, self.maybe = chain, np.zeros(_TABLE, dtype=bool)
        self.order = np.argsort(chain.inputs)
        self.sorted = chain.inputs[self.order]
        self.maybe[(chain.inputs % np.uint64(_TABLE)).astype(np.int64)] = True

    def __call__(self, block: Block) -> np.ndarray:
        """Probabilities of every text and category."""
        owners, places = [], []
        for found in _kinds(block) if len(self.sorted) else ():
            at = np.flatnonzero(self.maybe[(found % np.uint64(_TABLE)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.sorted, found[at]), len(self.sorted) - 1)
            good = self.sorted[place] == found[at]
            owners.append(block.doc[at[good]])
            places.append(self.order[place[good]])
        width = len(self.chain.inputs)
        if owners:
            pairs = np.unique(np.concatenate(owners) * max(1, width) + np.concatenate(places))
        else:
            pairs = np.zeros(0, np.int64)
        x = _Matrix(pairs // max(1, width), pairs % max(1, width), block.texts, width, np.zeros((block.texts, 0)))
        for w in self.chain.weights:
            x = x._replace(dense=np.column_stack([x.dense, _sigmoid(x.times(w))]))
        return x.dense


def scores(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, ``p_`` and the category for each category, and the last one's name: 1 from probability 0.5 on."""
    names = [f"p_{c}" for c in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(chain)
        for batch in batches:
            for block in blocks(batch.column(1), LETTERS_DIGITS):
                p = scorer(block)
                verdict = (p[:, -1] >= 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.texts),
                        *[pa.array(p[:, j]) for j in range(p.shape[1])],
                        pa.array(verdict),
                    ],
                    names=["doc_id", *names, chain.names[-1]],
                )

    kinds = ", ".join(f"{c} double" for c in names)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, f"doc_id long, {kinds}, {chain.names[-1]} int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, p_insult, p_veiled, p_toxic, toxic`` of every row.

    Null and empty texts hold no inputs and get the probability of a text without any. Rows
    without an id are scored like others, repeated rows alike. An empty table gives no
    rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    return scores(docs, fit(docs, labels))


def clean_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose last probability is 0.5 or more."""
    chain = fit(docs, labels)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(chain)
        for batch in batches:
            good = [scorer(block)[:, -1] < 0.5 for block in blocks(batch.column(text), LETTERS_DIGITS)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
