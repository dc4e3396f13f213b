"""Packing documents into token sequences by patterns fitted to the length histogram.

Lengths are rounded up to a grid. All patterns of up to three lengths that fill
a sequence are enumerated, and their repeat counts are fitted to the histogram by
non-negative least squares. Counts are rounded down and kept within what
there is; what remains is packed by best fit, longest first, into the room that is
left. All of that works on the histogram, which has as many entries as a
sequence has tokens, and yields runs: "the r-th to s-th piece of this length go
to these sequences at this offset". Spark numbers the pieces of each length and
looks every piece's run up.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import numbered, written

SEQUENCE = 2048
GRID = 8
END = 0

Group = tuple[tuple[int, ...], int]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative ``x`` with least ``|a x - b|``, by an active set."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[inside] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-7 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        inside[j] = True
        while True:
            free = np.flatnonzero(inside)
            z = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[free] = z
                break
            old = x[free]
            low = z <= 0
            step = np.min(np.where(low, old / np.maximum(old - z, 1e-300), 1.0))
            x[free] = np.maximum(old + step * (z - old), 0)
            x[free[low & (x[free] <= 1e-12)]] = 0
            inside = x > 0
            if not inside.any():
                break
    return x


def patterns(units: int, present: list[int]) -> list[tuple[int, ...]]:
    """All multisets of one to three of the ``present`` lengths that sum to ``units``."""
    has = set(present)
    out = [(units,)] if units in has else []
    for a in present:
        if units - a in has and a >= units - a:
            out.append((a, units - a))
        for b in present:
            c = units - a - b
            if b <= a and 0 < c <= b and c in has:
                out.append((a, b, c))
    return out


def _take(left: dict[int, list[list[int]]], unit: int, count: int) -> list[tuple[int, int]]:
    """``count`` pieces of a grid unit, longest first, as (length, count)."""
    out = []
    while count:
        length, there = left[unit][0]
        used = min(there, count)
        out.append((length, used))
        count -= used
        left[unit][0][1] -= used
        if not left[unit][0][1]:
            left[unit].pop(0)
    return out


def _zip_runs(slots: list[list[tuple[int, int]]]) -> list[Group]:
    """Runs of several slots side by side, cut wherever one of them changes."""
    ends = [np.cumsum([n for _, n in runs]) for runs in slots]
    cuts = [0, *sorted({int(e) for x in ends for e in x})]
    return [
        (tuple(runs[int(np.searchsorted(e, lo, side="right"))][0] for runs, e in zip(slots, ends, strict=True)), hi - lo)
        for lo, hi in pairwise(cuts)
    ]


def fitted(histogram: dict[int, int], size: int = SEQUENCE, grid: int = GRID) -> tuple[list[Group], dict[int, int]]:
    """Groups of equal sequences by the fitted patterns, and the histogram of what remains."""
    units = size // grid
    left: dict[int, list[list[int]]] = {}
    for length in sorted(histogram, reverse=True):
        if histogram[length]:
            left.setdefault(-(-length // grid), []).append([length, histogram[length]])
    present = sorted(left)
    known = patterns(units, present)
    groups: list[Group] = []
    if known:
        row = {u: i for i, u in enumerate(present)}
        a = np.zeros((len(present), len(known)))
        for j, p in enumerate(known):
            for u in p:
                a[row[u], j] += 1
        b = np.array([sum(n for _, n in left[u]) for u in present], dtype=float)
        # Long lengths weigh more: an unplaced long piece costs more room.
        weight = np.array(present, dtype=float) / units
        repeats = np.floor(nnls(a * weight[:, None], b * weight) + 1e-6).astype(np.int64)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: (len(known[j]), known[j])):
            p = known[j]
            most = min(sum(n for _, n in left[u]) // p.count(u) if left[u] else 0 for u in p)
            if count := min(int(repeats[j]), most):
                groups += _zip_runs([_take(left, u, count) for u in p])
    return groups, {length: n for runs in left.values() for length, n in runs if n}


def best_fit(groups: list[Group], histogram: dict[int, int], size: int = SEQUENCE) -> list[Group]:
    """``groups`` with the pieces of ``histogram`` put, longest first, where the least room is left."""
    by_room: list[list[Group]] = [[] for _ in range(size + 1)]
    for lengths, n in groups:
        by_room[size - sum(lengths)].append((lengths, n))
    for length in sorted(histogram, reverse=True):
        todo, room = histogram[length], length
        while todo:
            while room <= size and not by_room[room]:
                room += 1
            if room > size:
                each = size // length
                full, rest = divmod(todo, each)
                if full:
                    by_room[size - each * length].append(((length,) * each, full))
                if rest:
                    by_room[size - rest * length].append(((length,) * rest, 1))
                break
            lengths, n = by_room[room].pop()
            used = min(n, todo)
            todo -= used
            if n > used:
                by_room[room].append((lengths, n - used))
            by_room[room - length].append(((*lengths, length), used))
            room = length  # the room left over may still take another of this length
    return [g for groups in by_room for g in groups]


def runs(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, offset, first sequence), ascending by length and rank."""
    ranks: dict[int, int] = {}
    out, base = [], 0
    for lengths, n in groups:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            ranks[length] = first + n
            out.append((length, first, offset, base))
            offset += length
        base += n
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file, whose ids follow the order of its merges."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in set(plain)):
        back[chr(256 + i)] = b
    file = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in file.get("added_tokens", [])}
    return {bytes(back[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}


class Encoder:
    """Ids as ``tokenizers`` gives them without special tokens, from a faster encoder of the same vocabulary.

    Texts that hold the string of a special token go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.slow = path, None
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
        self.fast = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the documents' ids, each ended by id 0, in pieces.

    Only documents longer than ``size`` are cut; the first piece takes what the full ones leave over.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path or tokenizer_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encoder.ids(text or ""), np.uint32(END)).astype("<u4")
                    first = len(ids) % size or min(size, len(ids))
                    cuts = [0, *range(first, len(ids) + 1, size)]
                    for k, (lo, hi) in enumerate(pairwise(cuts)):
                        rows.append((doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def packed(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, grid: int = GRID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row.

    A null text is empty and has one id, the end. Repeated rows are packed as
    often as they occur; rows without an id are packed like others. An empty table gives
    no rows. Columns other than ``doc_id`` and ``text`` are not read.
    """
    cut = written(pieces(docs, path, size), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    plan = runs(best_fit(*fitted(histogram, size, grid), size))
    ranked = numbered(cut, ["length"], ["doc_id", "piece"], "rank", slices=64)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] * 2**48 + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * 2**48 + rank, side="right") - 1
            sequence = plan[at, 3] + rank - plan[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(plan[at, 2])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
