"""A Merkle manifest of documents, with the proofs of all leaves by pointer jumping.

Documents are leaves. Per source, ascending by id, every ``ARITY`` successive nodes
become their parent until one is left, the source's subroot; the subroots, ordered by source,
become the root the same way. A node is known by its tree, level and place.

Every node first holds the segment to its parent: its place among the siblings and
their digests. Then the nodes are joined with themselves: a node adds the segment of the
ancestor it points to and points to where that one does. So the distance doubles, and
after logarithmically many joins in the depth of the tree every leaf has reached the root.

Digests are kept as 32 bytes and hashed as hex text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workspace import BROADCAST_BYTES, BROADCAST_ROWS, stage
from .shared import discarded, written

ARITY = 3
#: Levels that are hashed at once, in blocks of ARITY**LEVELS successive nodes.
LEVELS = 4
#: The tree of the subroots; trees of sources are numbered from 0.
TOP = -1
#: Bytes that a step of a segment takes in memory, about.
STEP_BYTES = 100
_BINARIES = "array<binary>"


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``rid, source, doc`` of every row, ``doc`` being the id, the leaf and what it is after tampering.

    Texts of ids whose crc32 is even lose their line ends; elsewhere ``tampered`` is null.
    """
    ids = docs["doc_id"].cast("string")
    known = F.concat(*[field(docs[c]) for c in ("doc_id", "source", "lang", "n_chars")])
    digest = lambda text: F.unhex(_sha(F.concat(known, field(text))))
    changed = F.crc32(F.encode(ids, "UTF-8")) % 2 == 0
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        docs["source"].cast("string").alias("source"),
        docs["doc_id"].cast("long").alias("doc_id"),
        digest(docs["text"]).alias("leaf"),
        F.when(changed, digest(F.replace(docs["text"], F.lit("\n"), F.lit("")))).alias("tampered"),
    )


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the rows in order counted from 0, and ``part``, the range a row lies in.

    Rows are dealt into ranges of the order and sorted there. ``order`` must tell apart rows that are many.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # This id has the task above and the row in the task below.
    ranges = written(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", 33))
    # One row for each task.
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    whole = F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1))
    return ranges.join(F.broadcast(before), "part").withColumn(out, whole).drop("at", "before")


def height_of(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**i) for i in range(39)]), lambda x: x < n))


def placed(rows: DataFrame) -> DataFrame:
    """``tree, place, height, digest, doc`` of all leaves: the rank of their source, their rank in it, its levels."""
    order = ranked(rows, ["source", "doc_id", "leaf", "rid"], "rank")
    # A source with many rows has one run in each of many ranges.
    runs = order.groupBy("part", "source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = stage(runs, name="llm-runs").rows
    sources = runs.groupBy("source").agg(F.min("first").alias("begin"), F.sum("n").alias("n"))
    trees = ranked(sources, ["begin"], "tree").select(
        F.col("source").alias("same"), "tree", "begin", height_of(F.col("n")).alias("height")
    )
    of_source = F.col("source").eqNullSafe(F.col("same"))
    known = runs.select(F.col("part").alias("in_part"), "source").join(stage(trees, name="llm-trees").sized(), of_source)
    known = stage(known.drop("source"), name="llm-known").sized()
    both = order.join(known, (F.col("part") == F.col("in_part")) & of_source)
    doc = F.struct("doc_id", "leaf", "tampered").alias("doc")
    return both.select("tree", (F.col("rank") - F.col("begin")).alias("place"), "height", F.col("leaf").alias("digest"), doc)


def _parents(nodes: Column) -> Column:
    """The digests of the parents of successive nodes."""
    joined = lambda run: F.array_join(F.transform(run, _text), "")
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.unhex(_sha(joined(F.slice(nodes, i * ARITY + 1, ARITY)))))


def _blocks(base: DataFrame, level: int) -> DataFrame:
    """Blocks of nodes of ``level``: ``tree, block, height``, the nodes' ``docs``, and digests ``n0`` to those LEVELS above.

    Above the end of a tree the digests are empty. A block has ARITY**LEVELS nodes at most.
    """
    block = F.floor(F.col("place") / ARITY**LEVELS).cast("long").alias("block")
    rows = F.sort_array(F.collect_list(F.struct("place", "digest", "doc")))
    blocks = base.groupBy("tree", "height", block).agg(rows.alias("rows"))
    blocks = blocks.select("tree", "height", "block", F.col("rows.digest").alias("n0"), F.col("rows.doc").alias("docs"))
    for up in range(LEVELS):
        goes_on = F.col("height") > level + up
        above = F.when(goes_on, _parents(F.col(f"n{up}"))).otherwise(F.array().cast(_BINARIES))
        blocks = blocks.withColumn(f"n{up + 1}", above)
    return blocks


def _steps(nodes: str, parents: str, docs: Column) -> Column:
    """Of each node of a block: its place there, its digest and document, its step, and the parent's digest."""

    def step(digest: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(ARITY))
        others = F.concat(F.slice(nodes, i - at + 1, at), F.slice(nodes, i + 2, ARITY - 1 - at))
        siblings = F.unhex(F.array_join(F.transform(others, lambda x: F.hex(x)), ""))
        path = F.array(F.struct(at.alias("at"), siblings.alias("siblings")))
        parent = F.get(parents, F.floor(i / ARITY).cast("int"))
        return F.struct(i.alias("i"), digest.alias("digest"), F.get(docs, i).alias("doc"), path.alias("path"), parent.alias("parent"))

    return F.transform(nodes, step)


def _nodes(blocks: DataFrame, level: int) -> DataFrame:
    """``tree, level, place, height, digest, doc, path, parent`` of all nodes of the blocks that have a parent."""
    out = None
    none = F.array().cast(blocks.schema["docs"].dataType)
    for up in range(LEVELS):
        steps = _steps(f"n{up}", f"n{up + 1}", F.col("docs") if up == 0 else none)
        rows = blocks.where(F.col("height") > level + up).select("tree", "height", "block", F.explode(steps).alias("s"))
        place = F.col("block") * ARITY ** (LEVELS - up) + F.col("s.i")
        rows = rows.select("tree", F.lit(level + up).alias("level"), place.alias("place"), "height", "s.digest", "s.doc", "s.path", "s.parent")
        out = rows if out is None else out.unionByName(rows)
    return out


def grown(base: DataFrame, height: int) -> tuple[DataFrame | None, DataFrame]:
    """All nodes of the trees that have a parent, and the last node of each tree: ``tree, height, digest, doc``.

    ``base`` are the leaves: ``tree, place, height, digest, doc``; ``height`` is the greatest.
    """
    nodes, ends = None, base.where("height = 0").select("tree", "height", "digest", "doc")
    for level in range(0, height, LEVELS):
        blocks = written(_blocks(base.where(F.col("height") > level), level), "blocks")
        found = _nodes(blocks, level)
        nodes = found if nodes is None else nodes.unionByName(found)
        last = F.coalesce(*[F.when(F.col("height") == level + up, F.get(f"n{up}", F.lit(0))) for up in range(1, LEVELS + 1)])
        no_doc = F.lit(None).cast(base.schema["doc"].dataType).alias("doc")
        ended = blocks.where(F.col("height") <= level + LEVELS).select("tree", "height", last.alias("digest"), no_doc)
        ends = ends.unionByName(ended)
        top = F.get(f"n{LEVELS}", F.lit(0)).alias("digest")
        base = blocks.where(F.col("height") > level + LEVELS).select("tree", F.col("block").alias("place"), "height", top, no_doc)
    return nodes, ends


def _pointing(rows: DataFrame, key: tuple[Column, Column, Column], to: tuple[Column, Column, Column], subroot: Column, root: tuple) -> DataFrame:
    """Nodes with their key, where they point to (null for the root), their segment and, where known, their subroot."""
    at_root = (to[0] == root[0]) & (to[1] == root[1])
    names = ("tree", "level", "place")
    return rows.select(
        *[k.cast("long").alias(n) for k, n in zip(key, names, strict=True)],
        *[F.when(~at_root, t).cast("long").alias(f"to_{n}") for t, n in zip(to, names, strict=True)],
        "path",
        subroot.alias("subroot"),
        "doc",
    )


def jumped(nodes: DataFrame, distance: int) -> DataFrame:
    """Nodes that point ``distance`` levels up, made to point twice as far.

    Of the others than leaves, only those are kept whose key a node may still point to: the tree of the
    subroots, and levels that are a multiple of the new distance. What points to nothing is not joined.
    """
    leaf, above = F.col("doc").isNotNull(), (F.col("tree") == TOP) | (F.col("to_tree") == TOP)
    left = nodes.where(leaf | above | F.col("to_tree").isNull() | (F.col("level") % (2 * distance) == 0))
    right = nodes.where("level > 0").select(
        *[F.col(c).alias(f"r_{c}") for c in ("tree", "level", "place", "to_tree", "to_level", "to_place", "path", "subroot")]
    )
    # Rows times bytes bound the table that would be broadcast.
    rows = right.count()
    if rows <= BROADCAST_ROWS and rows * distance * STEP_BYTES <= BROADCAST_BYTES:
        right = F.broadcast(right)
    else:
        right = right.hint("merge")
    names = ("tree", "level", "place")
    met = left.where("to_tree is not null").join(right, [F.col(f"to_{n}") == F.col(f"r_{n}") for n in names])
    met = met.select(
        *names,
        *[F.col(f"r_to_{n}").alias(f"to_{n}") for n in names],
        F.concat("path", "r_path").alias("path"),
        F.coalesce("subroot", "r_subroot").alias("subroot"),
        "doc",
    )
    return met.unionByName(left.where("to_tree is null"))


def proofs(leaf_rows: DataFrame) -> tuple[DataFrame, str | None]:
    """``doc, subroot, path`` of every leaf, and the root as hex text (none without leaves).

    ``path`` leads from the leaf to the root: ``at``, the place among the siblings, and ``siblings``, their digests
    from left to right.
    """
    base = written(placed(leaf_rows), "leaves")
    height, trees = base.agg(F.max("height"), F.max("tree")).first()
    if height is None:
        return base.select("doc", F.col("digest").alias("subroot"), F.lit(None).cast("array<struct<at:int,siblings:binary>>").alias("path")), None
    nodes, subroots = grown(base, height)
    subroots = written(subroots, "subroots")
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", "doc")
    top_height = next(i for i in range(64) if ARITY**i > trees)
    top_nodes, root = grown(tops.withColumn("height", F.lit(top_height)), top_height)
    root = root.first()
    end = (TOP, top_height) if top_height else (0, height)
    here = [F.col("tree"), F.col("level"), F.col("place")]
    parts = []
    if nodes is not None:
        to = (F.col("tree"), F.col("level") + 1, F.floor(F.col("place") / ARITY))
        subroot = F.when(F.col("level") + 1 == F.col("height"), F.col("parent"))
        parts.append(_pointing(nodes, here, to, subroot, end))
    if top_nodes is not None:
        to = (F.lit(TOP), F.col("level") + 1, F.floor(F.col("place") / ARITY))
        parts.append(_pointing(top_nodes.where("level > 0"), here, to, F.lit(None).cast("binary"), end))
        # A subroot keeps the key that its children point to.
        heights = stage(subroots.select(F.col("tree").alias("of"), F.col("height").alias("own")), name="llm-heights").sized()
        named = top_nodes.where("level = 0").join(heights, F.col("place") == F.col("of"))
        parts.append(_pointing(named, (F.col("of"), F.col("own"), F.lit(0)), to, F.col("digest"), end))
    depth = height + top_height
    if not parts:  # a single leaf
        only = base.select("doc", F.col("digest").alias("subroot"), F.array().cast("array<struct<at:int,siblings:binary>>").alias("path"))
        return only, root["digest"].hex()
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    table = written(table, "nodes")
    for k in range(max(0, math.ceil(math.log2(depth)))):
        far = jumped(table, 2**k)
        if 2 ** (k + 1) < depth:
            read, table = table, written(far, "nodes")
            discarded(read)
        else:
            table = far
    return table.where(F.col("doc").isNotNull()).select("doc", "subroot", "path"), root["digest"].hex()


def folded(start: Column, path: str) -> Column:
    """The hex digest that a leaf and its proof lead to."""

    def up(node: Column, step: Column) -> Column:
        siblings = _text(step["siblings"])
        before = F.substring(siblings, F.lit(1), step["at"] * 64)
        after = F.substring(siblings, step["at"] * 64 + 1, F.length(siblings))
        return _sha(F.concat(before, node, after))

    return F.aggregate(path, start, up)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    ``docs`` has ``doc_id, source, lang, n_chars, text``; other columns are not read. ``proof_sha256`` is the digest
    of a leaf's siblings from its run up to the root, ``folded_root`` what its proof leads to from the leaf
    after tampering, ``verified`` whether that is the root. Nulls are fields like others: a null source is a source and comes
    first, null ids come first in their source and aren't tampered with. Rows that repeat an id are ordered
    by leaf; rows that repeat all of it are leaves of their own. An empty table gives no rows.
    """
    found, root = proofs(written(leaves(docs), "hashed"))
    start = _text(F.coalesce("doc.tampered", "doc.leaf"))
    siblings = F.array_join(F.transform("path", lambda s: _text(s["siblings"])), "")
    out = found.select(
        F.col("doc.doc_id").alias("doc_id"),
        _text(F.col("doc.leaf")).alias("leaf"),
        _text(F.col("subroot")).alias("subroot"),
        F.lit(root).cast("string").alias("root"),
        _sha(siblings).alias("proof_sha256"),
        folded(start, "path").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
