"""Quality by a sparse ensemble of rules.

Trees are grown on statistics of the text; every path from a root is a rule, a
conjunction of bounds. A logistic regression with lasso penalty weighs the rules and
drops most. What is left is compiled into one Spark column, so documents are
scored by column expressions alone.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import held_out, labelled_sample
from .shared import free_name, written

#: Labelled documents that are learned from, at most (about).
TRAINING_ROWS = 15_000
TREES, DEPTH, LASSO = 12, 3, 0.0005

Bound = tuple[int, bool, float]  # statistic, whether at most (or above), threshold

STATISTICS = (
    "chars", "words", "word_length", "capitals", "symbols", "digits", "distinct", "stutter", "marks", "bars", "lines", "line_repeats"
)


class Model(NamedTuple):
    intercept: float
    rules: list[tuple[tuple[Bound, ...], float]]


def statistics(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with one double column for each of ``STATISTICS``; null and empty texts give zeros."""
    t, chars, words, lines = (free_name(df, f"{prefix}{x}_") for x in ("text", "n", "split", "rows"))
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(chars, F.char_length(t)).withColumn(words, F.split(F.btrim(F.lower(t), F.lit(" \t\n\x0b\f\r")), r"\s+"))
    df = df.withColumn(lines, F.split(F.col(t), "\n"))
    n, count = F.greatest(F.col(chars), F.lit(1)), F.size(words)
    per_char = lambda pattern: F.regexp_count(F.col(t), F.lit(pattern)) / n
    same = f"size(filter(zip_with({words}, slice({words}, 2, size({words})), (a, b) -> a = b), x -> x))"
    values = {
        "chars": F.log1p(F.col(chars)),
        "words": F.log1p(count),
        "word_length": n / count,
        "capitals": per_char(r"\p{Lu}"),
        "symbols": per_char(r"[^\p{L}\p{N}\s]"),
        "digits": per_char(r"\p{N}"),
        "distinct": F.size(F.array_distinct(words)) / count,
        "stutter": F.expr(same) / count,
        "marks": per_char(r"[!?$%&#*]{2,}"),
        "bars": per_char(r"[|]"),
        "lines": F.log1p(F.size(lines)),
        "line_repeats": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }
    return df.select("*", *[values[c].cast("double").alias(prefix + c) for c in STATISTICS]).drop(t, chars, words, lines)


def _paths(node, above: tuple[Bound, ...]) -> list[tuple[Bound, ...]]:
    """The paths below a node of a tree, each statistic and direction with its tightest bound."""
    if node.getClass().getSimpleName() == "LeafNode":
        return []
    split = node.split()
    out = []
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        bounds = {(f, d): t for f, d, t in above}
        key, threshold = (split.featureIndex(), at_most), split.threshold()
        bounds[key] = min(bounds.get(key, math.inf), threshold) if at_most else max(bounds.get(key, -math.inf), threshold)
        path = tuple(sorted((f, d, t) for (f, d), t in bounds.items()))
        out += [path, *_paths(child, path)]
    return out


def _holds(path: tuple[Bound, ...], prefix: str) -> Column:
    out = F.lit(True)
    for statistic, at_most, threshold in path:
        c = F.col(prefix + STATISTICS[statistic])
        out = out & ((c <= threshold) if at_most else (c > threshold))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_ROWS) -> Model:
    """A model of ``label`` (1 is good), from at most about ``bound`` labelled documents that are not held out.

    Without labels, or with labels of one kind only, the model is the smoothed share of label 1.
    """
    known = labels.where(~held_out())
    sample = labelled_sample(docs, known, [label], bound)
    # One ordered partition, bounded as the sample is: the same trees on every run.
    rows = written(statistics(sample, "text", "s_").drop("text").repartition(1).sortWithinPartitions("doc_id"), "rules")
    rows = rows.coalesce(1).withColumn("label", F.col(label).cast("double"))
    n, good = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    good = good or 0.0
    if good in (0.0, n):
        return Model(math.log((good + 0.5) / (n - good + 0.5)), [])
    features = VectorAssembler(inputCols=["s_" + c for c in STATISTICS], outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=7
    ).fit(features.select("features", "label"))
    paths = sorted({p for tree in forest.trees for p in _paths(tree._java_obj.rootNode(), ())})
    indicators = [_holds(p, "s_").cast("double").alias(f"r{i}") for i, p in enumerate(paths)]
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(paths))], outputCol="features").transform(
        rows.select("label", *indicators)
    )
    matrix = matrix.select("label", "features").persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(matrix)
    matrix.unpersist()
    weights = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), [(p, float(w)) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-6])


def score(model: Model, prefix: str) -> Column:
    """The model as a column over statistics: the probability of label 1."""
    total = F.lit(model.intercept)
    for path, weight in model.rules:
        total = total + F.when(_holds(path, prefix), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, or a name like it if that is taken; null texts score as empty ones."""
    out, prefix = free_name(docs, "score"), "stat__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    with_score = statistics(docs, "text", prefix).withColumn(out, score(model, prefix))
    return with_score.select(*docs.columns, out)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``predicted`` is 1 where the score is 0.5 or more.

    Rows without an id are scored like others and count as not held out. Repeated
    rows get the same score. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score below 0.5."""
    out = scored(docs, fit(docs, labels))
    return out.where(F.col(out.columns[-1]) >= 0.5).select(*docs.columns)
