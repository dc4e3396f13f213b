"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents fall into cells by source, language and topic. The cells' token shares
are raked: scaled in turn so that each of the three marginals meets its target, until all
do. A document is sampled with a probability that gives its cell the raked
share of the token budget.

Counting and sampling are Spark's; the raking works on one number per cell. Every source
and language is a marginal value of its own, however small. Up to ``LOCAL`` cells are
raked on the driver; more stay a table that is joined with the factors of its marginals, round by round.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..workspace import work_dir
from .shared import free_name, written

TOPICS = 8
#: Cells that are raked on the driver, at most.
LOCAL = 50_000
#: Bytes from which a word says something of the topic.
TOPIC_WORD = 6
#: What stands between words of lower-cased texts.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A letter for each topic.
CLASSES = string.ascii_lowercase[:TOPICS]
ROUNDS, CLOSE = 500, 1e-10
NONE = "(none)"
MARGINALS = ("source", "lang", "topic")

#: Exponents of the default targets: token shares are raised to them, so that large
#: sources and languages give way to small ones; topics weigh alike.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.0}


def with_topic(docs: DataFrame, topic: str, tokens: str) -> DataFrame:
    """``docs`` with the number of words and the topic.

    Words of ``TOPIC_WORD`` bytes or more belong to one of ``TOPICS`` classes by their
    hash; the topic is the class with the most words, the first of equal ones.
    Column functions only: each text becomes a string of its words' classes.
    """
    words, classes, counts = (free_name(docs, c) for c in ("words", "classes", "counts"))
    split = F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS)
    kind = lambda w: F.substring(F.lit(CLASSES), F.pmod(F.xxhash64(w), F.lit(TOPICS)).cast("int") + 1, F.lit(1))
    long = F.filter(words, lambda w: F.octet_length(w) >= TOPIC_WORD)
    of = [F.length(classes) - F.length(F.replace(classes, F.lit(c), F.lit(""))) for c in CLASSES]
    return (
        docs.withColumn(words, split)
        .select(*docs.columns, F.array_join(F.transform(long, kind), "").alias(classes), F.size(F.filter(words, lambda w: w != "")).cast("long").alias(tokens))
        .select(*docs.columns, F.array(*of).alias(counts), tokens)
        .select(*docs.columns, (F.array_position(counts, F.array_max(counts)) - 1).cast("int").alias(topic), tokens)
    )


def raked(tokens: np.ndarray, codes: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Shares of the cells whose marginals meet the targets.

    ``codes`` has a row for each cell and a column for each marginal. Targets of values
    that hold no tokens are spread over the others. If the empty cells
    make the targets contradict each other, the last round's shares are given.
    """
    share = tokens / tokens.sum()
    targets = [np.where(np.bincount(codes[:, j], share, len(t)) > 0, t, 0.0) for j, t in enumerate(targets)]
    targets = [t / t.sum() for t in targets]
    for _ in range(ROUNDS):
        off = 0.0
        for j, target in enumerate(targets):
            now = np.bincount(codes[:, j], share, len(target))
            off = max(off, float(np.abs(now - target).max()))
            share = share * np.divide(target, now, out=np.zeros_like(now), where=now > 0)[codes[:, j]]
        if off < CLOSE:
            break
    return share / share.sum()


def probabilities(tokens: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
    """Of each cell, the part to sample: proportional to share over tokens, at most 1, spending the budget."""
    rate = share / tokens
    low, high = 0.0, 1 / rate[rate > 0].min()
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if float((tokens * np.minimum(1, middle * rate)).sum()) < budget else (low, middle)
    return np.minimum(1, high * rate)


def calibrated(
    docs: DataFrame, budget: float = 0.5, targets: Mapping[str, Mapping[str, float]] | None = None, seed: str = "mix"
) -> DataFrame:
    """``docs`` with ``topic, tokens, weight, probability, kept`` (or names like these, if taken).

    ``budget`` is the part of all tokens to keep, ``targets`` a weight by value for
    any of source, lang and topic; the others are tempered, see ``TEMPER``. ``weight`` is the raked share over the share there is;
    ``kept`` compares the probability with a hash of ``seed`` and the id, so
    copies of a row share their fate. A null source, language or id is a value like any other.
    Texts without words have no tokens and are kept with their cell's probability. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    targets = targets or {}
    names = {c: free_name(docs, c) for c in ("topic", "tokens", "weight", "probability", "kept")}
    rows = with_topic(docs, names["topic"], names["tokens"])
    plain = with_topic(docs.select("source", "lang", "text"), "topic", "tokens")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang", "topic")]
    cells = written(plain.select(*keys, "tokens").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    schema = "c_source string, c_lang string, c_topic string, c_weight double, c_probability double"
    if cells.count() <= LOCAL:
        found = sorted(tuple(r) for r in cells.collect())
        rates = F.broadcast(spark.createDataFrame(_table(found, targets, budget * total), schema))
    else:
        rates = _rated(cells, targets, budget, total)
    where = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in ("source", "lang")]
    joined = rows.join(
        rates,
        (where[0] == F.col("c_source")) & (where[1] == F.col("c_lang")) & (F.col(names["topic"]).cast("string") == F.col("c_topic")),
    )
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / float(2**53)
    return joined.select(
        *docs.columns,
        names["topic"],
        names["tokens"],
        F.col("c_weight").alias(names["weight"]),
        F.col("c_probability").alias(names["probability"]),
        (uniform < F.col("c_probability")).alias(names["kept"]),
    )


def _table(cells: list[tuple], targets: Mapping, budget: float) -> list[tuple]:
    """The cells with weight and probability."""
    tokens = np.array([c[3] for c in cells], dtype=float)
    full = tokens > 0
    if not full.any():
        return [(*c[:3], 1.0, 1.0) for c in cells]
    codes, wanted = [], []
    for j, name in enumerate(MARGINALS):
        values = sorted({c[j] for c in cells})
        place = {v: i for i, v in enumerate(values)}
        code = np.array([place[c[j]] for c in cells])
        have = np.bincount(code, tokens, len(values)) / tokens.sum()
        tempered = np.where(have > 0, np.maximum(have, 1e-300) ** TEMPER[name], 0)
        given = targets.get(name)
        wanted.append(np.array([given.get(v, 0.0) for v in values]) if given else tempered)
        codes.append(code)
    share = np.zeros(len(cells))
    share[full] = raked(tokens[full], np.stack(codes, axis=1)[full], wanted)
    rate = np.ones(len(cells))
    rate[full] = probabilities(tokens[full], share[full], budget)
    weight = np.ones(len(cells))
    weight[full] = share[full] / (tokens[full] / tokens.sum())
    return [(*c[:3], float(w), float(p)) for c, w, p in zip(cells, weight, rate, strict=True)]


def _rated(cells: DataFrame, targets: Mapping, budget: float, total: int) -> DataFrame:
    """What ``_table`` gives, of any number of cells, as a table."""
    spark = cells.sparkSession
    if not total:
        return cells.select(*[F.col(c).alias(f"c_{c}") for c in MARGINALS], F.lit(1.0).alias("c_weight"), F.lit(1.0).alias("c_probability"))
    share = cells.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total)))
    wanted = {}
    for name in MARGINALS:
        want = share.groupBy(name).agg(F.pow(F.sum("share"), F.lit(TEMPER[name])).alias("target"))
        if targets.get(name):
            given = spark.createDataFrame([(v, float(t)) for v, t in targets[name].items()], f"{name} string, given double")
            want = want.join(given, name, "left").select(name, F.coalesce("given", F.lit(0.0)).alias("target"))
        whole = want.agg(F.sum("target")).first()[0]
        wanted[name] = written(want.withColumn("target", F.col("target") / F.lit(whole)), "targets")
    folders = [work_dir(spark, "llm-raked") for _ in range(2)]  # in turn, so that only two rounds are on disk
    for i in range(ROUNDS):
        off = 0.0
        for name in MARGINALS:
            now = share.groupBy(name).agg(F.sum("share").alias("now")).join(wanted[name], name)
            by = F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0)
            factors = written(now.select(name, by.alias("by"), F.abs(F.col("now") - F.col("target")).alias("off")), "factors")
            off = max(off, factors.agg(F.max("off")).first()[0])
            share = share.join(factors.drop("off"), name).withColumn("share", F.col("share") * F.col("by")).drop("by")
        share.write.mode("overwrite").parquet(folders[i % 2])
        share = spark.read.schema(share.schema).parquet(folders[i % 2])
        if off < CLOSE:
            break
    whole = share.agg(F.sum("share")).first()[0]
    share = share.withColumn("share", F.col("share") / F.lit(whole)).withColumn("rate", F.col("share") / F.col("tokens"))
    low, high = 0.0, 1 / share.where("rate > 0").agg(F.min("rate")).first()[0]
    for _ in range(40):
        points = [low + (high - low) * k / 33 for k in range(1, 33)]
        spends = [F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(m) * F.col("rate"))) for m in points]
        under = [m for m, spent in zip(points, share.agg(*spends).first(), strict=True) if spent < budget * total]
        low, high = (under[-1] if under else low), (points[len(under)] if len(under) < len(points) else high)
        if high - low <= 1e-15 * high:
            break
    weight = F.col("share") * F.lit(float(total)) / F.col("tokens")
    keys = [F.col(c).alias(f"c_{c}") for c in MARGINALS]
    rated = share.select(*keys, weight.alias("c_weight"), F.least(F.lit(1.0), F.lit(high) * F.col("rate")).alias("c_probability"))
    empty = cells.where("tokens <= 0").select(*keys, F.lit(1.0).alias("c_weight"), F.lit(1.0).alias("c_probability"))
    return written(rated.unionByName(empty), "rates")


def mixed(docs: DataFrame, budget: float = 0.5, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The sampled rows of ``docs``."""
    out = calibrated(docs, budget, targets)
    return out.where(F.col(out.columns[-1])).select(*docs.columns)
