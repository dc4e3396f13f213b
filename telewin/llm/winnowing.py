"""Document fingerprints by winnowing, in column expressions alone.

Every run of 4 words has a hash that is put together from the hashes of its
halves, so neighbouring runs share work. Of every 8 successive runs the one with
the least hash is chosen, the rightmost if several are least. Chosen runs are
kept with their places: whenever two texts share 11 successive words, both
keep a common run from there.

Words that do not stand between spaces, those of scripts without spaces and those of
more than 32 code points, count as one word for each code point. A text of fewer than 24 words
keeps all its runs, and besides them those of 4 successive code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import free_name

#: Words in a run and runs in a window; both are powers of two.
RUN, WINDOW = 4, 8
_SPACE = " \t\n\x0b\f\r"
_LOW = 2**31 - 1
#: Code points from which a word is taken apart, and words from which a text is winnowed.
LONG_WORD, SHORT = 33, 24
_WORD = r"[^\x20\x09-\x0D]"
#: Letters of scripts that put no spaces between words.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: Most ranges that quantiles cut the ids into.
CELLS = 4096
#: Places of the code points of short texts count from here.
POINTS = 2**30


def _joined(name: str, step: int, expression: str) -> str:
    return f"zip_with({name}, slice({name}, {step + 1}, size({name})), (a, b) -> {expression})"


def _neighbours(df: DataFrame, name: str, step: int, expression: str) -> DataFrame:
    """``name`` with each element joined to the one ``step`` further on; at the end there is none."""
    return df.withColumn(name, F.expr(_joined(name, step, expression)))


def _runs(df: DataFrame, name: str, first: int = 0) -> DataFrame:
    """The hashes ``name`` of words made those of runs, each with its place, counted from ``first``."""
    step = 1
    while step < RUN:
        df = _neighbours(df, name, step, "xxhash64(a, b)")
        step *= 2
    df = df.withColumn(name, F.expr(f"slice({name}, 1, greatest(size({name}) - {RUN - 1}, 1))"))
    return df.withColumn(name, F.expr(f"transform({name}, (x, i) -> shiftleft(x & {_LOW}L, 31) | ({_LOW - first}L - i))"))


def winnowed(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the chosen runs of column ``text``, by place.

    Each is one long: 31 bits of hash, then the place counted down from
    2**31 - 1; ``places`` and ``hashes`` take them apart. A text of fewer words
    than a run is one run. Texts of fewer than ``SHORT`` words have all their runs, and after
    them those of code points, with white space as one space, at places from ``POINTS``. Null and
    texts without words have no runs. Words are what white space separates; long
    words and those of scripts without spaces are taken apart into code points.
    """
    trimmed, points, short = (free_name(df, f"{out}_{c}") for c in ("trimmed", "points", "short"))
    df = df.withColumn(trimmed, F.btrim(F.col(text), F.lit(_SPACE)))
    split = F.split(trimmed, r"[\x20\x09-\x0D]+")
    apart = lambda w: F.when((F.char_length(w) >= LONG_WORD) | w.rlike(_UNSPACED), F.split(w, "")).otherwise(F.array(w))
    unspaced = F.col(trimmed).rlike(f"{_UNSPACED}|{_WORD}{{{LONG_WORD}}}")
    words = F.when(unspaced, F.flatten(F.transform(split, apart))).otherwise(split)
    words = F.when(F.length(trimmed) > 0, words).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(short, F.size(out) < SHORT)
    letters = F.split(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", " "), "")
    letters = F.when(F.col(short) & (F.length(trimmed) > 0), letters).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(points, F.transform(letters, lambda w: F.xxhash64(w))).drop(trimmed)
    df = _runs(_runs(df, out), points, POINTS)
    step = 1
    while step < WINDOW:
        df = df.withColumn(out, F.when(F.col(short), F.col(out)).otherwise(F.expr(_joined(out, step, "least(a, b)"))))
        step *= 2
    chosen = F.expr(f"array_distinct(slice({out}, 1, greatest(size({out}) - {WINDOW - 1}, 1)))")
    return df.withColumn(out, F.when(F.col(short), F.concat(out, points)).otherwise(chosen)).drop(points, short)


def hashes(runs: str) -> Column:
    return F.transform(runs, lambda x: F.shiftright(x, 31))


def places(runs: str) -> Column:
    return F.transform(runs, lambda x: F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW)))


def likeness(left: str, right: str) -> Column:
    """Shared part of two sets of hashes; 1 for two empty sets."""
    either = F.size(F.array_union(left, right))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / either)


def _at_or_below(cuts: list[float], value: Column) -> Column:
    """How many of the ascending ``cuts`` are at or below ``value``, by halving."""
    steps = [2**i for i in reversed(range(len(cuts).bit_length()))]
    held = F.array(*[F.lit(c) for c in cuts])
    # The element before place n + step tells whether so many are.
    ahead = lambda n, step: F.when(F.get(held, n + step - 1) <= value, n + step).otherwise(n)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), ahead)


def _shares(value: Column, low: Column, high: Column, cuts: Column) -> Column:
    """In which of ``cuts`` equal parts of [``low``, ``high``] a value lies; in doubles, since ids may be far apart."""
    width = high.cast("double") - low.cast("double")
    part = F.floor((value.cast("double") - low.cast("double")) / width * cuts)
    return F.when(width > 0, F.least(part, cuts - 1)).otherwise(0)


def _ranges(docs: DataFrame, rows_each: int) -> DataFrame:
    """``docs`` with ``cell`` and ``sub``: ranges of ascending ``doc_id`` and ``mark`` of about ``rows_each`` rows.

    Quantiles of the ids are the cuts of the cells, at most ``CELLS``; an id that makes up several quantiles has a cell of
    its own. A cell that holds more is cut again: by its ids, or where it has but one id, by ``mark``, a hash of the text
    that orders rows of equal id. Rows without an id come first.
    """
    n = docs.count()
    cells = max(1, min(CELLS, n // rows_each))
    found = docs.where("doc_id is not null").approxQuantile("doc_id", [i / cells for i in range(1, cells)], 1 / (4 * cells)) if cells > 1 else []
    cuts = sorted({*found, *(c + 1 for c, again in zip(found, found[1:]) if c == again)})
    cell = _at_or_below(cuts, F.col("doc_id").cast("double")) if cuts else F.lit(0)
    placed = docs.withColumn("cell", F.when(F.col("doc_id").isNull(), -1).otherwise(cell).cast("long"))
    ends = [f(c).alias(f"{name}_{c}") for c in ("doc_id", "mark") for name, f in (("lo", F.min), ("hi", F.max))]
    counts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * rows_each)).alias("cuts"), *ends)
    joined = placed.join(F.broadcast(counts), "cell")
    ids = _shares(F.col("doc_id"), F.col("lo_doc_id"), F.col("hi_doc_id"), F.col("cuts"))
    marks = _shares(F.col("mark"), F.col("lo_mark"), F.col("hi_mark"), F.col("cuts"))
    sub = F.when(F.col("lo_doc_id") < F.col("hi_doc_id"), ids).otherwise(marks)
    return joined.withColumn("sub", sub.cast("long")).drop("cuts", "lo_doc_id", "hi_doc_id", "lo_mark", "hi_mark")


def with_next(docs: DataFrame, rows_each: int = 500) -> DataFrame:
    """``cell, sub, tail, doc_id, mark, text, next_text``: each document and the text after it by ascending doc_id.

    After the last comes the first; rows of one id are ordered by a hash of the text, then by the text. Texts
    are shuffled once. Every range also gets, as its ``tail``, a copy of the
    first row of the range after it; tails have no next text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = _ranges(docs.withColumn("mark", F.xxhash64("text")), rows_each)
    firsts = ranged.groupBy("cell", "sub").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    order = Window.orderBy("cell", "sub")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The ranges are at most some 100,000; their order needs no text.
    before = firsts.select(
        "cell",
        "sub",
        F.col("first.doc_id").alias("first_id"),
        F.col("first.mark").alias("first_mark"),
        F.coalesce(F.lag("cell").over(order), F.last("cell").over(whole)).alias("to_cell"),
        F.coalesce(F.lag("sub").over(order), F.last("sub").over(whole)).alias("to_sub"),
    )
    same = (
        (ranged["cell"] == before["cell"])
        & (ranged["sub"] == before["sub"])
        & ranged["doc_id"].eqNullSafe(before["first_id"])
        & (ranged["mark"] == before["first_mark"])
    )
    tails = (
        ranged.join(F.broadcast(before), same)
        .groupBy(before["to_cell"].alias("cell"), before["to_sub"].alias("sub"), ranged["doc_id"], ranged["mark"])
        .agg(F.min("text").alias("text"))
    )
    columns = ["doc_id", "mark", "text"]
    both = ranged.select("cell", "sub", F.lit(0).alias("tail"), *columns).unionByName(
        tails.select("cell", "sub", F.lit(1).alias("tail"), *columns)
    )
    return both.withColumn("next_text", F.lead("text").over(in_range()))


def in_range() -> Window:
    return Window.partitionBy("cell", "sub").orderBy("tail", "doc_id", "mark", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The edited text has its last quarter of code points (rounded down) replaced
    by the first as many, or all, of the next document. Null texts are empty.
    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, places``. A fingerprint is the hex hashes of the
    chosen runs in order, ``places`` are those of the fingerprint's runs. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    df = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut)
    df = df.withColumn("edited", F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)))
    df = df.drop("next_text")
    df = winnowed(winnowed(df, "text", "runs"), "edited", "edited_runs")
    df = df.withColumn("own", hashes("runs")).withColumn("own_edited", hashes("edited_runs"))
    df = df.withColumn("own_next", F.lead("own").over(in_range())).where("tail = 0")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.hex(x))), ",")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        text("own").alias("fingerprint"),
        text("own_edited").alias("edited_fingerprint"),
        likeness("own", "own_edited").alias("near_edited"),
        likeness("own", "own_next").alias("near_next"),
        F.array_join(places("runs").cast("array<string>"), ",").alias("places"),
    )


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``fingerprint``: an array of (place, hash) of the chosen runs of column ``text``."""
    out = free_name(df, "fingerprint")
    df = winnowed(df, text, out)
    both = F.arrays_zip(places(out).alias("place"), hashes(out).alias("hash"))
    return df.withColumn(out, both)
