"""Main text of web pages: page structure, and suffix arrays of what a host's pages repeat.

A page is cut into blocks. Blocks inside ``article`` or ``main`` are its text;
blocks inside menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are not. All other blocks are doubtful, on pages with and without such a
container. For them the token streams of a host's pages (all that is not in an article) are
concatenated, their suffixes sorted, and the long substrings found that
recur on several distinct pages; a block too short for one counts as a whole.
What stands on at least half of the host's pages is boilerplate, and goes from all of them
but the first; everything else stays.

Suffixes are sorted chunk by chunk; a chunk holds a bounded amount of pages,
chosen by a hash, so a host of any size is split. Each chunk gives its
repeated and single substrings with the number of pages that have them. Chunks share
no page, so these numbers add up to the exact ones.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import written
from .words import SPACED, blocks, grams

#: Tokens of the least repeated substring, a power of two, and the part of a host's pages that boilerplate is on (and two at least).
RUN, SHARE = 8, 0.5
CHUNK_BYTES = 16_000_000

#: What HTML element and attribute names mean.
DROPPED = frozenset(
    "nav footer aside form menu dialog button select datalist fieldset svg canvas audio video template noscript head".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rb rp rt "
    "s samp small span strike strong sub sup td th time tt u var wbr object "
    "math menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable "
    "mtd mtext mtr munder munderover semantics".split()
)
MAIN = frozenset(["article", "main"])
#: Whole class names and ids, with "_" read as "-".
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "site-header site-footer site-nav site-navigation site-menu page-footer global-header global-footer global-nav main-nav "
    "main-navigation main-menu primary-nav primary-navigation primary-menu secondary-nav top-nav top-menu nav-menu nav-bar "
    "navbar-nav ad-container ad-slot ad-banner ad-wrapper ad-unit cookie-banner cookie-bar cookie-notice cookie-consent "
    "consent-banner newsletter-signup newsletter-form share-buttons share-links social-share social-links social-icons "
    "related-posts related-articles comment-list comments-area comment-form comment-respond search-form search-box".split()
)
#: Those whose elements hold articles of their own: readers' comments and other pages' teasers.
OTHERS = frozenset("comment comments disqus replies respond related related-posts related-articles comment-list comments-area".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")

KEPT, DOUBTFUL, MARKED_OUT = 0, 1, 2
#: How an element is marked. An article inside loose ones only is text all the same.
LOOSE, FIRM = 1, 2
NO_ID = -(2**63)


class Block(NamedTuple):
    kind: int
    text: str


def _marked(name: str, attributes: str, in_main: bool) -> int:
    """Whether an element's name or attributes say that it is none of the text, and how surely."""
    if name in DROPPED:
        return LOOSE if name == "form" else FIRM
    mark = LOOSE if name == "header" and not in_main else 0
    if not attributes or name in ("body", "html"):
        return mark
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names = MARKED.intersection(value.replace("_", "-").split())
            if name in MAIN:
                names = names & OTHERS if in_main and name == "article" else ()
            elif in_main:
                names = names - {"header"}
            if names:
                mark = max(mark, LOOSE if OTHERS.isdisjoint(names) else FIRM)
        elif (
            (key == "role" and value in ROLES)
            or key == "hidden"
            or (key == "aria-hidden" and value == "true")
            or (key == "style" and re.search(r"display\s*:\s*none", value))
        ):
            return FIRM
    return mark


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with decoded text and single spaces.

    Works on broken markup: an end tag closes the nearest open element of its
    name and all that is open inside it; end tags without one are skipped. An
    article inside a marked wrapper is text, unless that is a firm mark or stands in an article.
    """
    out: list[Block] = []
    parts: list[str] = []
    open_: list[tuple[str, int, bool, bool]] = []  # name, marked, firm, main
    marked = firm = main = 0
    at = 0

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Block(MARKED_OUT if marked else KEPT if main else DOUBTFUL, text))

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in INLINE:
            if name in ("br", "td", "th"):
                parts.append(" ")
            if closing or name in VOID:
                if not closing or not any(n == name for n, *_ in open_):
                    continue
            elif not _marked(name, attributes, main > 0) and not any(n == name for n, *_ in open_):
                continue
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        end_block()
        if closing:
            if any(n == name for n, *_ in open_):
                while True:
                    n, was_marked, was_firm, was_main = open_.pop()
                    marked -= was_marked
                    firm -= was_firm
                    main -= was_main
                    if n == name:
                        break
        elif name not in VOID and not attributes.endswith("/"):
            mark = _marked(name, attributes, main > 0)
            is_main = name in MAIN and not mark
            if name != "p" or mark:
                reopens = is_main and not firm and not any(n == "article" and m for n, _, _, m in open_)
                step = -marked if reopens else int(mark > 0)
                open_.append((name, step, mark == FIRM, is_main))
                marked += step
                firm += mark == FIRM
                main += is_main
    end_block()
    return out


def _host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_PARSED = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("chunk", pa.int64()),
        ("host", pa.string()),
        ("settled", pa.bool_()),
        ("text", pa.string()),
        ("kinds", pa.list_(pa.int32())),
        ("parts", pa.list_(pa.string())),
    ]
)


def _parsed(pages: DataFrame) -> DataFrame:
    """Blocks of every page. Settled ones, without doubtful blocks, have their text and the blocks that are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                rows = []
                for page_id, url, page, chunk in zip(*(c.to_pylist() for c in batch.slice(at, 250).columns), strict=True):
                    found = page_blocks(page or "")
                    settled = all(b.kind != DOUBTFUL for b in found)
                    text = "\n\n".join(b.text for b in found if b.kind == KEPT) if settled else ""
                    rest = [b for b in found if not (settled and b.kind == KEPT)]
                    rows.append(
                        (page_id, url, chunk, _host(url), settled, text, [b.kind for b in rest], [b.text for b in rest])
                    )
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _PARSED, strict=True)], schema=_PARSED
                )

    return pages.mapInArrow(
        run,
        "page_id long, url string, chunk long, host string, settled boolean, text string, kinds array<int>, parts array<string>",
    )


def suffix_ranks(tokens: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the texts in order of their first ``length`` tokens, and the rank of each.

    Prefixes are doubled: two neighbouring ranks of h tokens make one of 2h. Suffixes
    that are too short within their text are left out. Equal ranks mean equal prefixes.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    valid = np.ones(len(tokens), dtype=bool)
    h = 1
    while h < length:
        n = max(len(tokens) - h, 0)
        pair = np.full(len(tokens), -1, dtype=np.int64)
        inside = np.zeros(len(tokens), dtype=bool)
        inside[:n] = (text[:n] == text[h:]) & valid[:n] & valid[h:]
        at = np.flatnonzero(inside)
        pair[at] = rank[at] * (len(tokens) + 1) + rank[at + h]
        _, rank = np.unique(pair, return_inverse=True)
        rank, valid = rank.astype(np.int64), inside
        h *= 2
    order = np.argsort(rank, kind="stable")
    return order[valid[order]], rank


def _streams(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the pages' concatenated blocks, as hashes, and the page of each."""
    found, owner = [], []
    for block in blocks(pa.array([" ".join(p) for p in parts]), SPACED):
        found.append(block.hashes())
        owner.append(block.doc + block.first)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def _short(part: str) -> bool:
    return part.count(" ") < RUN - 1


def _whole(parts: list[str]) -> np.ndarray:
    """Of each block of fewer than ``RUN`` tokens, a hash."""
    tokens, owner = _streams([[p] for p in parts])
    return grams(tokens, owner, len(parts), RUN)[0].view(np.int64)


def _substrings(table: pa.Table) -> pa.Table:
    """``chunk, host, run, pages, first``: of one chunk, every substring of ``RUN`` tokens and every shorter
    block, how many pages have it and the least id of these."""
    table = table.sort_by("host")
    hosts = table.column("host").to_pylist()
    ids = table.column("page_id").fill_null(NO_ID).to_numpy()
    number = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
    parts = [
        [p for k, p in zip(kinds, found, strict=True) if k != KEPT]
        for kinds, found in zip(table.column("kinds").to_pylist(), table.column("parts").to_pylist(), strict=True)
    ]
    tokens, page = _streams(parts)
    host = np.array([number[h] for h in hosts], dtype=np.uint64)[page]
    at, rank = suffix_ranks(tokens ^ (host * np.uint64(0x9E3779B97F4A7C15)), page, RUN)
    if len(at):
        by_page = np.unique(np.stack([rank[at], page[at]], axis=1), axis=0)
        ranks, first, pages = np.unique(by_page[:, 0], return_index=True, return_counts=True)
        least = np.minimum.reduceat(ids[by_page[:, 1]], first)
        value, owner = grams(tokens, page, table.num_rows, RUN)
        starts = np.flatnonzero(page[: len(page) - RUN + 1] == page[RUN - 1 :])
        long_enough = np.bincount(page, minlength=table.num_rows)[owner] >= RUN
        run = np.zeros(len(tokens), dtype=np.uint64)
        run[starts] = value[long_enough]
        sample = np.zeros(int(rank.max()) + 1, dtype=np.int64)
        sample[rank[at]] = at
        where = sample[ranks]
        names = [hosts[p] for p in page[where]]
        runs = run[where].view(np.int64)
    else:
        runs, pages, least = (np.zeros(0, np.int64) for _ in range(3))
        names = []
    short = [(i, p) for i, found in enumerate(parts) for p in found if _short(p)]
    standing: dict[tuple[str, int], set[int]] = {}
    for (i, _), h in zip(short, _whole([p for _, p in short]).tolist(), strict=True):
        standing.setdefault((hosts[i], h), set()).add(i)
    names += [h for h, _ in standing]
    runs = np.concatenate([runs, np.array([h for _, h in standing], dtype=np.int64)])
    pages = np.concatenate([pages, np.array([len(x) for x in standing.values()], dtype=np.int64)])
    least = np.concatenate([least, np.array([min(ids[i] for i in x) for x in standing.values()], dtype=np.int64)])
    chunk = table.column("chunk")[0].as_py()
    return pa.table(
        {
            "chunk": pa.array([chunk] * len(names), pa.int64()),
            "host": pa.array(names, pa.string()),
            "run": pa.array(runs, pa.int64()),
            "pages": pa.array(pages.astype(np.int64), pa.int64()),
            "first": pa.array(least, pa.int64()),
        }
    )


def unique_runs(kinds: list[int], parts: list[str], repeated: dict[int, int], page: int, run: int = RUN) -> list[str]:
    """The kept blocks of a page, and the doubtful ones without what repeated substrings cover.

    ``repeated`` has the page that each substring stays on. A block that is covered by less
    than half stays whole; of another, every uncovered stretch stays.
    """
    rest = [p for k, p in zip(kinds, parts, strict=True) if k != KEPT]
    gone = lambda v: repeated.get(v, page) != page
    tokens, _ = _streams([rest])
    covered = np.zeros(len(tokens), dtype=bool)
    if len(tokens) >= run:
        value, _ = grams(tokens, np.zeros(len(tokens), np.int64), 1, run)
        for i in np.flatnonzero([gone(v) for v in value.view(np.int64).tolist()]):
            covered[i : i + run] = True
    whole = iter(_whole([p for p in rest if _short(p)]).tolist())
    out, at = [], 0
    for kind, part in zip(kinds, parts, strict=True):
        if kind == KEPT:
            out.append(part)
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", part)
        hit = covered[at : at + len(words)]
        at += len(words)
        if _short(part) and gone(next(whole)):
            hit = np.ones(len(words), dtype=bool)
        if kind != DOUBTFUL:
            continue
        if 2 * hit.sum() < len(words):
            out.append(part)
            continue
        lo = 0
        for i in range(len(words) + 1):
            if i == len(words) or hit[i]:
                if i > lo:
                    out.append(" ".join(words[lo:i]))
                lo = i + 1
    return out


def _judged(pages: pa.Table, runs: pa.Table) -> pa.Table:
    """The texts of one chunk's pages with doubtful blocks, given the boilerplate there."""
    repeated: dict[str, dict[int, int]] = {}
    for host, run, first in zip(*(runs.column(c).to_pylist() for c in ("host", "run", "first")), strict=True):
        repeated.setdefault(host, {})[run] = first
    ids = pages.column("page_id").fill_null(NO_ID).to_pylist()
    texts = [
        "\n\n".join(unique_runs(kinds, parts, repeated.get(host, {}), page))
        for page, host, kinds, parts in zip(ids, *(pages.column(c).to_pylist() for c in ("host", "kinds", "parts")), strict=True)
    ]
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(texts, pa.string())})


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Blocks of the text are joined by two line ends; character references are
    decoded. A null or empty page, and one of which nothing remains, has the text "".
    A null url is of host "". Repeated rows are distinct pages to the suffix arrays
    only if their id or url differs; each gets its text. Pages that share the least id
    of those with some boilerplate all keep it. An empty table gives no
    rows; columns other than ``page_id``, ``url`` and ``html`` are not read.
    """
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    chunks = total // CHUNK_BYTES + 1
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        F.pmod(F.xxhash64("page_id", "url"), F.lit(chunks)).alias("chunk"),
    )
    parsed = written(_parsed(keyed), "pages")
    streams = parsed.where(F.size("parts") > 0).select("chunk", "host", "kinds", "parts", "page_id", "url")
    streams = streams.dropDuplicates(["chunk", "page_id", "url"]).select("chunk", "host", "page_id", "kinds", "parts")
    found = written(
        streams.groupBy("chunk").applyInArrow(_substrings, "chunk long, host string, run long, pages long, first long"), "runs"
    )
    doubtful = parsed.where("not settled").select("chunk", "page_id", "url", "host", "kinds", "parts")
    sizes = parsed.where(F.size("parts") > 0).select("host", "page_id", "url").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    often = found.groupBy("host", "run").agg(F.sum("pages").alias("n"), F.min("first").alias("first")).where("n >= 2")
    often = often.join(sizes, "host").where(F.col("n") >= SHARE * F.col("of")).select("host", "run", "first")
    # Only chunks with doubtful pages need their repeated substrings.
    asked = doubtful.select("chunk").distinct()
    runs = found.join(asked, "chunk", "left_semi").drop("first").join(often, ["host", "run"]).select("chunk", "host", "run", "first")
    judged = (
        doubtful.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(_judged, "page_id long, url string, text string")
    )
    both = parsed.where("settled").select("page_id", "url", "text").unionByName(judged)
    return both.withColumn("n_chars", F.char_length("text").cast("long"))
