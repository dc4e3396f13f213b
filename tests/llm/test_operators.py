"""The corpus operators against brute force on small tables, with odd rows."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from telewin.llm import (
    classifier_chain,
    components,
    host_suffixes,
    license_templates,
    lpt_shards,
    odd_sketch,
    pattern_packing,
    pivot_index,
    raking,
    rule_ensemble,
    winnowing,
)

LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
TEXTS = [
    (0, "the quick brown fox jumps over the lazy dog again and again"),
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "one two"),
    (6, "One two"),
    (7, "ONE  two"),
    (8, LONG),
    (9, LONG + " tail"),
    (10, "Released under the MIT License. See the general public license."),
    (11, "été à Noël <|endoftext|> naïve 你好"),
    (11, "été à Noël <|endoftext|> naïve 你好"),
    (None, "the quick brown fox jumps over the lazy dog again and again"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, slot string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i else None, "s", 0, "x", 1, None) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_all_pairs(docs, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    root, size = brute_components(rows, percent)
    got = odd_sketch.near_duplicates(docs, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert {r.doc_id: r.n_shingles for r in got} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(odd):
    rows = sorted(odd_sketch.near_duplicates(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    found = {r.doc_id: (r.n_shingles > 0, r.component_id) for r in rows}
    assert found[0][1] == found[1][1] == 0 and found[9][1] == 8 and found[7][1] == 5
    assert found[2] == (False, 2) and found[4] == (False, 4) and found[6][1] == 6
    assert rows[-1].doc_id is None and rows[-1].component_id is None and rows[-1].kept
    stay = odd_sketch.keep_one(odd)
    assert stay.columns == odd.columns
    assert sorted(r.doc_id for r in stay.where("doc_id is not null").collect()) == [0, 2, 3, 4, 5, 6, 8, 10, 11]


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (2, 1)], "u long, v long")
    got = {r.u: r.root for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components.components(links.where("u < 0")).count() == 0


def test_edited_texts_and_likeness(odd, docs):
    for table in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted((r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect())
        got = {r.doc_id: r for r in winnowing.edited_fingerprints(table).collect()}
        for i, (doc_id, text) in enumerate(rows):
            cut = len(text) // 4
            edited = text[: len(text) - cut] + rows[(i + 1) % len(rows)][1][:cut]
            r = got[doc_id]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1


def test_next_texts_of_far_apart_and_repeated_ids(spark):
    """Ranges stay small whatever the ids are, and rows of one id follow each other by mark."""
    far = [-(2**63), -(2**62), 2**40, 10**15, 2**63 - 1]
    ids = [*range(300), *far, *[77] * 200, *[None] * 60]
    df = spark.createDataFrame([(i, f"text {n}", "x") for n, i in enumerate(ids)], "doc_id long, text string, mark string")
    marks = {r.text: r.m for r in df.select("text", F.xxhash64("text").alias("m")).collect()}
    order = sorted(((i is not None, i or 0, marks[f"text {n}"]), i, f"text {n}") for n, i in enumerate(ids))
    want = {t: (i, order[(at + 1) % len(order)][2]) for at, (_, i, t) in enumerate(order)}
    out = winnowing.with_next(df, 4)
    rows = out.where("tail = 0").collect()
    assert {r.text: (r.doc_id, r.next_text) for r in rows} == want
    sizes = [r["count"] for r in out.where("tail = 0").groupBy("cell", "sub").count().collect()]
    assert len(sizes) > 40 and max(sizes) <= 48
    assert winnowing.edited_fingerprints(df).count() == len(ids)


def test_winnowing_takes_the_rightmost_least_of_every_window(spark):
    words = [f"w{i % 7}" for i in range(60)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    grams = df.selectExpr("split(text, ' ') as w").selectExpr("transform(w, x -> xxhash64(x)) as h").first().h
    joined = lambda a, b: spark.sql(f"select xxhash64({a}L, {b}L)").first()[0]
    pairs = {(a, b): joined(a, b) for a, b in set(zip(grams, grams[1:], strict=False))}
    two = [pairs[p] for p in zip(grams, grams[1:], strict=False)]
    fours = {(a, b): joined(a, b) for a, b in set(zip(two, two[2:], strict=False))}
    four = [fours[p] & (2**31 - 1) for p in zip(two, two[2:], strict=False)]
    want = []
    for i in range(len(four) - 7):
        least = min(four[i : i + 8])
        at = max(j for j in range(i, i + 8) if four[j] == least)
        if (at, least) not in want:
            want.append((at, least))
    got = winnowing.fingerprints(df).first().fingerprint
    assert [(r.place, r.hash) for r in got] == want


def test_short_and_unspaced_texts_share_what_is_unchanged(spark):
    code = "".join(chr(33 + i * i * 7 % 90) for i in range(400))
    chinese = "".join(chr(0x4E00 + i * i * 31 % 5000) for i in range(300))
    short = [" ".join(f"word{i}x{j}" for j in range(i)) for i in (1, 2, 3, 5, 8, 11, 12, 23, 24)]
    texts = [*short, "x" + code, chinese, "\U00020000" * 3 + "abc d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(winnowing.edited_fingerprints(df).collect())
    assert all(0 < r.near_edited < 1 for r in rows)
    for r in rows:
        assert len(r.places.split(",")) == len(r.fingerprint.split(","))
        assert all(0 <= int(p) < 2**31 for p in r.places.split(","))
    inside = [(0, " ".join(f"a{i}" for i in range(30)) + " " + short[5] + " end", short[5]), (1, "pre" + chinese, chinese[100:140]), (2, code + "tail", code[50:120])]
    both = spark.createDataFrame(inside, "id long, text string, part string")
    runs = winnowing.winnowed(winnowing.winnowed(both, "text", "t"), "part", "p")
    assert all(r.n > 0 for r in runs.select(F.size(F.array_intersect(winnowing.hashes("t"), winnowing.hashes("p"))).alias("n")).collect())


def test_shards_are_even_and_gapless(odd, docs):
    for table in (docs, odd):
        rows = lpt_shards.sharded(table, 5).collect()
        text = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
        by_text, load = {}, {}
        for r in rows:
            t = text[r.doc_id]
            assert r.size == len((t or "").encode()) + 8
            assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
            by_text.setdefault(t, set()).add(r.shard)
            load.setdefault(r.shard, []).append((r.slot, r.size))
        assert all(len(s) == 1 for s in by_text.values())
        assert all(sorted(x for x, _ in v) == list(range(len(v))) for v in load.values())
        assert len(rows) == table.count()
    sizes = [100, 90, 40, 30, 20, 10, 5]
    assert lpt_shards.least_loaded(sizes, 2) == [0, 1, 1, 0, 0, 1, 1]


def test_packing_round_trip(odd):
    from tokenizers import Tokenizer

    path = pattern_packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rows = pattern_packing.packed(odd, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start, length, crc in set(by_doc[doc_id]):
            assert length <= 2048 and (length == 2048 or piece == 0)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        assert sum(x[2] for x in set(by_doc[doc_id])) == len(ids)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


def test_patterns_and_residuals_use_every_piece_once():
    histogram = {n: 1 + n * 7919 % 90 for n in range(3, 2049, 17)} | {2048: 500}
    groups = pattern_packing.best_fit(*pattern_packing.fitted(histogram))
    used = {}
    for lengths, n in groups:
        assert sum(lengths) <= 2048
        for length in lengths:
            used[length] = used.get(length, 0) + n
    assert used == histogram
    plain = sum(n for _, n in pattern_packing.best_fit([], histogram))
    assert sum(n for _, n in groups) <= 1.02 * plain
    assert pattern_packing.best_fit(*pattern_packing.fitted({})) == []


def test_rules_learn_quality_on_held_out_rows(spark, labels, odd):
    from pathlib import Path

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no such table")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = rule_ensemble.quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    one = rule_ensemble.quality(odd, labels.where("quality = 1")).collect()
    assert len(one) == len(TEXTS) and all(0 <= r.score <= 1 for r in one)
    assert rule_ensemble.good_only(odd, labels.limit(0)).columns == odd.columns


def test_statistics_trim_white_space_only(spark):
    texts = ["tnt", "the cat and", "\t\n the cat and \x0b\f\r\n", "bar 0 bar"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(rule_ensemble.statistics(df, "text", "s_").collect())
    assert [round(np.expm1(r.s_words)) for r in rows] == [len(t.split()) for t in texts]
    assert [r.s_word_length for r in rows] == [len(t) / len(t.split()) for t in texts]
    assert rows[3].s_distinct == 2 / 3


def test_chain_finds_toxic_documents(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = classifier_chain.fit(docs, labels.where("doc_id % 2 = 0"))
    out = classifier_chain.scores(docs, chain).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    held = [r for r in out if r.doc_id % 2]
    assert np.mean([r.toxic == r.y for r in held]) > 0.93
    assert classifier_chain.toxicity(odd, labels.limit(0)).count() == len(TEXTS)
    assert classifier_chain.clean_only(odd, labels).columns == odd.columns


def test_raking_meets_its_targets(odd, docs):
    tokens = np.array([40.0, 10, 30, 20])
    codes = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    share = raking.raked(tokens, codes, [np.array([0.5, 0.5]), np.array([0.3, 0.7])])
    assert np.allclose([share[:2].sum(), share[[0, 2]].sum()], [0.5, 0.3])
    part = raking.probabilities(tokens, share, 50)
    assert abs((tokens * part).sum() - 50) < 1e-6 and part.max() <= 1
    out = raking.calibrated(docs, 0.5, {"lang": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}}).collect()
    total = sum(r.tokens for r in out)
    assert abs(sum(r.tokens * r.probability for r in out) / total - 0.5) < 1e-6
    rows = raking.calibrated(odd, 1.0)
    assert rows.count() == len(TEXTS) and rows.columns[-1] == "kept_"


def test_small_sources_meet_targets_of_their_own(spark, monkeypatch):
    rows = [(i, "en" if i < 1800 else "fr", f"host{i % 700}", "wording " * (1 + i % 700 % 5)) for i in range(2800)]
    rows.append((None, None, None, ""))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    out = raking.calibrated(df).collect()
    have, raked = {}, {}
    for r in out:
        have[r.source] = have.get(r.source, 0) + r.tokens
        raked[r.source] = raked.get(r.source, 0) + r.tokens * r.weight
    total = sum(have.values())
    want = {s: (n / total) ** raking.TEMPER["source"] for s, n in have.items()}
    assert len({round(x, 3) for x in raked.values()}) > 2
    for s, n in raked.items():
        assert abs(n / total - want[s] / sum(want.values())) < 1e-6
    monkeypatch.setattr(raking, "LOCAL", 0)
    both = lambda rows: sorted((r.doc_id or -1, r.weight, r.probability) for r in rows)
    assert np.allclose(both(out), both(raking.calibrated(df).collect()), rtol=1e-7)


def test_topics_and_words(odd, spark):
    """The words of every text and the class most long words fall into, counted one by one."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    long = sorted({w for _, t in TEXTS for w in words(t) if len(w.encode()) >= raking.TOPIC_WORD})
    rows = spark.createDataFrame([(w,) for w in long], "w string")
    kind = {r.w: r.k for r in rows.select("w", F.pmod(F.xxhash64("w"), F.lit(raking.TOPICS)).alias("k")).collect()}
    for r in raking.with_topic(odd, "topic", "tokens").collect():
        counts = np.bincount([kind[w] for w in words(r.text) if w in kind], minlength=raking.TOPICS)
        assert (r.tokens, r.topic) == (len(words(r.text)), counts.argmax())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 6)), 2)
    x[50:90] = x[50]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    # Rows that share an id with others or each other, and vectors of another length.
    rows += [rows[7], (40, rows[3][1]), (40, rows[40][1]), (9, rows[120][1])]
    rows += [(i, [float(i % 4), 1.5]) for i in range(400, 425)]
    odd_rows = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (320, []), (None, rows[0][1])]
    df = spark.createDataFrame([*rows, *odd_rows], "vec_id long, embedding array<float>")
    whole = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows]
    want = []
    for at, (q, v) in enumerate(whole):
        if q % 20 == 0:
            other = [(-int(v @ w), i) for j, (i, w) in enumerate(whole) if j != at and len(w) == len(v)]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(other)[:20])]
    got = sorted(tuple(r) for r in pivot_index.top_k(df).collect())
    assert got == sorted(want)
    assert pivot_index.top_k(df.limit(0)).count() == 0


PAGE = "<html><head><title>t</title></head><body><div>Home News Sport Weather Travel Shop Jobs Mail Help</div>%s</body></html>"


def test_main_text(spark):
    rows = [
        (1, "http://a.b/1", "<nav>menu</nav><article><h1>T &amp; U</h1><p>one\n two<br>three<p>four</article><footer>f</footer>"),
        (2, "http://a.b/2", None),
        (3, None, ""),
        (4, "http://a.b/4", "<article>x<div class='comments'>c</div><script>var a='</p>'</script><p>y</p><form>z</form>"),
        *[(10 + i, f"http://h.c/{i}", PAGE % f"<p>{' '.join(f'unique{i}x{j}' for j in range(12))}</p>") for i in range(4)],
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in host_suffixes.main_text(df).collect()}
    assert got[1] == "T & U\n\none two three\n\nfour" and got[4] == "x\n\ny"
    assert got[2] == got[3] == ""
    assert got[12] == " ".join(f"unique2x{j}" for j in range(12))
    assert host_suffixes.main_text(df.limit(0)).count() == 0


def test_class_names_do_not_take_articles_away():
    text = lambda page: [b.text for b in host_suffixes.page_blocks(page) if b.kind == host_suffixes.KEPT]
    for page in (
        '<article class="post comments-open"><p>t</article>',
        '<main class="no-sidebar"><p>t</main>',
        '<div class="layout has-sidebar"><article>t</article></div>',
        '<div class="sidebar"><article>t</article><p>side</div>',
        '<form id="all"><article>t</article><p>field</form>',
        '<article class="share">t<div class="share">buttons</div><nav>n</nav></article><div class="site-header">s</div>',
        '<article>t<div class="comments"><article>c</article></div><article class="comment">d</article></article>',
        '<main><article>t</article><div id="comments" class="comments-area"><article>c</article></div></main>',
    ):
        assert text(page) == ["t"], page
    page = '<article><h1 class="post-header">h</h1><p class="share-price">p</p>x<math><mi>y</mi></math><object>z</object></article>'
    assert text(page) == ["h", "p", "xyz"]


def test_coverage_keeps_uncovered_and_shared_text(spark):
    menu, passage = (" ".join(f"{w}{i}" for i in range(12)) for w in ("menu", "passage"))
    unique = lambda i: " ".join(f"u{i}x{j}" for j in range(12))
    rows = [
        *[(i, f"http://a.b/{i}", f"<div>{menu} own{i}</div><p>{passage if i < 3 else unique(100 + i)}<p>{unique(i)}") for i in range(8)],
        *[(20 + i, f"http://two.b/{i}", f"<div>{menu}</div><p>{unique(20 + i)}") for i in range(2)],
        *[(30 + i, f"http://main.b/{i}", f"<div>Home News</div><div>{unique(40 + i)}</div><article>a{i}</article>") for i in range(3)],
        *[(50 + i, f"http://copy.b/{i}", f"<p>{passage}") for i in range(3)],
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in host_suffixes.main_text(df).collect()}
    for i in range(8):  # the menu once, each own word, and the passage on all of its pages
        assert got[i] == [f"{menu} own0" if i == 0 else f"own{i}", passage if i < 3 else unique(100 + i), unique(i)]
    assert (got[20], got[21]) == ([menu, unique(20)], [unique(21)])
    assert [got[30 + i] for i in range(3)] == [["Home News"] * (i == 0) + [unique(40 + i), f"a{i}"] for i in range(3)]
    assert [got[50 + i] for i in range(3)] == [[passage], [""], [""]]


def test_license_places_and_templates(odd):
    got = {r.doc_id: r for r in license_templates.scan(odd).collect()}
    r = got[10]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (2, 3, 7, "gpl,mit")
    assert r.labels == "gpl,mit,mit-notice" and r.score == 1
    assert (got[2].n_words, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0)
    a = license_templates.compiled("t", "a<<optional>> b <<any:2>> c<</optional>> d")
    assert [a.reach(w.split(), 0) for w in ("a d", "a b c d", "a b x y c d", "a b x y z c d", "a x d")] == [2, 4, 6, None, None]


VERBATIM = {
    "mit-notice": "This project is released under the terms of the MIT License.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
    "cc-by-nc-4.0-notice": "This work is licensed under CC BY-NC 4.0.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions:""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
}


def test_templates_match_the_verbatim_texts(spark):
    assert {label for label, _ in license_templates.TEMPLATES} == set(VERBATIM)
    rows = list(enumerate(VERBATIM.items()))
    df = spark.createDataFrame([(i, "Before. " + text + " After.") for i, (_, text) in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in license_templates.scan(df).collect()}
    for i, (label, _) in rows:
        assert label in got[i].labels.split(",") and got[i].score == 1, label


@pytest.mark.parametrize("run", [lambda d, x: odd_sketch.near_duplicates(d), lambda d, x: winnowing.edited_fingerprints(d),
    lambda d, x: lpt_shards.sharded(d), lambda d, x: pattern_packing.packed(d), rule_ensemble.quality,
    classifier_chain.toxicity, lambda d, x: raking.calibrated(d), lambda d, x: license_templates.scan(d)])
def test_empty_tables(odd, labels, run):
    assert run(odd.limit(0), labels.limit(0)).count() == 0


def test_cells_hold_what_stars_would(spark, docs, monkeypatch):
    """The last round alone, over a grid of tiny cells, finds the components that all rounds find."""
    whole = {tuple(r) for r in odd_sketch.near_duplicates(docs, 85).collect()}
    monkeypatch.setattr(odd_sketch, "STARS", ())
    monkeypatch.setattr(odd_sketch, "CELL", (2, 3))
    assert {tuple(r) for r in odd_sketch.near_duplicates(docs, 85).collect()} == whole


def test_near_counts_bits_of_whole_words():
    random = np.random.default_rng(5)
    rows = 40
    base = random.integers(0, 2**64, 24, dtype=np.uint64)
    flips = [int(random.integers(0, 6)) for _ in range(rows)]
    words = np.tile(base, (rows, 1))
    for i, flip in enumerate(flips):
        for bit in random.choice(24 * 64, flip * 20, replace=False):
            words[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    n = random.integers(400, 600, rows)
    side = [np.arange(rows), np.arange(rows), n, words[:, :8], words[:, 8:]]
    most = odd_sketch.most_differing(85, odd_sketch.bands_for(85) * odd_sketch.ROWS)

    def far(x, y):
        return sum((int(p) ^ int(q)).bit_count() for p, q in zip(x, y))

    expected = {
        (i, j)
        for i in range(rows)
        for j in range(rows)
        if i != j
        and min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 85
        and far(words[i, 8:], words[j, 8:]) * 185 <= (n[i] + n[j]) * 15
        and far(words[i, :8], words[j, :8]) <= most
    }
    assert expected and len(expected) < rows * (rows - 1)
    assert set(zip(*(x.tolist() for x in odd_sketch._near(side, side, 85, most)))) == expected
