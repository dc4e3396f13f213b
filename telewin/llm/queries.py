"""The operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    classifier_chain,
    host_suffixes,
    license_templates,
    lpt_shards,
    member_lloyd,
    merkle_manifest,
    odd_sketch,
    oracle,
    parity_join,
    pattern_packing,
    pivot_index,
    raking,
    rule_ensemble,
    winnowing,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weights and sampling of all documents, for half of the tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return raking.calibrated(docs, 0.5).drop("text")


def op2_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return lpt_shards.sharded(table(spark, sf_dir, "documents"), 24)


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pattern_packing.packed(table(spark, sf_dir, "documents"))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return rule_ensemble.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every twentieth vector among all vectors."""
    return pivot_index.top_k(table(spark, sf_dir, "embeddings"), 20, 20)


def op8_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return classifier_chain.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return host_suffixes.main_text(table(spark, sf_dir, "pages"))


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of all documents."""
    return license_templates.scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_member_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four parts of all vectors, and their errors."""
    return member_lloyd.compressed(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and checks of all documents in one Merkle tree."""
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


def op13_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share nine tenths of their 3-word shingles."""
    return parity_join.ngram_components(table(spark, sf_dir, "documents"), percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_raking": op1_raking,
    "op2_odd_sketch": op2_odd_sketch,
    "op3_winnowing": op3_winnowing,
    "op4_lpt_shards": op4_lpt_shards,
    "op5_pattern_packing": op5_pattern_packing,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_pivot_index": op7_pivot_index,
    "op8_classifier_chain": op8_classifier_chain,
    "op9_host_suffixes": op9_host_suffixes,
    "op10_license_templates": op10_license_templates,
    "op11_member_lloyd": op11_member_lloyd,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_parity_join": op13_parity_join,
    "pipeline": pipeline,
}

# The others hash words, tokenize, or fit a model, which SQL of another engine can't follow;
# tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    "op2_odd_sketch": oracle.similar_documents(5, 85, "*, doc_id = component_id as kept"),
    "op11_member_lloyd": oracle.vector_codes(),
    "op12_merkle_manifest": oracle.manifest(),
    "op13_parity_join": oracle.similar_documents(3, 90, "*"),
    "op7_pivot_index": """
        with v as (
            select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as x
            from (select vec_id, embedding from embeddings where embedding is not null and vec_id is not null)
            where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        pairs as (
            select q.row, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
            from v q join v c on q.row <> c.row and len(q.x) = len(c.x) where q.vec_id % 20 = 0
        ),
        ranked as (
            select *, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank from pairs
        )
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
    "op10_license_templates": r"""
        with w as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents
        ),
        places as (
            select doc_id, i - 1 as place, case when words[i] = 'mit' then 'mit' when words[i] = 'apache' then 'apache' else 'gpl' end as label
            from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from w)
            where (words[i] = 'mit' and words[i + 1] = 'license') or (words[i] = 'apache' and words[i + 1] = 'license')
               or (words[i] = 'general' and words[i + 1] = 'public' and words[i + 2] = 'license')
        ),
        base as (
            select doc_id, count(*) as n, min(place) as lo, max(place) as hi, list_sort(list(distinct label)) as labels
            from places group by doc_id
        ),
        t as (select *, ' ' || array_to_string(words, ' ') || ' ' as line from w),
        found as (
            select doc_id, len(words) as n_words, list_filter([
                case when regexp_matches(line, ' released under the( terms of the)? mit license ') then 'mit-notice' end,
                case when regexp_matches(line, ' licensed under the apache license version 2 0 ') then 'apache-2.0-notice' end,
                case when regexp_matches(line, ' under the( terms of the)?( gnu)? general public license( as published by the free software foundation)?( either)? version 3 ') then 'gpl-3.0-notice' end,
                case when regexp_matches(line, ' licensed under( the)? cc by nc 4 0 ') then 'cc-by-nc-4.0-notice' end,
                case when regexp_matches(line, ' permission is hereby granted free of charge to any person obtaining a copy of( [^ ]+){0,10} to deal in( [^ ]+){0,3} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software ') then 'mit-text' end,
                case when regexp_matches(line, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met( 1)? redistributions of source code must retain the above copyright notice ') then 'bsd-text' end
            ], lambda x: x is not null) as labels
            from t
        )
        select found.doc_id, cast(n_words as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base,
               cast(lo as bigint) as first_word, cast(hi as bigint) as last_word,
               coalesce(array_to_string(base.labels, ','), '') as base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), found.labels))), ','), '') as labels,
               cast(case when len(found.labels) > 0 then 1 when n > 0 then 0.5 else 0 end as double) as score
        from found left join base on found.doc_id = base.doc_id
    """,
}
