"""The operators' registered queries, with the parameters meant for production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm import context_tree, exact_dedup, html_text, line_dedup, mixing, packing, quality_model, quality_rules, resampling, simhash, url_filter, warc, whitening
from ripplegraph.llm.common import read


def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(read(spark, sf_dir, "documents"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents"))


def op4_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(read(spark, sf_dir, "documents"), "sentence")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, radius=4)


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"))


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rebuilt(read(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (
    op1_context_tree_scores,
    op2_page_text,
    op3_quality_rules,
    op4_repeated_lines,
    op5_mix_sources,
    op6_simhash_components,
    op7_url_verdicts,
    op8_exact_duplicates,
    op9_pack_windows,
    op10_quality_scores,
    op11_whitened_embeddings,
    op12_importance_sample,
    op13_page_archive,
    pipeline,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For the others SQL has no form: their tests hold them against brute force or round trips.
ORACLES = {
    "op7_url_verdicts": f"""
        WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hosts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM parts),
        both_ AS (SELECT page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
        ruled AS (SELECT *, CASE
            WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM both_),
        hosts_ AS (SELECT host, host <> '' AND count(*) <= 4 * count(*) FILTER (WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/')) AND count(*) FILTER (WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/')) > 0 AS listed
            FROM ruled GROUP BY host),
        known AS (SELECT ruled.*, hosts_.listed FROM ruled JOIN hosts_ USING (host))
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM known""",
    "op8_exact_duplicates": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS n FROM documents),
        g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.n) AS text_sha256 FROM t JOIN g ON g.n = t.n""",
    "op13_page_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        g AS (SELECT body, max(page_id) AS last FROM p GROUP BY body),
        r AS (SELECT p.page_id, p.body, g.last, octet_length(encode(p.body)) >= 1000 AND p.page_id IS DISTINCT FROM g.last AS again FROM p JOIN g ON g.body = p.body)
        SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r""",
}


def oracle_sql():
    return dict(ORACLES)
