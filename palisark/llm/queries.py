"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisark.llm import alignment, bpe, decontamination, exact_dedup, language_id, merkle, near_dedup, quality, secret_scan, sharding, substring_dedup, warc, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op5_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_language_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op7_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find(table(spark, sf_dir, "documents"))


def op8_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(table(spark, sf_dir, "documents"), width=2)


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op12_alignment_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_machine": op1_quality_machine,
    "op2_warc_salvage": op2_warc_salvage,
    "op3_hypergeometric_shards": op3_hypergeometric_shards,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pair_index_bpe": op5_pair_index_bpe,
    "op6_language_compression": op6_language_compression,
    "op7_two_stage_suffixes": op7_two_stage_suffixes,
    "op8_odd_sketch_near_dedup": op8_odd_sketch_near_dedup,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_randomness_battery": op10_randomness_battery,
    "op11_wrapper_extraction": op11_wrapper_extraction,
    "op12_alignment_postings": op12_alignment_postings,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    # States the contract for pages whose article holds nothing but headings, paragraphs and inline markup.
    "op11_wrapper_extraction": r"""
        WITH block AS (
            SELECT page_id, url, unnest(b) AS raw, generate_subscripts(b, 1) AS i
            FROM (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's'), '</?(?:p|h[1-6])>') AS b FROM pages)
        ), plain AS (
            SELECT page_id, url, i, regexp_replace(regexp_replace(replace(raw, '<br>', ' '), '</?[a-z][^>]*>', '', 'g'), '&quot;?', '"', 'g') AS t FROM block
        ), line AS (
            SELECT page_id, url, i, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM plain
        ), joined AS (
            SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text FROM line GROUP BY page_id, url
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM joined
    """,
    "op13_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n,
                   coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                       || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
                   list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda crc, c:
                       list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: i::UBIGINT)), lambda x, i:
                           CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS crc
            FROM documents
        ), leaf AS (
            SELECT doc_id, lang, p, n, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                   sha256(head || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS tampered,
                   xor(crc, 4294967295::UBIGINT) % 7 = 0 AS chosen
            FROM d
        ), low AS (
            SELECT lang, 0 AS l, p, n, leaf AS h FROM leaf
            UNION ALL
            SELECT lang, l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY lang, l, n, p // 2
        ), member AS (
            SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1
        ), top AS (
            SELECT 0 AS l, p, n, h FROM member
            UNION ALL
            SELECT l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY l, n, p // 2
        ), fold AS (
            SELECT doc_id, lang, p AS i, 0 AS l, n, leaf, CASE WHEN chosen THEN tampered ELSE leaf END AS x, '' AS siblings FROM leaf
            UNION ALL
            SELECT f.doc_id, f.lang, i // 2, f.l + 1, (f.n + 1) // 2, leaf,
                   sha256(CASE WHEN s.h IS NULL THEN x WHEN i % 2 = 1 THEN s.h || x ELSE x || s.h END), siblings || coalesce(s.h, '')
            FROM fold f LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM f.lang AND s.l = f.l AND s.p = xor(i, 1)
            WHERE f.n > 1
        ), upper AS (
            SELECT doc_id, m.p AS i, 0 AS l, m.n, leaf, m.h AS subroot, x, siblings FROM fold JOIN member m ON m.lang IS NOT DISTINCT FROM fold.lang
            WHERE fold.n = 1
            UNION ALL
            SELECT f.doc_id, i // 2, f.l + 1, (f.n + 1) // 2, leaf, subroot,
                   sha256(CASE WHEN s.h IS NULL THEN x WHEN i % 2 = 1 THEN s.h || x ELSE x || s.h END), siblings || coalesce(s.h, '')
            FROM upper f LEFT JOIN top s ON s.l = f.l AND s.p = xor(i, 1)
            WHERE f.n > 1
        )
        SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, x AS folded_root, x = root AS verified
        FROM upper, (SELECT h AS root FROM top WHERE n = 1) WHERE n = 1
    """,
}
