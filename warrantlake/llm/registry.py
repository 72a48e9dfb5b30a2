"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warrantlake.llm import centroids, decontaminate, html_text, language, licences, packing, quality, sharding, simhash, spelling, toxicity, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_histogram_sort": sharding.op2_histogram_sort,
    "op3_zip_warc": warc.op3_zip_warc,
    "op4_mcd": quality.op4_mcd,
    "op5_fm_index": decontaminate.op5_fm_index,
    "op6_simhash": simhash.op6_simhash,
    "op7_rare_tokens": licences.op7_rare_tokens,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_blocks": html_text.op9_blocks,
    "op10_language": language.op10_language,
    "op11_subspace_pigeonhole": vectors.op11_subspace_pigeonhole,
    "op12_bloom_edits": spelling.op12_bloom_edits,
    "op13_geometric_drift": centroids.op13_geometric_drift,
}

#: The rest hash with XXH64, tokenize, learn or iterate: tests/llm hold them against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op3_zip_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM p LEFT JOIN o ON o.payload_digest = p.payload_digest AND payload_bytes >= 1000""",
    "op5_fm_index": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        phrases AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
                    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
        starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrases)),
        hits AS (SELECT doc_id, i, s.n, item_id FROM starts s JOIN phrases p ON p.n = s.n AND p.phrase = array_to_string(w[i:i + s.n - 1], ' ')),
        words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM hits) GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_subspace_pigeonhole": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        u AS MATERIALIZED (SELECT r, label, CASE WHEN label IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false)))
                           AND list_bool_or(list_transform(e, lambda x: coalesce(x <> 0, false))) THEN e END AS e FROM v),
        ok AS MATERIALIZED (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM u WHERE e IS NOT NULL),
        l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        reach AS (SELECT r, r AS t FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.t),
        c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY 1),
        n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op13_geometric_drift": centroids.oracle(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
