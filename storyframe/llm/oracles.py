"""SQL for the queries that SQL can express, run by DuckDB on the same tables."""

from __future__ import annotations

# Fixed value: letters whose case is folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"

ORACLES = {
    "op1_url_filter": f"""
        WITH parts AS (
          SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages),
        rules(verdict, rule_host, rule_path) AS (VALUES
          ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
          ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        fitting AS (
          SELECT page_id, host, path, r.verdict, rule_host || rule_path AS rule, row_number() OVER (
            PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
          FROM (SELECT DISTINCT * FROM parts) p JOIN rules r
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fitting f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host
          AND f.path = p.path AND f.place = 1""",
    "op5_repeated_lines": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
        keyed AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM each),
        common AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key
                   HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT k.*, c.top IS NOT NULL AND k.doc_id < c.top AS dropped
                   FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op13_hard_negatives": """
        WITH rows AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
            CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
        positives AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        fitting AS (
          SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (
              PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
            s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
          FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
        SELECT * FROM fitting WHERE rank <= 10""",
}
