"""The rules of ``derive`` as common table expressions for the comparison engine."""

from __future__ import annotations

from feedloom.schema import SAVED_PAGES_ID as HIDDEN

_TITLE = r"coalesce(nullif(trim(regexp_extract(text, '^[^.\n]*', 0)), ''), 'Untitled')"
_URL = "'https://' || source || '.example.com/' || lang || '/' || doc_id"
_PUBLISHED = (
    "CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST((doc_id * 37) % 720 AS INTEGER)) END"
)

PREFIX = f"""
WITH t_doc AS (
  SELECT *, {_TITLE} AS d_title, {_URL} AS d_url, {_PUBLISHED} AS d_published FROM documents
),
t_article AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 33 = 0 OR doc_id % 50 = 7 THEN '{HIDDEN}' ELSE source END AS source_id,
    d_title AS title, d_url AS article_url, d_published AS published_at,
    TIMESTAMP '2024-02-01' + to_minutes(CAST(doc_id % 1440 AS INTEGER)) AS added_at,
    CASE WHEN doc_id % 4 <> 0 THEN 'https://img.example.com/' || doc_id || '.jpg' END AS thumbnail_url,
    CASE WHEN (doc_id // 7) % 10 NOT IN (7, 8, 9) THEN TIMESTAMP '2024-02-02' + to_minutes(CAST(doc_id % 1440 AS INTEGER)) END AS cached_at,
    CASE (doc_id // 7) % 10 WHEN 6 THEN 'partial' WHEN 7 THEN 'pending' WHEN 8 THEN 'failed' WHEN 9 THEN 'fetching' ELSE 'cached' END AS fetch_status,
    doc_id % 3 = 0 AS is_read, doc_id % 11 = 0 AS is_saved,
    CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-03-01' + to_minutes(CAST(doc_id % 1440 AS INTEGER)) END AS saved_at,
    CASE WHEN doc_id % 5 = 0 THEN 'Wire ' || lang END AS original_source_name,
    CAST(NULL AS VARCHAR) AS original_source_icon_url,
    CASE WHEN (doc_id // 7) % 10 NOT IN (7, 8, 9) THEN n_chars END AS cache_size_bytes,
    CAST(NULL AS BIGINT) AS last_http_status,
    CASE WHEN doc_id % 2 = 0 THEN 'e' || doc_id END AS etag,
    doc_id % 4 AS retry_count,
    greatest(1, (n_chars // 6 + 199) // 200) AS reading_minutes,
    CASE WHEN doc_id % 4 <> 3 THEN text END AS rss_content_html
  FROM t_doc
),
t_source AS (
  SELECT source AS id, 'Feed ' || source AS title,
    'https://' || source || '.example.com/feed' AS feed_url,
    'https://www.' || source || '.example.com/' AS site_url,
    CASE WHEN n0 % 2 = 0 THEN 'https://' || source || '.example.com/icon.png' END AS icon_url,
    CASE WHEN n0 % 6 <> 0 THEN TIMESTAMP '2024-03-01 12:00:00' - to_minutes(CAST((n0 % 5) * 20 AS INTEGER)) END AS last_fetched_at,
    CASE WHEN n0 % 4 = 1 THEN 'failed' ELSE 'completed' END AS fetch_status,
    CASE n0 % 3 WHEN 0 THEN NULL WHEN 1 THEN 'standard' ELSE 'full' END AS cache_level,
    CASE WHEN n0 % 2 = 1 THEN 'cards' END AS layout,
    false AS is_collapsed, n0 AS sort_order
  FROM (SELECT source, min(doc_id) AS n0 FROM documents GROUP BY source)
  UNION ALL
  SELECT '{HIDDEN}', 'Saved Pages', 'saved-pages', NULL, NULL, NULL, NULL, NULL, NULL, false, -1
),
t_page AS (
  SELECT id AS article_id, 'shared' || CAST(id AS BIGINT) % 50 AS asset_a, 'own' || id AS asset_b,
    cache_size_bytes * 2 AS total_size_bytes,
    CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'full' ELSE 'standard' END AS cache_level_used
  FROM t_article WHERE fetch_status IN ('cached', 'partial')
),
t_content AS (
  SELECT CAST(doc_id AS VARCHAR) AS article_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars END AS content_chars
  FROM documents
),
t_pool AS (
  SELECT DISTINCT 'shared' || doc_id % 60 AS asset_key FROM documents
  UNION ALL SELECT 'own' || doc_id FROM documents
),
t_item AS (
  SELECT source AS source_id, 'https://' || source || '.example.com/feed' AS feed_url, doc_id AS pos,
    CASE WHEN doc_id % 3 = 1 THEN d_title || ' (update ' || doc_id || ')' ELSE d_title END AS title,
    CASE WHEN doc_id % 13 = 0 THEN 'https://accounts.' || source || '.example.com/login?n=' || doc_id
         WHEN doc_id % 17 = 0 THEN 'https://news.google.com/rss/articles/' || doc_id
         WHEN doc_id % 3 = 1 THEN d_url || '/update'
         WHEN doc_id % 5 = 0 THEN d_url || '?v=2' ELSE d_url END AS url,
    d_published AS published_at,
    CASE WHEN doc_id % 4 <> 0 THEN 'https://img.example.com/' || doc_id || '.jpg' END AS thumbnail_url,
    text AS content_html,
    doc_id % 13 = 0 AS is_login, doc_id % 13 <> 0 AND doc_id % 17 = 0 AS is_agg
  FROM t_doc
),
t_redirect AS (
  SELECT 'https://news.google.com/rss/articles/' || doc_id AS from_url,
    CASE WHEN doc_id % 2 = 0 THEN d_url WHEN doc_id % 3 <> 0 THEN 'https://real.example.org/' || doc_id END AS to_url
  FROM t_doc
),
t_response AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE doc_id % 12 WHEN 0 THEN 304 WHEN 1 THEN 404 ELSE 200 END AS status,
    CASE WHEN doc_id % 13 = 0 THEN 'application/json' ELSE 'text/html; charset=utf-8' END AS content_type,
    n_chars * 3 AS body_bytes, CASE WHEN doc_id % 5 = 0 THEN 'n' || doc_id END AS etag,
    n_chars AS text_chars, n_chars // 6 AS word_count, doc_id % 8 = 0 AS any_failed,
    n_chars // 2 AS rss_chars, n_chars // 12 AS rss_word_count, n_chars * 2 AS total_bytes
  FROM documents
),
t_action AS (
  SELECT ts, event_id AS seq, user_id, json_extract_string(props, '$.k') AS article_id,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'toggle_read' WHEN 'purchase' THEN 'toggle_save'
         WHEN 'error' THEN 'fetch_failed' ELSE 'subscribe' END AS action
  FROM events
),
t_dir0 AS (
  SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+/([a-z]{{2}})/', 1) AS l FROM pages
),
t_dir AS (
  SELECT 'd' || page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name,
    CASE WHEN page_id % 4 = 0 THEN 'http' ELSE 'https' END || '://' || h || '/' || l || '/feed' || CASE WHEN page_id % 5 = 0 THEN '/' ELSE '' END AS feed_url,
    CASE WHEN page_id % 9 <> 0 THEN 'http://' || h || '/' END AS site_url,
    regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS description,
    CASE l WHEN 'en' THEN 'Tech' WHEN 'fr' THEN 'Science' WHEN 'de' THEN 'Germany' ELSE 'Spain' END AS category,
    CASE l WHEN 'de' THEN 'Germany' WHEN 'es' THEN 'Spain' END AS country,
    l AS tag1, regexp_extract(h, '([^.]+)[.]example[.]', 1) AS tag2, h, l,
    CASE WHEN page_id % 6 <> 0 THEN DATE '2024-01-01' + CAST((page_id * 13) % 180 AS INTEGER) END AS last_verified, page_id AS pos
  FROM t_dir0
),
t_fetch0 AS (SELECT feed_url AS url, min(pos) AS k FROM t_dir GROUP BY feed_url),
t_fetch1 AS (
  SELECT url, k, 1 AS attempt, CASE WHEN k % 5 = 0 THEN 503 ELSE 200 END AS status FROM t_fetch0
),
t_fetch AS (
  SELECT *, CASE WHEN status <> 200 THEN 'unreachable' WHEN k % 7 = 0 THEN 'redirectsToHTTP' WHEN k % 11 = 0 THEN 'notAFeed'
              WHEN k % 13 = 0 THEN 'malformedXML' END AS issue,
    CAST(TIMESTAMP '2024-06-01' - to_days(CAST(k % 10 AS INTEGER) * 40) AS TIMESTAMP) AS newest
  FROM (SELECT * FROM t_fetch1 UNION ALL
        SELECT url, k, 2, CASE WHEN k % 2 = 0 THEN 200 ELSE 503 END FROM t_fetch1 WHERE status = 503)
)
"""
