WITH captures AS (
  SELECT page_id * 4 AS record_id, url, 'response' AS type, page_id * 60 AS at,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS etag,
         CASE WHEN page_id % 13 = 0 THEN NULL ELSE CAST(page_id * 60 - 3600 AS VARCHAR) END AS modified,
         'no-cache' AS cache, html AS payload
  FROM pages
  UNION ALL
  SELECT page_id * 4 + 1, url, 'revisit', page_id * 60 + 86400,
         CASE WHEN page_id % 7 = 0 THEN '"other"' WHEN page_id % 11 = 0 THEN NULL
              WHEN page_id % 3 = 0 THEN 'W/"' || substr(md5(coalesce(html, '')), 1, 16) || '"'
              ELSE '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' END,
         CASE WHEN page_id % 13 = 0 THEN NULL ELSE CAST(page_id * 60 - 3600 AS VARCHAR) END,
         'max-age=' || CAST(page_id % 100 AS VARCHAR), NULL
  FROM pages
  UNION ALL
  SELECT page_id * 4 + 2, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/robots.txt',
         CASE WHEN page_id % 10 = 0 THEN 'response' ELSE 'revisit' END, page_id * 60 + 30,
         '"r' || CAST(page_id // 50 AS VARCHAR) || '"', NULL,
         CASE WHEN page_id % 10 = 0 THEN 'no-cache' ELSE 'max-age=' || CAST(page_id % 100 AS VARCHAR) END,
         CASE WHEN page_id % 10 = 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || CAST(page_id AS VARCHAR) END
  FROM pages
), bare AS (
  SELECT *, row_number() OVER () AS row, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM captures
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www\.', ''),
           CASE WHEN scheme = 'https' THEN ':443$' WHEN scheme IN ('http', '') THEN ':80$' ELSE '^$' END, '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS params
  FROM bare
), keyed AS (
  SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM parts
), matched AS (
  SELECT r.record_id AS revisit_id, r.url_key, s.record_id AS response_id, r.at AS r_at, r.cache AS r_cache, s.payload,
         CASE WHEN s.record_id IS NULL THEN 'unmatched'
              WHEN r.etag IS NOT NULL AND s.etag IS NOT NULL THEN
                CASE WHEN regexp_replace(r.etag, '^W/', '') = regexp_replace(s.etag, '^W/', '') THEN 'resolved' ELSE 'changed' END
              WHEN r.modified IS NOT NULL AND s.modified IS NOT NULL THEN
                CASE WHEN r.modified = s.modified THEN 'resolved' ELSE 'changed' END
              ELSE 'unchecked' END AS status
  FROM keyed r LEFT JOIN keyed s ON r.url_key = s.url_key AND s.type = 'response' AND s.at < r.at
  WHERE r.type = 'revisit'
  QUALIFY row_number() OVER (PARTITION BY r.row ORDER BY s.at DESC NULLS LAST, s.record_id DESC, s.etag DESC NULLS LAST, s.modified DESC NULLS LAST) = 1
)
SELECT revisit_id, url_key, response_id, status,
       CASE WHEN status = 'resolved' THEN 'cache-control: ' || r_cache || chr(10) || 'content-length: '
         || CAST(strlen(coalesce(payload, '')) AS VARCHAR) || chr(10) || 'date: ' || CAST(r_at AS VARCHAR) END AS headers,
       CASE WHEN status = 'resolved' THEN md5(payload) END AS payload_md5
FROM matched
