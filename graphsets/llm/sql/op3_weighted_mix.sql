WITH sized AS (
  SELECT doc_id, source, coalesce(md5(text), '') AS tie, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), rated AS (
  SELECT s.*, coalesce(q.quality, 0.5) AS quality
  FROM sized s LEFT JOIN (
    SELECT doc_id, CASE WHEN max(quality) >= 1 THEN 1.0 WHEN max(quality) < 1 THEN 0.25 ELSE 0.5 END AS quality
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) q ON s.doc_id = q.doc_id
), keyed AS (
  SELECT *, -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || tie), 1, 12)) AS BIGINT) + 0.5::DOUBLE)
                / 281474976710656.0::DOUBLE) / CAST(quality AS DOUBLE) AS key
  FROM rated
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS most FROM sources
), levels AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total FROM weighted
), capped AS (
  SELECT *, spent * w + most * open <= total * w AS is_full FROM levels
), level AS (
  SELECT arg_min((total - spent)::DOUBLE / open::DOUBLE, most / w) AS height FROM capped WHERE NOT is_full
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE height * w END AS target
  FROM capped LEFT JOIN level ON true
), placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN start + size / 2 <= target - epochs * source_size AND epochs < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
