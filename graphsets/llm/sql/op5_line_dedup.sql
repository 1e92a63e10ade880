WITH named AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, text) AS row_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
), lines AS (
  SELECT row_id, doc_id, text, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS pos FROM named
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10
), kept AS (
  SELECT row_id, count(*) AS n_lines, count(c.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '') AS text
  FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY row_id
)
SELECT n.doc_id, k.n_lines, k.n_dropped, sha256(k.text) AS kept_sha256 FROM kept k JOIN named n USING (row_id)
