WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
), starts AS (
  SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM pieces WHERE len(words) > 0
), grams AS (
  SELECT lang, words[i : i + k - 1] AS g, k FROM starts, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(words)
), f AS MATERIALIZED (
  SELECT lang, g, any_value(k) AS k, count(*)::BIGINT AS a FROM grams GROUP BY lang, g
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, g, k, a FROM f WHERE k > 1 AND a >= 30
), cuts AS (
  SELECT c.lang, c.g, c.k, c.a, cut, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : cut]
  JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1 : c.k]
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, g[i : i + s - 1] AS g, a
  FROM (SELECT *, unnest(generate_series(1, k)) AS i FROM candidates), (VALUES (2), (3)) AS sizes(s)
  WHERE s < k AND i + s - 1 <= k
), longest AS (
  SELECT lang, g, max(a) AS longer FROM inner_parts GROUP BY lang, g
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longest m ON m.lang = s.lang AND m.g = s.g
  WHERE m.longer IS NULL OR 100 * m.longer::HUGEINT < 80 * s.a::HUGEINT
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' '))::INTEGER AS rank
  FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
