"""The registered queries in SQL, over the same parquet tables.

Each statement is put together from shared WITH clauses. They state what the
result is; how it is reached differs from the DataFrame code wherever that is
possible (row numbers over whole groups, recursive unions, long fact tables).
"""

from __future__ import annotations

import re

from checks.queries import BIN_CAP, KEY_CAP, LABEL_CAP, MAX_K
from checks.wordings import INDEPENDENT, NO_RELATION, OPTION, SUFFIX, WORDINGS

BOX = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
FULL = 1 << 60


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def draw(purpose: str, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '42', '{purpose}', {', '.join(keys)})), 1, 15))::BIGINT)"


def chance(p: float, drawn: str) -> str:
    return f"({drawn} < {int(p * FULL)})"


def entity(key: str) -> str:
    return f"'P' || lpad(({key})::VARCHAR, 9, '0')"


CTES: dict[str, str] = {}

CTES["parts"] = f"""
SELECT p_partkey // 20 AS graph_idx, {entity('p_partkey')} AS entity, p_partkey % 20 AS ord FROM part"""

CTES["edges"] = f"""
SELECT DISTINCT g AS graph_idx, {entity('p')} AS parent, {entity('q')} AS child FROM (
  SELECT g, p, lead(p) OVER (PARTITION BY g, l_shipdate, l_returnflag ORDER BY p) AS q FROM (
    SELECT DISTINCT l_partkey // 20 AS g, l_partkey AS p, l_shipdate, l_returnflag FROM lineitem))
WHERE q IS NOT NULL"""

CTES["closure"] = """
SELECT graph_idx, parent AS ancestor, child AS descendant FROM edges
UNION
SELECT c.graph_idx, c.ancestor, e.child FROM closure c
JOIN edges e ON e.graph_idx = c.graph_idx AND e.parent = c.descendant"""

CTES["related"] = """
SELECT graph_idx, ancestor AS first, descendant AS second, 'ancestor' AS relation FROM closure
UNION ALL SELECT graph_idx, descendant, ancestor, 'descendant' FROM closure"""

CTES["pairs"] = """
SELECT a.graph_idx, a.entity AS first, b.entity AS second, coalesce(r.relation, 'independent') AS relation
FROM parts a JOIN parts b ON a.graph_idx = b.graph_idx AND a.entity <> b.entity
LEFT JOIN related r ON r.graph_idx = a.graph_idx AND r.first = a.entity AND r.second = b.entity"""

CTES["touching"] = """
SELECT graph_idx, entity AS a, entity AS b FROM parts
UNION
SELECT t.graph_idx, t.a, CASE WHEN e.parent = t.b THEN e.child ELSE e.parent END FROM touching t
JOIN edges e ON e.graph_idx = t.graph_idx AND (e.parent = t.b OR e.child = t.b)"""

CTES["components"] = """
SELECT graph_idx, entity, component_root,
  dense_rank() OVER (PARTITION BY graph_idx ORDER BY component_root) - 1 AS component_id
FROM (SELECT graph_idx, a AS entity, min(b) AS component_root FROM touching GROUP BY ALL)"""

CTES["nodes"] = f"""
SELECT p.graph_idx, p.entity, p.ord, c.component_id,
  CASE WHEN (p.graph_idx, p.entity) NOT IN (SELECT (graph_idx, child) FROM edges) THEN 'ROOT'
       WHEN {chance(0.6, draw('rule', 'p.graph_idx', 'p.entity'))} THEN 'OR' ELSE 'AND' END AS rule
FROM parts p JOIN components c ON c.graph_idx = p.graph_idx AND c.entity = p.entity"""

CTES["linked"] = """
SELECT n.graph_idx, n.entity, n.rule,
  coalesce(u.parents, []) AS parents, coalesce(d.children, []) AS children
FROM nodes n
LEFT JOIN (SELECT graph_idx, child AS entity, list(parent ORDER BY parent) AS parents FROM edges GROUP BY ALL) u
  ON u.graph_idx = n.graph_idx AND u.entity = n.entity
LEFT JOIN (SELECT graph_idx, parent AS entity, list(child ORDER BY child) AS children FROM edges GROUP BY ALL) d
  ON d.graph_idx = n.graph_idx AND d.entity = n.entity"""

CTES["walks"] = """
SELECT graph_idx, entity, 0::BIGINT AS depth FROM parts
WHERE (graph_idx, entity) NOT IN (SELECT (graph_idx, child) FROM edges)
UNION
SELECT e.graph_idx, e.child, w.depth + 1 FROM walks w
JOIN edges e ON e.graph_idx = w.graph_idx AND e.parent = w.entity"""

CTES["levels"] = "SELECT graph_idx, entity, max(depth) AS depth FROM walks GROUP BY ALL"

CTES["worlds"] = """
SELECT unnest(generate_series(0, (SELECT max((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) FROM lineitem))) AS world_id"""

CTES["given"] = f"""
SELECT n.graph_idx, n.entity, w.world_id, s.entity IS NOT NULL AS value
FROM nodes n CROSS JOIN worlds w
LEFT JOIN (SELECT DISTINCT {entity('l_partkey')} AS entity,
             (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS world_id FROM lineitem) s
  ON s.entity = n.entity AND s.world_id = w.world_id
WHERE n.rule = 'ROOT'"""

CTES["ruled"] = """
SELECT e.graph_idx, e.parent, e.child, n.rule, l.depth FROM edges e
JOIN nodes n ON n.graph_idx = e.graph_idx AND n.entity = e.child
JOIN levels l ON l.graph_idx = e.graph_idx AND l.entity = e.child"""

# Each step hands on all facts so far and adds the nodes of the next level.
CTES["stepped"] = """
SELECT 0::BIGINT AS step, graph_idx, entity, world_id, value FROM given
UNION ALL
SELECT step + 1, graph_idx, entity, world_id, value FROM (
  SELECT step, graph_idx, entity, world_id, value FROM stepped
  UNION ALL
  SELECT f.step, f.graph_idx, r.child, f.world_id,
    CASE WHEN any_value(r.rule) = 'OR' THEN bool_or(f.value) ELSE bool_and(f.value) END
  FROM stepped f JOIN ruled r ON r.graph_idx = f.graph_idx AND r.parent = f.entity AND r.depth = f.step + 1
  GROUP BY f.step, f.graph_idx, r.child, f.world_id)
WHERE step < (SELECT max(depth) FROM levels)"""

CTES["facts"] = """
SELECT graph_idx, entity, world_id, value FROM stepped WHERE step = (SELECT max(depth) FROM levels)"""


def share(n: str, ratio: float) -> str:
    return f"(CASE WHEN {n} >= 3 THEN greatest(round_even({n} * {ratio}, 0), 1) ELSE round_even({n} * {ratio}, 0) END)::BIGINT"


def split_sql(source: str, keys: list[str], item: list[str], val: float, test: float, columns: str) -> str:
    """Exact split of a relation; the shrinking is an explicit step by step recursion."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    drawn = draw("split", *keys, *item)
    return f"""
SELECT {columns}, CASE WHEN r <= v THEN 'val' WHEN r <= v + t THEN 'test' ELSE 'train' END AS split FROM (
  SELECT s.*, (SELECT x.v FROM sizes x WHERE x.n = s.n AND x.done) AS v,
         (SELECT x.t FROM sizes x WHERE x.n = s.n AND x.done) AS t
  FROM (SELECT *, row_number() OVER ({part}ORDER BY {drawn}, {', '.join(item)}) AS r,
          count(*) OVER ({part}) AS n FROM {source}) s)"""


def sizes_sql(counts: str, val: float, test: float) -> str:
    return f"""
SELECT n, v, t, v + t <= greatest(n - 1, 0) AS done FROM (
  SELECT DISTINCT n, {share('n', val)} AS v, {share('n', test)} AS t FROM ({counts}))
UNION ALL
SELECT n, v, t, v + t <= greatest(n - 1, 0) FROM (
  SELECT n, CASE WHEN t >= v AND t > 0 THEN v ELSE v - 1 END AS v,
            CASE WHEN t >= v AND t > 0 THEN t - 1 ELSE t END AS t FROM sizes WHERE NOT done)"""


CTES["sizes"] = sizes_sql("SELECT count(*) AS n FROM parts GROUP BY graph_idx", 0.1, 0.1)
CTES["entity_split"] = split_sql("parts", ["graph_idx"], ["entity"], 0.1, 0.1, "graph_idx, entity")


def specs_sql(nodes: str, component: bool) -> str:
    on = "AND b.component_id = a.component_id" if component else ""
    on2 = "AND c.component_id = a.component_id" if component else ""
    return f"""
SELECT *, row_number() OVER (PARTITION BY graph_idx ORDER BY query_ord, obs_size, o1, o2) - 1 AS spec_ord FROM (
  SELECT a.graph_idx, a.component_id, a.entity AS query_entity, a.ord AS query_ord, 1::BIGINT AS obs_size,
    [b.entity] AS observed, b.ord AS o1, -1 AS o2
  FROM {nodes} a JOIN {nodes} b ON b.graph_idx = a.graph_idx {on} AND b.ord <> a.ord
  UNION ALL
  SELECT a.graph_idx, a.component_id, a.entity, a.ord, 2, [b.entity, c.entity], b.ord, c.ord
  FROM {nodes} a JOIN {nodes} b ON b.graph_idx = a.graph_idx {on} AND b.ord <> a.ord
  JOIN {nodes} c ON c.graph_idx = a.graph_idx {on2} AND c.ord <> a.ord AND c.ord > b.ord)"""


LABELS = """
SELECT * EXCLUDE (t1, t2), list_filter(['ancestor', 'descendant', 'independent'], lambda x: x = t1 OR x = t2) AS types FROM (
  SELECT s.*, coalesce(r1.relation, 'independent') AS t1,
    CASE WHEN s.obs_size = 2 THEN coalesce(r2.relation, 'independent') END AS t2
  FROM {specs} s
  LEFT JOIN related r1 ON r1.graph_idx = s.graph_idx AND r1.first = s.observed[1] AND r1.second = s.query_entity
  LEFT JOIN related r2 ON r2.graph_idx = s.graph_idx AND r2.first = s.observed[2] AND r2.second = s.query_entity)"""

# Many more tries than are needed; the first distinct ordinals decide.
SAMPLED = """
SELECT graph_idx, world_id, spec_ord FROM (
  SELECT graph_idx, world_id, spec_ord, want,
    row_number() OVER (PARTITION BY graph_idx, world_id ORDER BY try) AS r
  FROM (SELECT graph_idx, world_id, spec_ord, any_value(want) AS want, min(try) AS try FROM (
    SELECT g.graph_idx, w.world_id, g.want, try, {drawn} % g.n AS spec_ord
    FROM (SELECT graph_idx, count(*) AS n, least(count(*), greatest(1, round_even(count(*) * 0.002, 0)::BIGINT)) AS want
          FROM {specs} GROUP BY graph_idx) g
    CROSS JOIN worlds w CROSS JOIN (SELECT unnest(generate_series(0, 99)) AS try))
  GROUP BY graph_idx, world_id, spec_ord)) WHERE r <= want"""

OBSERVED = """
SELECT s.graph_idx, s.world_id, s.spec_ord, l.component_id, l.query_entity, l.observed, l.types,
  [CASE WHEN f1.value THEN '1' ELSE '0' END] ||
    CASE WHEN l.obs_size = 2 THEN [CASE WHEN f2.value THEN '1' ELSE '0' END] ELSE [] END AS vals,
  CASE WHEN q.value THEN '1' ELSE '0' END AS answer
FROM {sampled} s JOIN {labels} l ON l.graph_idx = s.graph_idx AND l.spec_ord = s.spec_ord
JOIN facts q ON q.graph_idx = s.graph_idx AND q.world_id = s.world_id AND q.entity = l.query_entity
JOIN facts f1 ON f1.graph_idx = s.graph_idx AND f1.world_id = s.world_id AND f1.entity = l.observed[1]
LEFT JOIN facts f2 ON f2.graph_idx = s.graph_idx AND f2.world_id = s.world_id AND f2.entity = l.observed[2]"""

for prefix, nodes_name, component in (("", "nodes", False), ("c_", "nodes", True)):
    CTES[f"{prefix}specs"] = specs_sql(nodes_name, component)
    CTES[f"{prefix}labels"] = LABELS.format(specs=f"{prefix}specs")
    CTES[f"{prefix}sampled"] = SAMPLED.format(
        specs=f"{prefix}specs", drawn=draw("spec", "g.graph_idx", "w.world_id", "try")
    )
    CTES[f"{prefix}observed"] = OBSERVED.format(sampled=f"{prefix}sampled", labels=f"{prefix}labels")

CTES["wordings"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(family)}, {i}, {quoted(line)})" for family, lines in WORDINGS.items() for i, line in enumerate(lines)
) + ") AS w(family, template_idx, template)"

OBSERVATIONS = """
SELECT concat_ws('|', 'o', graph_idx, world_id, spec_ord, template_idx) AS row_key, o.*,
  array_to_string(list_transform(list_zip(observed, vals), lambda x: x[1] || ' is ' || x[2]), ' and ') AS facts_and,
  array_to_string(list_transform(list_zip(observed, vals), lambda x: x[1] || ' is ' || x[2]), ', ') AS facts_comma,
  w.template
FROM {observed} o JOIN wordings w
  ON w.family = CASE WHEN len(observed) = 1 THEN 'observation_single' ELSE 'observation_multi' END AND w.template_idx < 10"""
CTES["observations"] = OBSERVATIONS.format(observed="observed")
CTES["c_observations"] = OBSERVATIONS.format(observed="c_observed")

CTES["observation_rows"] = """
SELECT answer, '\\boxed{' || answer || '}' AS completion, NULL::VARCHAR AS explanation_type, graph_idx,
  array_to_string(types, '|') AS inference_types, 'observation' AS kind,
  array_to_string(observed, '|') AS observed_entities, array_to_string(vals, '|') AS observed_values,
  types[1] AS primary_inference_type,
  replace(replace(replace(replace(template, '{F}', facts_and), '{A}', facts_and), '{C}', facts_comma), '{Q}', query_entity) AS prompt,
  query_entity, 'train' AS split, row_key
FROM observations"""

SINGLE = """
SELECT a.graph_idx, a.family, a.entity AS query_entity, a.entity AS first, NULL::VARCHAR AS second, a.answer, s.split FROM (
  SELECT graph_idx, 'rule' AS family, entity, CASE WHEN rule = 'ROOT' THEN entity || ' is a root node'
    ELSE entity || ' = ' || rule || '(' || array_to_string(parents, ', ') || ')' END AS answer FROM linked
  UNION ALL SELECT graph_idx, 'parent_retrieval', entity, array_to_string(parents, ' and ') FROM linked WHERE len(parents) > 0
  UNION ALL SELECT graph_idx, 'child_retrieval', entity, array_to_string(children, ' and ') FROM linked WHERE len(children) > 0) a
JOIN entity_split s ON s.graph_idx = a.graph_idx AND s.entity = a.entity"""

PAIR = """
SELECT p.graph_idx, 'relationship' AS family, p.first || '->' || p.second AS query_entity, p.first, p.second,
  CASE relation WHEN 'ancestor' THEN p.first || ' is an ancestor of ' || p.second
    WHEN 'descendant' THEN p.first || ' is a descendant of ' || p.second
    ELSE p.first || ' and ' || p.second || ' are independent' END AS answer,
  CASE WHEN 'test' IN (a.split, b.split) THEN 'test' WHEN 'val' IN (a.split, b.split) THEN 'val' ELSE 'train' END AS split
FROM {pairs} p
LEFT JOIN entity_split a ON a.graph_idx = p.graph_idx AND a.entity = p.first
LEFT JOIN entity_split b ON b.graph_idx = p.graph_idx AND b.entity = p.second"""

CTES["single"] = SINGLE
CTES["paired"] = PAIR.format(pairs="pairs")
CTES["c_pairs"] = """
SELECT p.* FROM pairs p JOIN nodes a ON a.graph_idx = p.graph_idx AND a.entity = p.first
JOIN nodes b ON b.graph_idx = p.graph_idx AND b.entity = p.second WHERE a.component_id = b.component_id"""
CTES["c_paired"] = PAIR.format(pairs="c_pairs")


def explanation_sql(source: str, limit: int) -> str:
    return f"""
SELECT concat_ws('|', 'e', graph_idx, x.family, query_entity, template_idx) AS row_key, x.*,
  replace(replace(replace(template, '{{E}}', first), '{{P1}}', first), '{{P2}}', coalesce(second, '')) AS prompt
FROM ({source}) x JOIN wordings w ON w.family = x.family AND w.template_idx < {limit}"""


CTES["explanations"] = explanation_sql("SELECT * FROM single UNION ALL SELECT * FROM paired", 10)
CTES["c_explanations"] = explanation_sql("SELECT * FROM single UNION ALL SELECT * FROM c_paired", 10)

EXPLANATION_ROW = """
SELECT answer, '\\boxed{' || answer || '}' AS completion, family AS explanation_type, graph_idx,
  'rule_explanation' AS inference_types, 'explanation' AS kind, '' AS observed_entities, '' AS observed_values,
  'rule_explanation' AS primary_inference_type, prompt, query_entity, split, row_key"""
CTES["explanation_rows"] = EXPLANATION_ROW + " FROM explanations"

CTES["instructions"] = f"""
SELECT a.conv_id, a.turn, a.text AS instruction,
  CASE WHEN {chance(0.5, draw('says', 'a.conv_id', 'a.turn'))}
    THEN b.text || ' The answer is ' || a.turn::VARCHAR || '.' ELSE b.text END AS output
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'"""

MARK = "'The answer is '"
CTES["boxed_outputs"] = f"""
SELECT conv_id, turn, instruction, CASE WHEN contains(output, {MARK}) THEN
    left(output, length(output) - length(last_part)) || '\\boxed{{' || trim(last_part, '.') || '}}.'
  ELSE output END AS answer
FROM (SELECT *, string_split(output, {MARK})[-1] AS last_part FROM instructions)"""

CTES["instruction_rows"] = f"""
SELECT answer, answer AS completion, NULL::VARCHAR AS explanation_type, -1::BIGINT AS graph_idx,
  'instruct' AS inference_types, 'instruction' AS kind, '' AS observed_entities, '' AS observed_values,
  'instruct' AS primary_inference_type, instruction || {quoted(SUFFIX)} AS prompt,
  'N/A' AS query_entity, 'train' AS split, concat_ws('|', 'i', conv_id, turn) AS row_key
FROM (SELECT * FROM boxed_outputs ORDER BY conv_id, turn LIMIT 2500)"""

CTES["examples"] = """
SELECT * FROM observation_rows
UNION ALL SELECT * FROM explanation_rows
UNION ALL SELECT * REPLACE (row_key || '|copy1' AS row_key) FROM explanation_rows WHERE split = 'train'
UNION ALL SELECT * FROM instruction_rows"""

LINE_KEY = """concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT,
  floor(l_extendedprice * 100 + 0.5)::BIGINT, date_diff('day', DATE '1970-01-01', l_shipdate::DATE))"""

CTES["lines"] = f"""
SELECT row_key, l_returnflag AS split, l_linestatus AS key, l_suppkey AS supplier,
  [l_linestatus] || CASE WHEN extra >= 2 THEN ['X'] ELSE [] END || CASE WHEN extra = 3 THEN ['Y'] ELSE [] END AS labels
FROM (SELECT *, {draw('label', 'row_key')} % 4 AS extra FROM (SELECT *, {LINE_KEY} AS row_key FROM lineitem))"""

CTES["samples"] = f"""
SELECT o.o_orderkey AS example_id, o.o_orderstatus AS answer, o.o_orderpriority AS primary_inference_type, row_key,
  CASE form WHEN 0 THEN 'I think it is ' || l_linestatus
    WHEN 1 THEN 'First \\boxed{{Z}}, no: \\boxed{{' || l_linestatus || '}}.'
    WHEN 2 THEN 'So \\boxed{{  ' || l_linestatus || ' }}'
    WHEN 3 THEN 'So \\boxed{{\\text{{' || l_linestatus || '}}}}'
    ELSE 'The answer is \\boxed{{' || l_linestatus || '}}.' END AS generated_text
FROM (SELECT *, {draw('form', 'row_key')} % 10 AS form FROM (SELECT *, {LINE_KEY} AS row_key FROM lineitem)) l
JOIN orders o ON o.o_orderkey = l.l_orderkey"""

CTES["scored"] = f"""
SELECT *, CASE WHEN prediction IS NOT NULL AND trim(prediction) = answer THEN 1 ELSE 0 END AS right_one
FROM (SELECT *, regexp_extract_all(generated_text, {quoted(BOX)}, 1, 's')[-1] AS prediction FROM samples)"""

CTES["scores"] = """
SELECT example_id, primary_inference_type, count(*) AS samples, sum(right_one)::BIGINT AS correct,
  sum(right_one) / count(*) AS accuracy FROM scored GROUP BY ALL"""

PASS = """CASE WHEN samples - correct < k THEN 1.0
  ELSE 1 - coalesce(list_product(list_transform(generate_series(samples - correct + 1, samples), lambda i: 1 - k / i)), 1.0) END"""
CTES["passes"] = f"""
SELECT k, avg({PASS}) AS pass_at_k FROM scores CROSS JOIN (SELECT unnest(generate_series(1, {MAX_K})) AS k) GROUP BY k"""

CTES["truths"] = """
SELECT split, CASE WHEN contains(answer, ' is an ancestor of ') THEN 'ancestor'
  WHEN contains(answer, ' is a descendant of ') THEN 'descendant'
  WHEN contains(answer, ' are independent') THEN 'independent' ELSE 'unknown' END AS label
FROM examples WHERE kind = 'explanation' AND explanation_type = 'relationship'"""

CTES["types_seen"] = """
SELECT split, unnest(string_split(inference_types, '|')) AS inference_type FROM examples WHERE kind = 'observation'"""

CTES["probabilities"] = """
SELECT graph_idx, query_entity, observed, vals, answer, value_count, condition_count,
  value_count / condition_count AS probability
FROM (SELECT graph_idx, query_entity, observed, vals, answer, count(*) AS value_count,
        (sum(count(*)) OVER (PARTITION BY graph_idx, query_entity, observed, vals))::BIGINT AS condition_count
      FROM {observed} GROUP BY graph_idx, query_entity, observed, vals, answer)"""
CTES["c_probabilities"] = CTES["probabilities"].format(observed="c_observed")
CTES["probabilities"] = CTES["probabilities"].format(observed="observed")

CTES["bin_capped"] = f"""
SELECT graph_idx, component_id, row_key, answer, types FROM (
  SELECT o.graph_idx, o.component_id, o.row_key, o.answer, o.types, row_number() OVER (
    PARTITION BY o.graph_idx, o.component_id, least(floor(p.probability * 10), 9)
    ORDER BY {draw('cap_bin', 'o.row_key')}, o.row_key) AS r
  FROM c_observations o JOIN c_probabilities p ON p.graph_idx = o.graph_idx AND p.query_entity = o.query_entity
    AND p.observed = o.observed AND p.vals = o.vals AND p.answer = o.answer) WHERE r <= {BIN_CAP}"""


def greedy(name: str, source: str, cap: int, rounds: int) -> None:
    """Clauses that keep rows (split, labels, d, k) while all their labels are below the cap."""
    CTES[f"{name}_live0"] = f"SELECT split, labels, d, k FROM {source}"
    CTES[f"{name}_full0"] = "SELECT NULL::VARCHAR AS split, NULL::VARCHAR AS label, NULL::BIGINT AS d, NULL::VARCHAR AS k WHERE false"
    for i in range(1, rounds + 1):
        CTES[f"{name}_full{i}"] = f"""
SELECT split, label, d, k FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY d, k) AS first_one FROM (
    SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY d, k) AS r FROM (
      SELECT split, unnest(labels) AS label, d, k FROM {name}_live{i - 1})
    WHERE (split, label) NOT IN (SELECT (split, label) FROM {name}_done{i - 1})) WHERE r = {cap}) WHERE first_one = 1"""
        CTES[f"{name}_done{i - 1}"] = " UNION ALL ".join(
            f"SELECT split, label FROM {name}_full{j}" for j in range(i)
        )
        CTES[f"{name}_live{i}"] = f"""
SELECT v.* FROM {name}_live{i - 1} v LEFT JOIN {name}_full{i} f ON f.split = v.split
WHERE f.split IS NULL OR NOT (list_contains(v.labels, f.label) AND (v.d > f.d OR (v.d = f.d AND v.k > f.k)))"""
    CTES[f"{name}_kept"] = f"SELECT * FROM {name}_live{rounds}"


CTES["line_draws"] = f"SELECT split, labels, {draw('cap_labels', 'row_key')} AS d, row_key AS k FROM lines"
greedy("label", "line_draws", LABEL_CAP, 4)
CTES["bin_draws"] = f"SELECT 'train' AS split, types AS labels, {draw('cap_labels', 'row_key')} AS d, row_key AS k FROM bin_capped"
greedy("bin", "bin_draws", 1200, 3)

FLAT = """answer, completion, explanation_type, graph_idx, inference_types, kind, observed_entities,
  observed_values, primary_inference_type, prompt, query_entity, split"""

TOKENS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


def chat(system: bool, reply: bool, opened: bool) -> str:
    parts = []
    if system:
        parts.append("CASE WHEN coalesce(s.text, '') = '' THEN '' ELSE '<|im_start|>system' || chr(10) || s.text || '<|im_end|>' || chr(10) END")
    parts.append("'<|im_start|>user' || chr(10) || i.instruction || '<|im_end|>' || chr(10)")
    if reply:
        parts.append("'<|im_start|>assistant' || chr(10) || i.output || '<|im_end|>' || chr(10)")
    if opened:
        parts.append("'<|im_start|>assistant' || chr(10)")
    return " || ".join(parts)


CTES["chats"] = f"""
SELECT i.conv_id, i.turn, {chat(True, False, True)} AS prompt, {chat(True, True, False)} AS full_text
FROM instructions i LEFT JOIN conversations s ON s.conv_id = i.conv_id AND s.role = 'system' AND s.turn = 0"""

CTES["strided"] = """
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM instructions)
WHERE n <= 2000 OR (i % greatest(1, n // 2000) = 0 AND i // greatest(1, n // 2000) < 2000)"""

CTES["wordy"] = f"""
SELECT row_key, CASE form WHEN 0 THEN 'Option (' || split || ').' WHEN 1 THEN '(' || split || ')'
  WHEN 2 THEN '  YES. )' WHEN 3 THEN 'S' || supplier || '  and' || chr(9) || key || ' are independent.'
  WHEN 4 THEN 'There is no relation between ' || key || ' and S' || supplier || ' .'
  WHEN 5 THEN 'S' || supplier || ' is an ancestor of ' || key
  WHEN 6 THEN key || chr(10) || ' and ' || key || ' Are Independent' ELSE 'no' || key END AS answer
FROM (SELECT *, {draw('wording', 'row_key')} % 8 AS form FROM lines)"""


def unordered(form: str) -> str:
    one, two = (f"regexp_extract(bare, {quoted(form)}, {i})" for i in (1, 2))
    return f"least({one}, {two}) || ' and ' || greatest({one}, {two}) || ' are independent'"


QUERIES: dict[str, str] = {}

CTES["branded"] = f"""
SELECT n.graph_idx, n.entity, n.ord, p.p_brand FROM parts n JOIN part p ON n.entity = {entity('p.p_partkey')}"""
QUERIES["candidate_edges"] = """
SELECT a.graph_idx, a.entity AS parent, b.entity AS child FROM branded a
JOIN branded b ON a.graph_idx = b.graph_idx AND a.p_brand = b.p_brand AND a.ord < b.ord"""
QUERIES["bernoulli_rows"] = f"SELECT row_key FROM lines WHERE {chance(0.25, draw('keep', 'row_key'))}"
QUERIES["root_nodes"] = "SELECT graph_idx, entity FROM parts WHERE entity NOT IN (SELECT child FROM edges)"
QUERIES["assign_rules"] = "SELECT graph_idx, entity, rule FROM nodes"
QUERIES["adjacency"] = """
SELECT graph_idx, entity, array_to_string(parents, '|') AS parents, array_to_string(children, '|') AS children FROM linked"""
QUERIES["reachability"] = "SELECT graph_idx, ancestor, descendant FROM closure"
QUERIES["ancestor_counts"] = """
SELECT p.graph_idx, p.entity, count(c.ancestor) AS ancestors FROM parts p
LEFT JOIN closure c ON c.graph_idx = p.graph_idx AND c.descendant = p.entity GROUP BY ALL"""
QUERIES["descendant_counts"] = """
SELECT p.graph_idx, p.entity, count(c.descendant) AS descendants FROM parts p
LEFT JOIN closure c ON c.graph_idx = p.graph_idx AND c.ancestor = p.entity GROUP BY ALL"""
QUERIES["pair_relations"] = "SELECT graph_idx, first, second, relation FROM pairs"
QUERIES["weak_components"] = "SELECT graph_idx, entity, component_root, component_id FROM components"
QUERIES["node_levels"] = "SELECT graph_idx, entity, depth FROM levels"
QUERIES["level_widths"] = """
SELECT graph_idx, depth, width, max(width) OVER (PARTITION BY graph_idx) AS widest
FROM (SELECT graph_idx, depth, count(*) AS width FROM levels GROUP BY ALL)"""
QUERIES["root_facts"] = """
SELECT graph_idx, entity, world_id, value FROM given"""
QUERIES["rule_propagation"] = "SELECT graph_idx, entity, world_id, value FROM facts"
QUERIES["unresolved_nodes"] = """
SELECT DISTINCT graph_idx, child AS entity FROM edges WHERE parent IN (SELECT child FROM edges)"""
QUERIES["split_exact"] = ("sizes", sizes_sql("SELECT count(*) AS n FROM part GROUP BY p_type", 0.15, 0.25),
    split_sql("(SELECT p_type, p_partkey FROM part)", ["p_type"], ["p_partkey"], 0.15, 0.25, "p_type, p_partkey"))
QUERIES["split_by_graph"] = ("sizes", sizes_sql("SELECT count(DISTINCT graph_idx) AS n FROM parts", 0.1, 0.1),
    "SELECT p.graph_idx, p.entity, g.split FROM parts p JOIN ("
    + split_sql("(SELECT DISTINCT graph_idx FROM parts)", [], ["graph_idx"], 0.1, 0.1, "graph_idx")
    + ") g ON g.graph_idx = p.graph_idx")
QUERIES["split_by_node"] = "SELECT graph_idx, entity, split FROM entity_split"
QUERIES["explanation_split"] = "SELECT graph_idx, first, second, split FROM paired"
QUERIES["entity_split_counts"] = """
SELECT count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM entity_split"""
QUERIES["observation_specs"] = """
SELECT graph_idx, query_entity, obs_size, array_to_string(observed, '|') AS observed_entities, spec_ord FROM specs"""
QUERIES["component_specs"] = """
SELECT graph_idx, component_id, query_entity, obs_size, array_to_string(observed, '|') AS observed_entities, spec_ord FROM c_specs"""
QUERIES["inference_types"] = """
SELECT graph_idx, spec_ord, array_to_string(types, '|') AS inference_types, types[1] AS primary_inference_type FROM labels"""
QUERIES["sample_per_world"] = "SELECT graph_idx, world_id, spec_ord FROM sampled"
QUERIES["observation_prompts"] = "SELECT row_key, prompt FROM observation_rows"
QUERIES["observation_examples"] = f"SELECT {FLAT} FROM observation_rows"
QUERIES["conditional_probability"] = """
SELECT graph_idx, query_entity, array_to_string(observed, '|') AS observed_entities,
  array_to_string(vals, '|') AS observed_values, answer, value_count, condition_count, round(probability, 9) AS probability
FROM probabilities"""
QUERIES["probability_bins"] = """
SELECT o.graph_idx, o.world_id, o.spec_ord, (least(floor(probability * 10), 9)::BIGINT)::VARCHAR AS probability_bin
FROM observed o JOIN probabilities p ON p.graph_idx = o.graph_idx AND p.query_entity = o.query_entity
  AND p.observed = o.observed AND p.vals = o.vals AND p.answer = o.answer"""
for family, source, limit in (
    ("rule", "single", 10), ("parent_retrieval", "single", 10), ("child_retrieval", "single", 10), ("relationship", "paired", 10),
):
    name = {"rule": "rule_explanations", "relationship": "relationship_explanations"}.get(family, family)
    rows = explanation_sql(f"SELECT * FROM {source} WHERE family = '{family}'", limit)
    QUERIES[name] = f"SELECT {FLAT} FROM ({EXPLANATION_ROW} FROM ({rows}))"
QUERIES["explanation_prompts"] = "SELECT row_key, prompt FROM explanations"
QUERIES["explanation_copies"] = """
SELECT row_key, split, family AS explanation_type FROM explanations
UNION ALL SELECT row_key || '|copy' || c, split, family FROM explanations, (SELECT unnest([1, 2]) AS c) WHERE split = 'train'"""
QUERIES["instruction_first_n"] = "SELECT * FROM instructions ORDER BY conv_id, turn LIMIT 100"
QUERIES["instruction_boxing"] = "SELECT conv_id, turn, answer FROM boxed_outputs"
QUERIES["instruction_examples"] = f"SELECT {FLAT} FROM instruction_rows"
QUERIES["cap_by_key"] = f"""
SELECT split, key, row_key FROM (SELECT *, row_number() OVER (
  PARTITION BY split, key ORDER BY {draw('cap_key', 'row_key')}, row_key) AS r FROM lines) WHERE r <= {KEY_CAP}"""
QUERIES["cap_multilabel"] = """
SELECT split, array_to_string(labels, '|') AS inference_types, k AS row_key FROM label_kept"""
QUERIES["cap_component_bin"] = "SELECT graph_idx, component_id, row_key, answer FROM bin_capped"
QUERIES["cap_pipeline"] = f"""
SELECT 'train' AS split, 'observation' AS kind, b.row_key, b.answer FROM bin_capped b JOIN bin_kept k ON k.k = b.row_key
UNION ALL
SELECT split, 'explanation', row_key, answer FROM (SELECT *, row_number() OVER (
  PARTITION BY split, family ORDER BY {draw('cap_key', 'row_key')}, row_key) AS r FROM c_explanations) WHERE r <= 2000"""
QUERIES["full_dataset"] = f"SELECT {FLAT} FROM examples"
QUERIES["scan_examples"] = f"SELECT {FLAT} FROM examples"
QUERIES["jsonl_roundtrip"] = """
SELECT split, kind, count(*) AS n, sum(length(prompt))::BIGINT AS prompt_chars, sum(length(completion))::BIGINT AS completion_chars,
  sum(CASE WHEN observed_entities = '' THEN 0 ELSE len(string_split(observed_entities, '|')) END)::BIGINT AS observed,
  count(explanation_type) AS typed, min(prompt) AS first_prompt, max(prompt) AS last_prompt
FROM examples GROUP BY split, kind"""
QUERIES["metadata_summary"] = """
SELECT 'split_counts' AS name, split AS key, count(*)::VARCHAR AS value FROM examples GROUP BY split
UNION ALL SELECT 'kind_counts', kind, count(*)::VARCHAR FROM examples GROUP BY kind
UNION ALL SELECT 'explanation_split_by_entity', split, count(*)::VARCHAR FROM entity_split GROUP BY split
UNION ALL SELECT 'parameter', 'num_worlds', count(*)::VARCHAR FROM worlds
UNION ALL SELECT 'parameter', 'num_graphs', count(DISTINCT graph_idx)::VARCHAR FROM nodes
UNION ALL SELECT 'parameter', 'num_entities', max(n)::VARCHAR FROM (SELECT count(*) AS n FROM nodes GROUP BY graph_idx)
UNION ALL SELECT 'parameter', * FROM (VALUES ('edge_prob', NULL), ('node_or_prob', '0.6'), ('sample_ratio_from_worlds', '0.002'),
  ('root_prior', NULL), ('max_obs_size', '2'), ('max_observations', NULL),
  ('max_observations_unit', 'per split and inference_type'), ('max_observations_per_component_probability_bin', NULL),
  ('max_observations_per_component_probability_bin_unit', 'per train graph_idx, query component_idx, observed_probability_bin'),
  ('max_explanations', NULL), ('max_explanations_unit', 'per split and explanation_type before train copies'),
  ('num_copies_explanations', '1'), ('add_instruction_datapoints', '2500'), ('heldout_scope', 'nodes'), ('per_component_data', 'false'))"""
QUERIES["split_kind_counts"] = """
SELECT split, count(*) AS total, count(*) FILTER (WHERE kind = 'observation') AS observation,
  count(*) FILTER (WHERE kind = 'explanation') AS explanation, count(*) FILTER (WHERE kind = 'instruction') AS instruction FROM examples GROUP BY split"""
QUERIES["observation_type_counts"] = "SELECT split, inference_type, count(*) AS n FROM types_seen GROUP BY ALL"
QUERIES["explanation_type_counts"] = """
SELECT split, explanation_type, count(*) AS n FROM examples WHERE kind = 'explanation' GROUP BY ALL"""
QUERIES["relationship_truth_counts"] = "SELECT label, count(*) AS n FROM truths GROUP BY label"
QUERIES["truth_counts_grouping_sets"] = """
SELECT split, label, count(*) AS n FROM truths GROUP BY ALL
UNION ALL SELECT 'all', label, count(*) FROM truths GROUP BY label"""
QUERIES["type_distribution_rollup"] = """
SELECT split, primary_inference_type, NULL::VARCHAR AS explanation_type, count(*) AS n FROM examples GROUP BY ALL
UNION ALL SELECT split, primary_inference_type, coalesce(explanation_type, 'unknown'), count(*) FROM examples
WHERE primary_inference_type = 'rule_explanation' GROUP BY ALL"""
QUERIES["distinct_types"] = "SELECT DISTINCT explanation_type FROM examples WHERE kind = 'explanation'"
QUERIES["count_rendering"] = """
SELECT s.split, coalesce(o.t, 'none') AS observation_types, coalesce(e.t, 'none') AS explanation_types,
  coalesce(r.t, 'none') AS relationship_truths
FROM (SELECT unnest(['train', 'val', 'test']) AS split) s
LEFT JOIN (SELECT split, string_agg(inference_type || '=' || n, ', ' ORDER BY inference_type) AS t FROM (
  SELECT split, inference_type, count(*) AS n FROM types_seen GROUP BY ALL) GROUP BY split) o ON o.split = s.split
LEFT JOIN (SELECT split, string_agg(explanation_type || '=' || n, ', ' ORDER BY explanation_type) AS t FROM (
  SELECT split, explanation_type, count(*) AS n FROM examples WHERE kind = 'explanation' GROUP BY ALL) GROUP BY split) e ON e.split = s.split
LEFT JOIN (SELECT split, string_agg(label || '=' || n, ', ' ORDER BY label) AS t FROM (
  SELECT split, label, count(*) AS n FROM truths GROUP BY ALL) GROUP BY split) r ON r.split = s.split"""
QUERIES["first_example_per_type"] = """
SELECT s.split, s.kind, s.type, f.row_key, f.prompt, f.completion FROM (
  SELECT unnest(['train', 'val', 'test']) AS split, kind, type FROM (
    SELECT 'observation' AS kind, unnest(['ancestor', 'descendant', 'independent']) AS type
    UNION ALL SELECT DISTINCT 'explanation', explanation_type FROM examples WHERE kind = 'explanation')) s
LEFT JOIN (
  SELECT split, kind, type, min(row_key) AS row_key, arg_min(prompt, row_key) AS prompt, arg_min(completion, row_key) AS completion
  FROM (SELECT split, kind, row_key, prompt, completion,
          unnest(CASE WHEN kind = 'observation' THEN string_split(inference_types, '|') ELSE [explanation_type] END) AS type
        FROM examples WHERE kind <> 'instruction') GROUP BY ALL) f
  ON f.split = s.split AND f.kind = s.kind AND f.type = s.type
UNION ALL
SELECT split, kind, kind, min(row_key), arg_min(prompt, row_key), arg_min(completion, row_key)
FROM examples WHERE kind = 'instruction' GROUP BY split, kind"""
QUERIES["split_preview"] = """
SELECT split, count(*) AS n, arg_min(prompt, row_key) AS prompt, arg_min(completion, row_key) AS completion,
  arg_min(answer, row_key) AS answer FROM examples GROUP BY split"""
QUERIES["eval_split_fanout"] = """
SELECT 'validation' AS eval_split, row_key, explanation_type FROM examples WHERE split = 'val'
UNION ALL SELECT 'validation_rule_explanation_type_' || explanation_type, row_key, explanation_type FROM examples
WHERE split = 'val' AND primary_inference_type = 'rule_explanation'"""
QUERIES["example_index"] = """
SELECT split, row_key, row_number() OVER (PARTITION BY split ORDER BY row_key) - 1 AS example_id FROM lines"""
QUERIES["seeded_shuffle"] = f"""
SELECT row_key, row_number() OVER (ORDER BY {draw('shuffle', 'row_key')}, row_key) - 1 AS position FROM lines"""
QUERIES["stride_sample"] = """
SELECT row_key FROM (SELECT row_key, row_number() OVER (ORDER BY row_key) - 1 AS i, count(*) OVER () AS n FROM lines)
WHERE n <= 2000 OR (i % greatest(1, n // 2000) = 0 AND i // greatest(1, n // 2000) < 2000)"""
QUERIES["natural_order"] = """
SELECT name, row_number() OVER (ORDER BY CASE WHEN num = '' THEN 1 ELSE 0 END, try_cast(num AS BIGINT), name) - 1 AS position
FROM (SELECT name, regexp_extract(name, 'Customer-(\\d+)$', 1) AS num FROM (
  SELECT CASE WHEN c_nationkey % 5 = 0 THEN c_name || '-old' ELSE regexp_replace(c_name, '#0+', '-') END AS name FROM customer))"""
QUERIES["entity_names"] = """
SELECT p_partkey, chr((65 + (p_partkey % 676) // 26)::INT) || chr((65 + (p_partkey % 676) % 26)::INT) AS name FROM part"""
QUERIES["boxed_wrap"] = "SELECT o_orderkey, '\\boxed{' || o_orderstatus || '}' AS completion FROM orders"
QUERIES["metric_slug"] = """
SELECT p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_brand || ' (new)'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part"""
QUERIES["chat_render"] = "SELECT conv_id, turn, prompt, full_text FROM chats"
QUERIES["chat_completion_suffix"] = """
SELECT conv_id, turn, substr(full_text, length(prompt) + 1) AS completion FROM chats"""
QUERIES["length_stats"] = f"""
SELECT part, count(*) AS n, min(x) AS min_len, round(avg(x), 6) AS avg_len, list(x ORDER BY x)[count(*) // 2 + 1] AS p50_len,
  CASE WHEN floor(count(*) * 0.95::DOUBLE) < 1 THEN max(x) ELSE list(x ORDER BY x)[floor(count(*) * 0.95::DOUBLE)::BIGINT] END AS p95_len,
  max(x) AS max_len
FROM (SELECT unnest(['prompt', 'completion', 'total']) AS part, unnest([p, c, p + c]) AS x FROM (
  SELECT {TOKENS.format('instruction')} AS p, {TOKENS.format('output')} AS c FROM instructions)) GROUP BY part"""
QUERIES["batch_prompt_lengths"] = f"""
SELECT i // 32 AS batch, count(*) AS n, min(x) AS min_len, max(x) AS max_len, round(avg(x), 6) AS mean_len
FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, {TOKENS.format('instruction')} AS x FROM instructions) GROUP BY ALL"""
QUERIES["prompt_overflow"] = f"""
SELECT conv_id, turn, {TOKENS.format('instruction')} AS prompt_len FROM instructions WHERE prompt_len > 20"""
QUERIES["columns_to_rows"] = """
SELECT example_id, row_number() OVER (PARTITION BY example_id ORDER BY row_key) - 1 AS sample_idx, generated_text FROM samples"""
QUERIES["boxed_extract_last"] = "SELECT row_key, prediction FROM scored"
QUERIES["canonicalize_answers"] = f"""
SELECT row_key, CASE WHEN regexp_matches(low, {quoted(OPTION)}) THEN regexp_extract(low, {quoted(OPTION)}, 1)
  WHEN bare IN ('yes', 'no') THEN bare
  WHEN regexp_matches(bare, {quoted(INDEPENDENT)}) THEN {unordered(INDEPENDENT)}
  WHEN regexp_matches(bare, {quoted(NO_RELATION)}) THEN {unordered(NO_RELATION)} ELSE norm END AS canonical
FROM (SELECT *, lower(norm) AS low, rtrim(lower(norm), '. )') AS bare FROM (
  SELECT row_key, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS norm FROM wordy))"""
QUERIES["example_accuracy"] = """
SELECT example_id, primary_inference_type, samples, correct, round(accuracy, 9) AS accuracy FROM scores"""
QUERIES["pass_at_k"] = "SELECT k, round(pass_at_k, 9) AS pass_at_k FROM passes"
QUERIES["accuracy_by_type"] = """
SELECT primary_inference_type, count(*) AS examples, round(avg(accuracy), 9) AS accuracy FROM scores GROUP BY ALL"""
QUERIES["scorecard"] = """
SELECT 'accuracy' AS metric, round(avg(accuracy), 9) AS value FROM scores
UNION ALL SELECT 'pass_at_' || k, round(pass_at_k, 9) FROM passes
UNION ALL SELECT 'acc_' || primary_inference_type, round(avg(accuracy), 9) FROM scores GROUP BY primary_inference_type"""
QUERIES["prediction_report"] = f"""
SELECT example_id, 'Status of order ' || example_id || '?' AS prompt, answer, answer AS canonical_answer, primary_inference_type,
  primary_inference_type || '|' || answer AS inference_types, CASE WHEN answer = 'F' THEN 'rule' END AS explanation_type,
  'C' || o_custkey AS query_entity, round(correct / samples, 9) AS accuracy,
  round(p[1], 9) AS pass_at_1, round(p[2], 9) AS pass_at_2, round(p[3], 9) AS pass_at_3,
  predictions, canonicalized_predictions, texts
FROM (SELECT *, list_transform([1, 2, 3], lambda k: {PASS}) AS p FROM (
  SELECT example_id, answer, primary_inference_type, count(*) AS samples, sum(right_one)::BIGINT AS correct,
    string_agg(coalesce(prediction, 'none'), '|' ORDER BY row_key) AS predictions,
    string_agg(coalesce(trim(prediction), 'none'), '|' ORDER BY row_key) AS canonicalized_predictions,
    string_agg(generated_text, '|' ORDER BY row_key) AS texts
  FROM scored GROUP BY example_id, answer, primary_inference_type)) JOIN orders ON o_orderkey = example_id"""
QUERIES["prediction_results"] = f"""
SELECT example_id, 'Status of order ' || example_id || '?' AS prompt, 'C' || o_custkey AS query_entity,
  primary_inference_type || '|' || answer AS inference_types, round(correct / samples, 9) AS accuracy,
  round(p[1], 9) AS pass_at_1, round(p[2], 9) AS pass_at_2, round(p[3], 9) AS pass_at_3, predictions, texts, distinct_predictions,
  CASE WHEN correct > 0 THEN round(correct / samples, 9) END AS low,
  CASE WHEN correct < samples THEN round(correct / samples, 9) END AS high,
  CASE WHEN correct < samples THEN round(correct / samples, 9) END AS by_7
FROM (SELECT *, list_transform([1, 2, 3], lambda k: {PASS}) AS p FROM (
  SELECT example_id, answer, primary_inference_type, count(*) AS samples, sum(right_one)::BIGINT AS correct,
    string_agg(coalesce(prediction, 'none'), '|' ORDER BY row_key) AS predictions,
    coalesce(string_agg(DISTINCT prediction, '|' ORDER BY prediction), '') AS distinct_predictions,
    string_agg(generated_text, '|' ORDER BY row_key) AS texts
  FROM scored GROUP BY example_id, answer, primary_inference_type)) JOIN orders ON o_orderkey = example_id"""
SIDE = "SELECT example_id, count(*) AS n, sum(right_one)::BIGINT AS c FROM scored WHERE {0} GROUP BY example_id"
FIRST = chance(0.5, draw("model", "row_key"))
QUERIES["model_compare"] = f"""
SELECT coalesce(a.example_id, b.example_id) AS example_id, a.n AS samples_a, a.c AS correct_a, b.n AS samples_b, b.c AS correct_b
FROM ({SIDE.format(FIRST)}) a FULL JOIN ({SIDE.format('NOT ' + FIRST)}) b ON a.example_id = b.example_id"""
QUERIES["eval_subset"] = f"""
SELECT o_orderkey AS example_id, o_orderstatus AS answer FROM orders ORDER BY {draw('eval', 'o_orderkey')}, o_orderkey LIMIT 1000"""
QUERIES["json_safe_metrics"] = f"""
SELECT {LINE_KEY} AS row_key,
  CASE WHEN l_discount = 0 OR l_tax = 0 OR l_tax = 0.01 THEN NULL ELSE l_quantity END AS value FROM lineitem"""


def _used(name: str, body: str, own: dict[str, str]) -> set[str]:
    words = set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", body))
    return {c for c in words if (c in CTES or c in own) and c != name}


def assemble(body: str, own: dict[str, str]) -> str:
    """The statement with exactly the clauses it needs, in order of need."""
    ordered: list[str] = []

    def visit(name):
        if name in ordered:
            return
        clause = own.get(name, CTES.get(name))
        for other in sorted(_used(name, clause, own)):
            visit(other)
        ordered.append(name)

    for name in sorted(_used("", body, own)):
        visit(name)
    if not ordered:
        return body.strip()
    clauses = ",\n".join(f"{n} AS ({own.get(n, CTES.get(n))})" for n in ordered)
    return f"WITH RECURSIVE {clauses}\n{body.strip()}"


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in QUERIES.items():
        if isinstance(body, tuple):
            clause, text, body = body
            out[name] = assemble(body, {clause: text})
        else:
            out[name] = assemble(body, {})
    return out
