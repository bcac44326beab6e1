"""SQL for the corpus queries that plain SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op10_url_rules"] = r"""
WITH cut AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
    lower(regexp_extract(rest, '^[^/?#]*')) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule_host, rule_path, rule, rule_verdict) AS (VALUES
  ('org', '/', 'org/', 'allow'),
  ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'),
  ('com', '/fr/', 'com/fr/', 'allow'),
  ('com', '/de/', 'com/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule,
    arg_max(rule_verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
    AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

ORACLE["op3_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES
    (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(length('<|turn|><|text|><|end|>') + length(role) + length(text)
      + length(role || text) - length(replace(role || text, '\', ''))
      + (length(role) - length(replace(role, '<|', ''))) // 2
      + (length(text) - length(replace(text, '<|', ''))) // 2) AS BIGINT) AS formatted_chars,
    string_agg(role, ',' ORDER BY turn) AS roles
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars,
  regexp_matches(roles, '^(system(,|$))?(user(,assistant,user)*(,assistant)?)?$') AS valid
FROM joined
"""


def crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(range(8), lambda x, i: {step}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(unicode(s) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, 4294967295), 4294967295)"


ORACLE["op11_exact_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scored QUALIFY rank <= 10
"""

ORACLE["op12_prefix_trie"] = rf"""
WITH RECURSIVE said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations),
ids AS (
  SELECT DISTINCT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM conversations),
built AS (
  SELECT ids.conv_id, said.pos, said.said FROM ids JOIN said
    ON said.conv_id = ids.conv_id - ids.conv_id % 100 AND said.pos <= h
  UNION ALL
  SELECT ids.conv_id, said.pos, said.said FROM ids JOIN said
    ON said.conv_id = ids.conv_id AND said.pos > h),
turns AS (
  SELECT conv_id, said, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM built),
whole AS (
  SELECT ids.conv_id, coalesce(list(said ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS turns
  FROM ids LEFT JOIN turns USING (conv_id) GROUP BY ids.conv_id),
members AS (
  SELECT conv_id, d AS depth, sha256(CAST(turns[1:d] AS VARCHAR)) AS prefix,
    CASE WHEN d > 0 THEN sha256(CAST(turns[1:d - 1] AS VARCHAR)) END AS above,
    CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS size, d = len(turns) AS ends
  FROM whole, unnest(range(len(turns) + 1)) AS t(d)),
nodes AS (
  SELECT depth, prefix, above, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY depth, prefix, above),
children AS (SELECT above AS prefix, depth - 1 AS depth, count(*) AS n_children FROM nodes GROUP BY ALL),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children
  FROM nodes LEFT JOIN children USING (prefix, depth)),
up AS (
  SELECT prefix, depth, above, saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM full_nodes
  UNION ALL
  SELECT n.prefix, n.depth, n.above, up.saved, up.leaf
  FROM up JOIN full_nodes AS n ON n.prefix = up.above AND n.depth = up.depth - 1),
sums AS (SELECT prefix, depth, sum(saved) AS saved, sum(leaf) AS leaves FROM up GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
  CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes AS n JOIN sums USING (prefix, depth)
LEFT JOIN full_nodes AS p ON p.prefix = n.above AND p.depth = n.depth - 1
"""

ORACLE["op13_turn_repair"] = rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS previous
  FROM faulty),
counted AS (
  SELECT conv_id, count(*) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
-- Costs to the end from the states start, system, user, assistant.
costs AS (
  SELECT conv_id, n + 1 AS pos, [0, 4, 2, 0] AS c FROM counted
  UNION ALL
  SELECT conv_id, pos, [least(r[1], 2 + least(r[3], 2 + r[4])), least(r[2], 2 + least(r[3], 2 + r[4])),
    least(r[3], 2 + r[4]), least(r[4], 2 + r[3])]
  FROM (
    SELECT j.conv_id, j.pos,
      CASE WHEN j.fault IN ('blank', 'duplicate') THEN list_transform(c, lambda x: x + 3) ELSE [
        least(3 + c[1], x + 2 + c[3], CASE initial WHEN 'u' THEN x + c[3] WHEN 's' THEN x + c[2] ELSE 999999 END),
        least(3 + c[2], x + 2 + c[3], CASE initial WHEN 'u' THEN x + c[3] ELSE 999999 END),
        least(3 + c[3], x + 2 + c[4], CASE initial WHEN 'a' THEN x + c[4] ELSE 999999 END),
        least(3 + c[4], x + 2 + c[3], CASE initial WHEN 'u' THEN x + c[3] ELSE 999999 END)] END AS r
    FROM costs JOIN (SELECT *, CAST(fault = 'truncated' AS INTEGER) AS x FROM judged) AS j
      ON j.conv_id IS NOT DISTINCT FROM costs.conv_id AND j.pos = costs.pos - 1)),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS pos, 1 AS state, '' AS audit, '' AS said FROM counted
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN pos ELSE pos + 1 END,
    CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND initial = 's' THEN 2 ELSE wanted END,
    audit || edit,
    said || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
      WHEN 'R' THEN chr(10) || made || ':' || text ELSE chr(10) || made || ':' END
  FROM (
    SELECT *, CASE WHEN has_row AND 3 + after[state] = now[state] THEN 'D'
      WHEN 2 + now[wanted] = now[state] THEN 'I'
      WHEN fits AND x + after[CASE WHEN initial = 's' THEN 2 ELSE wanted END] = now[state] THEN 'K'
      ELSE 'R' END AS edit
    FROM (
      SELECT w.*, a.c AS now, b.c AS after, j.pos IS NOT NULL AS has_row, j.role, j.text, j.initial,
        CAST(j.fault = 'truncated' AS INTEGER) AS x,
        CASE WHEN state = 3 THEN 4 ELSE 3 END AS wanted,
        CASE WHEN state = 3 THEN 'assistant' ELSE 'user' END AS made,
        coalesce(j.fault NOT IN ('blank', 'duplicate') AND (j.initial = CASE WHEN state = 3 THEN 'a' ELSE 'u' END
          OR (state = 1 AND j.initial = 's')), false) AS fits
      FROM walk AS w
      JOIN costs AS a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.pos = w.pos
      LEFT JOIN costs AS b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.pos = w.pos + 1
      LEFT JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos
      WHERE NOT (b.pos IS NULL AND a.c[state] = 0)))),
done AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(said, length(audit)) AS said FROM walk GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(costs.c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN costs ON costs.conv_id IS NOT DISTINCT FROM ids.conv_id AND costs.pos = 1
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
