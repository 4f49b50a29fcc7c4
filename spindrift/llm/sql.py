"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

from spindrift.llm import licenses, mixing, quality, repair, trie

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Targets by the level at which capped sources leave the shares; documents in the order of the seeded hash.
MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, sum(size) AS total, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * total AS cap, row_number() OVER o AS k, coalesce(sum(3.0::DOUBLE * total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
      sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, sum(total) OVER () AS every FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * total / w, source)),
l AS (SELECT arg_min((every - full_before) / w_left, k) FILTER (cap / w >= (every - full_before) / w_left) AS level FROM c),
t AS (SELECT source, total, least(cap, level * w) AS target, CAST(floor(least(cap, level * w) + 0.5) AS BIGINT) AS quota FROM c CROSS JOIN l),
p AS (SELECT source, total, target, CASE WHEN total = 0 THEN 0 ELSE least(3, quota // total) END AS passes, quota - (CASE WHEN total = 0 THEN 0 ELSE least(3, quota // total) END) * total AS rest FROM t),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST((passes + CASE WHEN passes < 3 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source
"""


def _grams() -> str:
    return ", ".join(f"({i}, '{label}', {phrase}, {size}, {k}, {at}, '{gram}')" for i, label, phrase, size, k, at, gram in licenses.template_grams())


LICENSES = rf"""
WITH t(template, label, phrase, size, k, tpos, gram) AS (VALUES {_grams()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d),
r AS (SELECT doc_id, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM q, (VALUES ({licenses.PAIR}), ({licenses.GRAM})) AS s(k) WHERE pos + k <= len(w)),
g AS (SELECT doc_id, template, label, phrase, size, t.k, tpos, pos, pos - tpos AS diagonal FROM r JOIN t ON r.k = t.k AND r.gram = t.gram),
e AS (SELECT doc_id, label, count(*) AS votes, min(pos) AS first, size - k + 1 AS grams FROM g WHERE phrase GROUP BY doc_id, template, label, size, k, diagonal),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {licenses.DRIFT} THEN 1 ELSE 0 END AS fresh FROM g WHERE NOT phrase),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM n),
o AS (SELECT *, unnest(range(tpos, tpos + k)) AS own FROM m),
u AS (SELECT doc_id, label, size, min(pos) AS first, max(pos + k - 1) AS last, count(DISTINCT own) / size AS cover FROM o GROUP BY doc_id, template, label, size, run),
v AS (SELECT doc_id, label, TRUE AS phrase, first, 1.0::DOUBLE AS cover FROM e WHERE votes = grams UNION ALL
      SELECT doc_id, label, FALSE, first, cover FROM u WHERE cover >= (CASE WHEN size < {licenses.SHORT} THEN {licenses.COVER_SHORT} ELSE {licenses.COVER_LONG} END) AND last - first <= {licenses.STRETCH} * size),
s AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
      string_agg(DISTINCT CASE WHEN phrase THEN label END, ',' ORDER BY CASE WHEN phrase THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""

#: All pairs; the index reaches them with its recall, so tests compare larger tables by brute force.
VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""


def _broken() -> str:
    """The table of thresholds as a list of the names of broken rules."""
    out = []
    for r in quality.RULES:
        m = r.measure.replace(".", "_")
        bounds = [f"{m} < {r.low}"] * (r.low is not None) + [f"{m} > {r.high}"] * (r.high is not None)
        out.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{r.measure}' END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{quality.WORD}') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{quality.WORD}')) AS l FROM documents),
u AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
g AS (SELECT r, i, concat_ws(' ', {", ".join(f"lead(x, {k}) OVER o" for k in range(quality.WINDOW))}) AS g, lead(i, {quality.WINDOW - 1}) OVER o AS last FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE last IS NOT NULL),
p AS (SELECT DISTINCT r, unnest(range(i, i + {quality.WINDOW})) AS i FROM k WHERE n > 1),
q AS (SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r),
c AS (SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capitals, len(list_filter(w, lambda x: list_contains({quality.STOP_WORDS}, lower(x)))) AS stop_n
      FROM d LEFT JOIN q ON q.r = d.r),
m AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS chars_mean, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_share,
      CASE WHEN n_words > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / n_words ELSE 0 END AS lettered_share, CASE WHEN letters > 0 THEN capitals / letters ELSE 0 END AS capital_share,
      CASE WHEN n_words > 0 THEN stop_n / n_words ELSE 0 END AS stop_share, CASE WHEN len(l) > 0 THEN n_dup_lines / len(l) ELSE 0 END AS dup_line_share,
      CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) / len(l) ELSE 0 END AS bullet_share,
      CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) / len(l) ELSE 0 END AS ellipsis_share,
      n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM c),
b AS (SELECT *, {_broken()} AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS broken FROM b
"""


def crc32(text: str) -> str:
    """The checksum of an expression's ASCII text, bit by bit."""
    octets = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(c, x), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, x: {bits}), 4294967295)"


def _ways() -> str:
    """Turns inserted before a row: state before, state then, letters, lines."""
    out = []
    for before in repair.STATES:
        for n in range(len(repair.STATES)):
            lines, state = repair._inserted(before, n)
            out.append(f"({before}, {state}, {n * repair.INSERT}, '{'I' * n}', [{', '.join(repr(x) for x in lines)}]::VARCHAR[])")
    return ", ".join(out)


#: The four states row by row, each with its least cost and audit so far as one key.
REPAIR = rf"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, role, text, {crc32("k")} % 20 AS how FROM b),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS nth FROM h WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat_ws(':', length(role), role, text))) AS i FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM u),
w(before, mid, cost, letters, lines) AS (VALUES {_ways()}),
e(mid, op, initial, after, cost) AS (VALUES (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 3, 2), (3, 'R', NULL, 2, 2), (0, 'D', NULL, 0, 3), (1, 'D', NULL, 1, 3), (2, 'D', NULL, 2, 3), (3, 'D', NULL, 3, 3),
      (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0)),
r(conv_id, i, q, best, lines) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, '00000000', CAST([] AS VARCHAR[]) FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, q, min(best), arg_min(lines, best) FROM (
    SELECT r.conv_id, f.i, e.after AS q, printf('%08d', CAST(left(r.best, 8) AS INT) + w.cost + e.cost + CASE WHEN f.fault = 3 AND e.op <> 'D' THEN 1 ELSE 0 END) || substr(r.best, 9) || w.letters || e.op AS best,
           r.lines || w.lines || CASE e.op WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE e.after WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] ELSE CAST([] AS VARCHAR[]) END AS lines
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN w ON w.before = r.q JOIN e ON e.mid = w.mid AND (e.op = 'D' OR f.fault NOT IN (1, 2)) AND (e.initial IS NULL OR e.initial = left(f.role, 1))
  ) GROUP BY conv_id, i, q),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
      count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
t(q, tail, cost, lines) AS (VALUES (0, '', 0, CAST([] AS VARCHAR[])), (1, 'II', 4, ['user:', 'assistant:']), (2, 'I', 2, ['assistant:']), (3, '', 0, CAST([] AS VARCHAR[]))),
z AS (SELECT r.conv_id, printf('%08d', CAST(left(r.best, 8) AS INT) + t.cost) || substr(r.best, 9) || t.tail AS best, r.lines || t.lines AS lines FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.n = r.i JOIN t ON t.q = r.q),
y AS (SELECT conv_id, min(best) AS best, arg_min(lines, best) AS lines FROM z GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(left(best, 8), '0') AS BIGINT) AS cost, coalesce(substr(best, 9), '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM c.conv_id
"""


#: Every prefix as a list of its turns; each node counts at all its prefixes.
TRIE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat_ws(':', length(role), role, text))) AS i FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {trie.FAMILY} AS host, CASE WHEN conv_id IS NULL THEN 0 ELSE {crc32("CAST(conv_id AS VARCHAR)")} % {trie.BORROWED} END AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, o.i, role, text FROM c JOIN o ON o.conv_id = c.host AND o.i <= c.h UNION ALL SELECT c.conv_id, 1, o.i, role, text FROM c JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id AND o.i > c.h),
x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, {{'role': role, 'text': text}} AS turn FROM r),
p AS (SELECT conv_id, depth, list(turn) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM x UNION ALL SELECT conv_id, 0, [] FROM c),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(coalesce(CAST(conv_id AS VARCHAR), ''), ',' ORDER BY conv_id NULLS FIRST) FILTER (ends AND conv_id IS NOT NULL), '')) AS ends_sha256 FROM m GROUP BY path, depth),
k AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.path[n.depth].text, '[^\x20\x09-\x0D]+')) END AS own_saved FROM n LEFT JOIN k ON k.path = n.path),
a AS (SELECT path[1 : d] AS path, sum(own_saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM v) GROUP BY 1)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN a ON a.path = v.path LEFT JOIN v AS u ON v.depth > 0 AND u.path = v.path[1 : v.depth - 1]
"""

ORACLE_SQL = {"op12_conversation_trie": TRIE, "op11_conversation_repair": REPAIR, "op13_quality_rules": QUALITY, "op2_source_mix": MIX, "op6_license_scan": LICENSES, "op9_embedding_multi_index": VECTORS}
