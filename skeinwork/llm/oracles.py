"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from skeinwork.llm.chat import CONTROLS, END, NEXT, START, TEXT
from skeinwork.llm.quality import LineRules
from skeinwork.llm.urls import RULES

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op2(order: int = 4, strength: float = 1.0) -> str:
    ranked = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    fits = [f"(host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)})" for r in ranked]
    rule = " ".join(f"WHEN {f} THEN {_quoted(r.name)}" for f, r in zip(fits, ranked))
    ruled = " ".join(f"WHEN {f} THEN {_quoted(r.verdict)}" for f, r in zip(fits, ranked))
    p_a, p_r = f"{1 / 256!r}::DOUBLE", f"{1 / 256!r}::DOUBLE"
    joins = []
    for k in range(order + 1):
        p_a = f"((coalesce(s{k}.ca, 0) + {strength} * {p_a}) / (coalesce(c{k}.na, 0) + {strength}))"
        p_r = f"((coalesce(s{k}.cr, 0) + {strength} * {p_r}) / (coalesce(c{k}.nr, 0) + {strength}))"
        joins.append(f"LEFT JOIN suf s{k} ON s{k}.s = substr(g.gram, {order + 1 - k}, {k + 1}) LEFT JOIN ctx c{k} ON c{k}.k = {k + 1} AND c{k}.c = substr(g.gram, {order + 1 - k}, {k})")
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
n AS (SELECT host, path, count(*) AS n, CASE {rule} END AS rule, CASE {ruled} END AS ruled, left(md5(host || path), 1) < '8' AS fits FROM u GROUP BY host, path),
p AS (SELECT *, repeat(chr(2), {order}) || host || path || chr(3) AS t FROM n),
h AS (SELECT host, path, n, ruled, fits, unnest([substr(t, i, {order + 1}) for i in range(1, length(t) - {order} + 1)]) AS gram FROM p),
g AS (SELECT gram, sum(CASE WHEN ruled = 'allow' AND fits THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' AND fits THEN n ELSE 0 END) AS r FROM h GROUP BY gram),
parts AS (SELECT a, r, k, substr(gram, {order + 1} - k, k + 1) AS s, substr(gram, {order + 1} - k, k) AS c FROM g, range(0, {order + 1}) t(k) WHERE a + r > 0),
suf AS (SELECT s, sum(a)::DOUBLE AS ca, sum(r)::DOUBLE AS cr FROM parts GROUP BY s),
ctx AS (SELECT k + 1 AS k, c, sum(a)::DOUBLE AS na, sum(r)::DOUBLE AS nr FROM parts GROUP BY ALL),
ratio AS (SELECT g.gram, ln({p_a}) - ln({p_r}) AS v FROM g {' '.join(joins)}),
sc AS (SELECT host, path, any_value(ruled) AS ruled, any_value(fits) AS fits, avg(v) AS score FROM h JOIN ratio USING (gram) GROUP BY host, path),
m AS (SELECT avg(score) FILTER (ruled = 'allow') AS ma, stddev_pop(score) FILTER (ruled = 'allow') AS sa, avg(score) FILTER (ruled = 'block') AS mr, stddev_pop(score) FILTER (ruled = 'block') AS sr FROM sc WHERE NOT fits),
th AS (SELECT coalesce(CASE WHEN sa + sr > 0 THEN (ma * sr + mr * sa) / (sa + sr) ELSE (ma + mr) / 2 END, 0) AS threshold FROM m)
SELECT page_id, u.host, u.path, n.rule, coalesce(sc.ruled, CASE WHEN sc.score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM u JOIN n ON n.host = u.host AND n.path = u.path JOIN sc ON sc.host = u.host AND sc.path = u.path, th"""


def _op3() -> str:
    escaped = "replace({0}, '\\', '\\\\')"
    for c in CONTROLS:
        escaped = f"replace({escaped}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
    head, body, more, end = len(START), len(TEXT), len(NEXT), len(END) + 1
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({escaped.format('text')}) + CASE WHEN before = role THEN {more} ELSE {head} + {body} + {end} + length({escaped.format('role')}) END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def _op8(width: int = 20) -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, unnest([md5(array_to_string(w[i:i + {width - 1}], ' ')) for i in range(1, len(w) - {width - 2})]) AS h, unnest(range(1, len(w) - {width - 2})) AS i FROM d WHERE len(w) >= {width}),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(0, {width}) t(k) WHERE n > 1),
k AS (SELECT x.doc_id, count(*) AS left_, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(left_, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _op10(rules: LineRules = LineRules()) -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format('text')} AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS inside, {_WORDS.format('line')} AS w,
  length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols, length(regexp_replace(line, '[^|»›]+', '', 'g')) AS bars,
  length(regexp_replace(line, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(line, '\P{{Lu}}+', '', 'g')) AS caps FROM l),
f AS (SELECT doc_id, line, inside > 0 AS has_word, len(w) AS n,
  bars >= {rules.min_bars} OR symbols > {rules.max_symbol_share} * inside OR (letters >= {rules.min_caps_letters} AND caps > {rules.max_caps_share} * letters)
  OR (contains(line, '!!') AND len(list_filter(w, lambda x: ends_with(x, '!!'))) > {rules.max_exclaim_share} * len(w))
  OR len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > {rules.max_run_share} * len(w)
  OR {' OR '.join(f'contains(lower(line), {_quoted(b)})' for b in rules.boilerplate)} AS bad FROM m),
p AS (SELECT doc_id, coalesce(sum(n) FILTER (bad), 0) AS lost, count(*) FILTER (has_word) - count(DISTINCT line) FILTER (has_word) AS dup FROM f GROUP BY 1),
g AS (SELECT doc_id, unnest([w[i:i + 2] for i in range(1, len(w) - 1)]) AS tri, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c, range(0, 3) t(k) WHERE c.n > 1 GROUP BY 1),
o AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  dup AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, lost FROM d JOIN p USING (doc_id) LEFT JOIN v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {rules.max_lost_share} * n_words AS kept FROM o"""


def _op11(shortest: int = 7, least: int = 2, times: int = 10, every: int = 31) -> str:
    table = "SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(0, 256) u(i)"
    digest = "xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1]), 4294967295), 4294967295)"
    return rf"""
WITH RECURSIVE crc AS ({table}),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= {shortest} GROUP BY ALL),
b AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM d),
h AS (SELECT run, n, {digest} AS h FROM b, crc),
s AS (SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {least}),
v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM w, unnest(range(1, length(word) + 1)) t(i)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.v = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.v = w.word),
g AS (SELECT word, count(*) AS n_near, min((-m, near)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= {times} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {times} * n THEN -best[1] END AS form_n
  FROM w LEFT JOIN g USING (word)),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL"""


ORACLES = {"op11_spelling_variants": _op11(), "op2_url_filter": _op2(), "op3_chat_format": _op3(), "op8_substring_dedup": _op8(), "op10_quality_rules": _op10()}
