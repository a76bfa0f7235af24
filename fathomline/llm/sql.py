"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .chat import BLOCK, CLOSE, OPEN
from .common import LOWER, UPPER
from .decontaminate import WINDOW
from .licenses import TEMPLATES, THRESHOLD
from .quality import RULES, STOP_WORDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LOWER = f"'{UPPER}', '{LOWER}'"

_OP3 = rf"""
WITH rules(host, path, verdict) AS (VALUES
    ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_LOWER}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    row_number() OVER () AS rid FROM pages),
fit AS (SELECT rid, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS k
    FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.rid = fit.rid AND k = 1"""

_OP5 = f"""
WITH said AS (SELECT conv_id, turn, turn // {BLOCK} AS block, coalesce(role, 'unknown') AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS body, md5(coalesce(role, 'unknown') || chr(1) || coalesce(text, '')) AS mark
    FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
shown AS (SELECT s.*, perspective, speaker = perspective AS trained,
    dense_rank() OVER (PARTITION BY s.conv_id, perspective ORDER BY block NULLS FIRST) - 1 AS part,
    CASE WHEN speaker = 'system' THEN {_text(OPEN + 'system')} || chr(10)
         WHEN speaker = perspective THEN {_text(OPEN + 'assistant')} || chr(10)
         ELSE {_text(OPEN + 'user name=')} || translate(replace(speaker, '<|', '< |'), chr(13) || chr(10), '  ') || chr(10) END AS head
    FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (SELECT *, length(head) + length(body) + {len(CLOSE)} AS size,
    sum(length(head) + length(body) + {len(CLOSE)}) OVER w AS upto, row_number() OVER w AS place
    FROM shown WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, mark ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (WHERE trained) AS n_trained,
    min(upto - size)::BIGINT AS start, sum(size)::BIGINT AS n_chars,
    string_agg(head || body || {_text(CLOSE[:-1])} || chr(10), '' ORDER BY place) AS text,
    coalesce(string_agg((upto - size + length(head))::BIGINT || '-' || (upto - {len(CLOSE)})::BIGINT, ',' ORDER BY place)
        FILTER (WHERE trained), '') AS mask
FROM placed GROUP BY conv_id, perspective, part"""


def _rule_checks() -> str:
    checks = []
    for r in RULES:
        bad = [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
        checks.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return ", ".join(checks)


_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(regexp_extract_all(t, '!')) AS n_exclaim, len(ls) AS n_lines,
    len(list_filter(w, lambda x: list_contains([{', '.join(map(_text, STOP_WORDS))}], lower(trim(x, '.,;:!?"''()'))))) AS n_stop,
    len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS n_upper
    FROM d LEFT JOIN covered USING (rid)),
r AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
    coalesce(n_exclaim / nullif(n_words, 0), 0) AS exclaim_ratio, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_ratio,
    coalesce(n_upper / nullif(n_words, 0), 0) AS upper_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, list_filter([{_rule_checks()}], lambda x: x IS NOT NULL) AS failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM f"""

_UNITS = "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"
_OP8 = rf"""
WITH tw AS (SELECT name, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {', '.join(f"({_text(n)}, {_text(t)})" for n, _, t in TEMPLATES)}) AS v(name, t)),
tb AS (SELECT name, {_UNITS} AS b FROM tw),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT rid, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d
    UNION ALL SELECT rid, t, 0 FROM d WHERE contains(t, chr(10))),
uw AS (SELECT rid, k, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w FROM u),
ub AS (SELECT rid, k, {_UNITS} AS a FROM uw WHERE len(w) > 0),
s AS (SELECT rid, k, name, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS score FROM ub, tb
    WHERE len(a) <= len(b) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9 AND len(a) >= len(b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9),
best AS (SELECT * FROM s WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY rid, k ORDER BY score DESC, name) = 1),
g AS (SELECT rid, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(score) AS top FROM best GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licenses, round(coalesce(top, 0), 6)::DOUBLE AS best_score FROM d LEFT JOIN g USING (rid)"""

_WORDS = rf"list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> ''), lambda x: translate(x, {_LOWER}))"

_OP9 = f"""
WITH i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM i, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS r(k)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
    FROM d, (SELECT DISTINCT n FROM iw) AS s, unnest(range(1, len(w) - n + 2)) AS r(k)),
hit AS (SELECT rid, k, n, item_id FROM dw JOIN iw USING (n, win)),
spots AS (SELECT rid, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT rid, k, n FROM hit), unnest(range(0, n)) AS r(j) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (rid) LEFT JOIN items USING (rid)"""



def _crc32(text: str) -> str:
    """SQL of the CRC-32 of a text of ASCII characters."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {step}), 4294967295::BIGINT)"


_OP13 = f"""
WITH t AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, count(*) AS n, c - c % 5 AS b, {_crc32('c::VARCHAR')} % 9 AS h FROM t GROUP BY c),
taken AS (SELECT i.*, least(i.h, coalesce(k.n, 0)) AS taken FROM ids i LEFT JOIN ids k ON i.b = k.c),
m AS (SELECT i.c, p + 1 AS d, mark, bytes FROM taken i JOIN t ON t.c = i.b AND p < h
    UNION ALL SELECT i.c, p - h + taken + 1, mark, bytes FROM taken i JOIN t ON t.c = i.c AND p >= h),
paths AS (SELECT c, d, bytes, string_agg(mark, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, count(*) OVER (PARTITION BY c) AS len FROM m
    UNION ALL SELECT c, 0, 0, '', (SELECT count(*) FROM m WHERE m.c = ids.c) FROM ids),
nodes AS (SELECT path, d, min(c) AS o, count(*) AS n, min(bytes) AS bytes,
    string_agg(CASE WHEN len = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM paths GROUP BY path, d),
kids AS (SELECT left(path, 32 * (d - 1)::INT) AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
v AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (path)),
below AS (SELECT u.path, sum((w.n - 1) * w.bytes) AS saved, count(*) FILTER (WHERE w.k = 0) AS leaves FROM v u JOIN v w ON starts_with(w.path, u.path) GROUP BY u.path)
SELECT v.o AS conv_id, v.d AS depth, up.o AS parent_conv_id, v.n AS n_convs, v.k AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens,
    sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN below USING (path) LEFT JOIN v up ON v.d > 0 AND up.path = left(v.path, 32 * (v.d - 1)::INT)"""


def _op12() -> str:
    """The cheapest edits by a recursion over turns; a state is a struct of cost, audit and repaired text, so least() breaks ties by the audit."""

    def edit(state: str, price: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {price}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"

    insert = {"user": "chr(10) || 'user:'", "assistant": "chr(10) || 'assistant:'"}
    keep = lambda z, x: f"CASE WHEN starts_with(p.role, '{x}') THEN {edit(z, 'pay', 'K', 'chr(10) || p.role || chr(58) || p.text')} END"
    rerole = lambda z, who: edit(z, "pay + 1", "R", f"{insert[who]} || p.text")
    drop = lambda z: edit(z, "2", "D")
    put = lambda z, who: edit(z, "5", "I", insert[who])
    start = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    mark = "md5(strlen(role) || ':' || role || text)"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
dm AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM raw, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS c(copy) WHERE k <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {mark}) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM dm),
pos AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 2
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    i > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM numbered),
priced AS (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS pay FROM pos),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {start} AS b, {never} AS s, {put(start, 'user')} AS u, {put(put(start, 'user'), 'assistant')} AS a FROM pos
    UNION ALL SELECT conv_id, i, b, s, least(u, {put('a', 'user')}), a FROM (
        SELECT conv_id, i, b, s, u, least(a, {put('u', 'assistant')}) AS a FROM (
            SELECT conv_id, i, b, s, least(u, {put('b', 'user')}, {put('s', 'user')}, {put('a', 'user')}) AS u, a FROM (
                SELECT w.conv_id, p.i, {drop('w.b')} AS b, least({drop('w.s')}, {keep('w.b', 's')}) AS s,
                    least({drop('w.u')}, {keep('w.b', 'u')}, {keep('w.s', 'u')}, {keep('w.a', 'u')}, {rerole('w.b', 'user')}, {rerole('w.s', 'user')}, {rerole('w.a', 'user')}) AS u,
                    least({drop('w.a')}, {keep('w.u', 'a')}, {rerole('w.u', 'assistant')}) AS a
                FROM walk w JOIN priced p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1)))),
final AS (SELECT w.conv_id, least(w.b, w.a) AS f FROM walk w JOIN pos p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i AND p.i = p.n),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM pos GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(f.c, 0) AS cost, coalesce(f.a, '') AS audit, sha256(coalesce(substr(f.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN final ON o.conv_id IS NOT DISTINCT FROM final.conv_id
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE: dict[str, str] = {
    "op3_url_filter": _OP3,
    "op5_chat_rotation": _OP5,
    "op7_quality_rules": _OP7,
    "op8_license_scan": _OP8,
    "op9_decontaminate": _OP9,
    "op12_conversation_repair": _op12(),
    "op13_prefix_trie": _OP13,
}
