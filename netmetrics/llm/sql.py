"""DuckDB SQL of the text operators that SQL can express, derived from the contracts and not from the operators' methods.

Token ids (op2, op7, and with them the pipeline) and learned models (op5, op9) are not expressible.
"""

from __future__ import annotations

from netmetrics.llm.quality import LIMITS, LINE_LIMIT
from netmetrics.llm.secrets import RULES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = r"'[^\x20\x09-\x0D]+'"


def _gram(n: int, word: str = "word") -> str:
    """The n words from a row on; needs WINDOW o AS (PARTITION BY doc_id ORDER BY i)."""
    return "concat_ws(' ', " + ", ".join([word, *(f"lead({word}, {k}) OVER o" for k in range(1, n))]) + ")"


def decontamination(window: int = 10) -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""WITH b AS (SELECT row_number() OVER () AS t, item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {word}) AS w FROM benchmark WHERE item_id IS NOT NULL),
bp AS (SELECT t, item, w, least(len(w), {window}) AS width, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS q FROM b WHERE len(w) > 0),
bw AS (SELECT t, item, q, width, array_to_string(w[q : q + width - 1], ' ') AS g FROM bp),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {word}) AS w FROM documents),
dp AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT doc_id, i AS p, total - i + 1 AS rest, {", ".join(f"{_gram(n)} AS g{n}" for n in range(1, window + 1))} FROM dp WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dw AS ({" UNION ALL ".join(f"SELECT doc_id, p, {n} AS width, g{n} AS g FROM o WHERE rest >= {n} AND EXISTS (SELECT 1 FROM bw WHERE width = {n})" for n in range(1, window + 1))}),
hit AS (SELECT DISTINCT dw.doc_id, dw.p, dw.width, bw.t, bw.item, bw.q FROM dw JOIN bw ON dw.width = bw.width AND dw.g = bw.g),
cover AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + width)) AS p FROM (SELECT DISTINCT doc_id, p, width FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1),
island AS (SELECT doc_id, t, p, width, p - row_number() OVER (PARTITION BY doc_id, t, p - q ORDER BY p) AS k, p - q AS diagonal FROM hit),
longest AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) - 1 + any_value(width) AS n FROM island GROUP BY doc_id, t, diagonal, k) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest.n, 0)::BIGINT AS longest_match
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)"""


def substring_dedup() -> str:
    """Strings of 100 bytes are compared by 64-bit hashes, doubled from those of one byte."""
    steps = "\n".join(f"x{2 * n} AS (SELECT doc_id, p, c, hash(h, lead(h, {n}) OVER (PARTITION BY doc_id ORDER BY p)) AS h FROM x{n})," for n in (1, 2, 4, 8, 16, 32))
    return f"""WITH x1 AS (SELECT doc_id, unnest(range(strlen(coalesce(text, '')))) AS p, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS c, hash(c) AS h FROM documents),
{steps}
x100 AS (SELECT doc_id, p, c, h, lead(h, 36) OVER (PARTITION BY doc_id ORDER BY p) AS h2, count(*) OVER (PARTITION BY doc_id) AS n FROM x64),
s AS (SELECT doc_id, p, c, p + 100 <= n AND row_number() OVER (PARTITION BY h, h2, p + 100 <= n ORDER BY doc_id, p) > 1 AS again FROM x100),
g AS (SELECT doc_id, p, c, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM s),
e AS (SELECT doc_id, p, c, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS first FROM g),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(c, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY 1)
SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)"""


def line_dedup() -> str:
    return rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, e' \t\n\x0B\x0C\r'), {_AZ}) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY 1),
m AS (SELECT k.*, coalesce(first, doc_id) <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""


def quality() -> str:
    grams = sorted({8, *LIMITS})
    own = ", ".join(f"CASE WHEN i + {n - 1} <= total THEN {_gram(n)} END AS gram_{n}" for n in grams)
    again = ", ".join(f"gram_{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram_{n}) > 1 AS again_{n}" for n in grams)
    cover = ", ".join(f"bool_or(again_{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in_{n}" for n in grams)
    chars = ", ".join(f"coalesce(sum(length(word)) FILTER (in_{n}), 0)::BIGINT AS dup_chars_{n}" for n in LIMITS)
    verdict = " OR ".join([f"100 * dup_line_chars > {LINE_LIMIT} * word_chars", *(f"100 * dup_chars_{n} > {x} * word_chars" for n, x in LIMITS.items())])
    names = ", ".join(f"dup_chars_{n}" for n in LIMITS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT doc_id, i, word, {own} FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, i, word, {again} FROM o),
c AS (SELECT doc_id, word, {cover} FROM a),
s AS (SELECT doc_id, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (in_8) AS n_repeat_words, {chars} FROM c GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AND regexp_matches(line, {_SPACE}) AS again FROM l),
t AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (again), 0)::BIGINT AS dup_line_chars FROM r GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, dup_line_chars, {", ".join(f"coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}" for n in LIMITS)} FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({verdict}) AS kept, dup_line_chars, {names} FROM b"""


def secret_scan() -> str:
    """A match begins after the pieces and matches before it."""
    parts = []
    for k, (name, pattern, group, least) in enumerate(RULES):
        own = "'" + pattern.replace("'", "''") + "'"
        size = f"length(regexp_extract(m, {own}, {group}))"
        parts.append(
            f"SELECT doc_id, {k} AS kind, '{name}' AS name, s, s + length(m) AS e FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda j: list_sum(list_transform(gaps[:j], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:j - 1], lambda g: length(g))), 0))) AS s"
            f" FROM (SELECT doc_id, regexp_extract_all(text, {own}) AS ms, string_split_regex(text, {own}) AS gaps FROM documents WHERE regexp_matches(text, {own}))) WHERE {size} >= {least}"
        )
    spans = " UNION ALL ".join(parts)
    return f"""WITH f AS ({spans}),
r AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{RULES[k][0]}" for k in range(3))}, string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) AS spans FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{RULES[k][0]}, 0)::BIGINT AS n_{RULES[k][0]}" for k in range(3))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN r USING (doc_id)"""


def jaccard_join(n: int = 5, percent: int = 75) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_SPACE}) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT doc_id, i, total, {_gram(n)} AS g FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, g FROM o WHERE i = 1 OR i + {n - 1} <= total),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common.n >= {percent} * (x.n + y.n - common.n)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, way.b FROM reach JOIN way ON way.a = reach.r)
SELECT doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id"""


def fill_in_middle() -> str:
    unit = r"'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'"
    h = ", ".join(f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT AS h{k + 1}" for k in range(4))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {unit}) AS u, sha256('42:' || doc_id) AS h FROM documents),
x AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, {h} FROM d),
f AS (SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS head, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS tail FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
