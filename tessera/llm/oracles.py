"""DuckDB forms of the queries that SQL can express."""

from tessera.llm.license_scan import PHRASES, SPELLINGS
from tessera.llm.license_texts import KNOWN_NOTICES, KNOWN_TEXTS
from tessera.llm.line_dedup import RATIO
from tessera.llm.quality_rules import CLOSERS, CUT_OFF, DATE, LINE_ENDS, LINK_STARTS, MENU_MARK, NOTICE_STARTS, SHOUT_MARK, STOCK_PHRASES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACE = r"[\x20\x09-\x0D]"
_COUNT = "(len(regexp_split_to_array({0}, {1})) - 1)"

OP1 = rf"""
WITH d AS (SELECT doc_id, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, t FROM d),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, word || chr(32) || lead(word, 1) OVER p || chr(32) || lead(word, 2) OVER p || chr(32) || lead(word, 3) OVER p || chr(32) || lead(word, 4) OVER p AS g
        FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, l, regexp_replace(l, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS x FROM (SELECT doc_id, unnest(ls) AS l FROM w)),
good AS (SELECT doc_id, sum(length(l)) AS chars, sum(length(l)) FILTER (
           regexp_matches(x, {_quote("[" + LINE_ENDS + "][" + CLOSERS.replace("]", chr(92) + "]") + "]*$")})
           AND NOT regexp_matches(x, {_quote(CUT_OFF.replace(".", chr(92) + ".") + "[" + CLOSERS.replace("]", chr(92) + "]") + "]*$")})
           AND NOT regexp_matches(x, {_quote(DATE)})
           AND NOT ({" OR ".join(f"starts_with(lower(x), {_quote(start)})" for start in (*LINK_STARTS, *NOTICE_STARTS))})
           AND NOT length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 0.05 * length(x)
           AND NOT {_COUNT.format("x", _quote(MENU_MARK))} > 2
           AND NOT {_COUNT.format("x", _quote(SHOUT_MARK))} > 2
           AND NOT (length(x) >= 12 AND upper(x) = x AND lower(x) <> x)
           AND NOT regexp_matches(lower(x), {_quote("|".join(STOCK_PHRASES))})) AS good_chars
         FROM line GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(chars, 0) AS chars, coalesce(good_chars, 0) AS good_chars
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN good USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 1000 * good_chars >= 500 * chars AS kept
FROM m
"""

_SPELLED = "regexp_replace(regexp_replace(' ' || lower({0}) || ' ', '[^\\p{{L}}\\p{{N}}\\n©]+', ' ', 'g'), ' ?\\n ?', ' ' || chr(10) || ' ', 'g')"
_JOINED = "' ' || array_to_string({0}, ' ') || ' '"
for _old, _new in (*SPELLINGS, *PHRASES):
    _SPELLED = f"regexp_replace({_SPELLED}, {_quote(_old)}, {_quote(_new.replace('$', chr(92)))}, 'g')"
for _old, _new in PHRASES:
    _JOINED = f"regexp_replace({_JOINED}, {_quote(_old)}, {_quote(_new)}, 'g')"

# Copyright lines by their words, written apart from the operator's pattern. w: the words of the line, without a leading "portions".
_FIRMS = "'authors', 'contributors', 'developers', 'maintainers', 'project', 'team', 'foundation', 'inc', 'ltd', 'llc', 'gmbh', 'corp', 'corporation', 'company'"
_AFTER = "list_filter(w, lambda y, k: NOT list_bool_and(list_transform(w[:k], lambda z: z IN ('copyright', 'c', '©'))))[1]"
_END = "CASE WHEN w[-3:] = ['all', 'rights', 'reserved'] THEN w[:-4] ELSE w END"
_COPYRIGHT = f"""(SELECT starts_with(x, '©') OR x = 'all rights reserved'
  OR (w[1] IN ('copyright', 'c', '©') AND regexp_matches({_AFTER}, '^([0-9][0-9][0-9][0-9]|yyyy|year)$'))
  OR (w[1] = 'copyright' AND w[2] IN ('c', '©'))
  OR (w[1] = 'copyright' AND NOT regexp_matches(w[2], '^(holder|owner|notice)') AND len({_END}) BETWEEN 2 AND 8 + (w[2] = 'by')::INT AND ({_END})[-1] IN ({_FIRMS}))
  FROM (SELECT CASE WHEN starts_with(x, 'portions ') THEN string_split(x[10:], ' ') ELSE string_split(x, ' ') END AS w))"""


def _lines(column: str) -> str:
    return f"list_filter(list_transform(string_split({_SPELLED.format(column)}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _digest(lines: str) -> str:
    return f"md5(trim({_JOINED.format(lines)}))"


_KNOWN = ", ".join(f"({_quote(k)}, {_quote(v)}, {str(k in KNOWN_NOTICES).lower()})" for k, v in {**KNOWN_TEXTS, **KNOWN_NOTICES}.items())

OP2 = f"""
WITH raw AS (SELECT name, notice, {_lines("body")} AS ls FROM (VALUES {_KNOWN}) v(name, body, notice)),
d AS (SELECT doc_id, {_lines("text")} AS ls FROM documents),
begun AS (SELECT DISTINCT x FROM (SELECT unnest(ls) AS x FROM raw UNION ALL SELECT unnest(ls) FROM d) WHERE regexp_matches(x, '^(portions )?(copyright|c |©|all rights)')),
cop AS (SELECT list(x) AS xs FROM begun WHERE {_COPYRIGHT}),
rawd AS (SELECT name, notice, unnest([{_digest("ls")}, {_digest("list_filter(ls, lambda x: NOT list_contains(coalesce(xs, []), x))")}]) AS digest FROM raw, cop),
known AS (SELECT digest, min(name) AS license_id FROM rawd GROUP BY digest),
nknown AS (SELECT digest, min(name) AS license_id FROM rawd WHERE notice GROUP BY digest),
n AS (SELECT doc_id, count(*) AS n, list_sort(list_distinct(list(license_id))) AS ids
      FROM (SELECT doc_id, md5(unnest(ls)) AS digest FROM d) JOIN nknown USING (digest) GROUP BY doc_id),
dd AS (SELECT doc_id, {_digest("ls")} AS whole, {_digest("list_filter(ls, lambda x: NOT list_contains(coalesce(xs, []), x))")} AS digest FROM d, cop)
SELECT dd.doc_id, dd.digest, coalesce(a.license_id, b.license_id) AS license_id, coalesce(array_to_string(ids, ';'), '') AS notice_ids, coalesce(n, 0)::BIGINT AS n_notice_lines
FROM dd LEFT JOIN known a ON dd.digest = a.digest LEFT JOIN known b ON dd.whole = b.digest LEFT JOIN n ON dd.doc_id = n.doc_id
"""

_U = "((('0x' || substr(md5({0}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"

OP6 = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, 0.5) AS w FROM n),
r AS (SELECT source, (w / sum(w) OVER ()) * sum(n) OVER () / n AS rate FROM w),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END) AS p
      FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM r)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT *, {_U.format("'mix-1:' || coalesce(doc_id::VARCHAR, '')")} AS u FROM documents),
x AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.doc_id),
y AS (SELECT d.*, unnest(range(1, x.n + 1))::BIGINT AS copy FROM documents d JOIN x USING (doc_id))
SELECT *, {_U.format("'mix-1-order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR")} AS shuffle_key FROM y
"""

OP7 = rf"""
WITH d AS (SELECT *, string_split(text, chr(10)) AS ls FROM documents),
key AS (SELECT doc_id, coalesce(source, chr(0)) AS host, unnest(list_distinct(list_transform(ls, lambda x: trim(regexp_replace(x, '[\t\r\x0B\f]', ' ', 'g'))))) AS k FROM d),
tot AS (SELECT coalesce(source, chr(0)) AS host, count(*) AS total FROM documents GROUP BY 1),
bad AS (SELECT host, k FROM (SELECT host, k, count(*) AS n FROM key WHERE k <> '' GROUP BY ALL) JOIN tot USING (host) WHERE n >= 3 AND n > {RATIO}::DOUBLE * total),
sets AS (SELECT host, list(k) AS ks FROM bad GROUP BY host),
e AS (SELECT d.*, CASE WHEN ks IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(ks, trim(regexp_replace(x, '[\t\r\x0B\f]', ' ', 'g')))) END AS kept
      FROM d LEFT JOIN sets ON coalesce(d.source, chr(0)) = sets.host)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text, lang, source, n_chars, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped FROM e
"""

# crc32 is a fold over the bytes with the table of the polynomial EDB88320.
OP11 = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
p AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM d),
b AS (SELECT run, c, s, hex(s) AS hx FROM p),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx) // 2 + 1), lambda i: ('0x' || substr(hx, 2 * i - 1, 2))::BIGINT)),
        lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
skip AS (SELECT word, n, i, substr(word, 1, i) || chr(0) || substr(word, i + 2) AS gap, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM skip a JOIN skip b USING (gap) WHERE a.word <> b.word
   UNION SELECT s.word, v.word, v.n FROM skip s JOIN v ON s.less = v.word
   UNION SELECT v.word, s.word, s.n FROM skip s JOIN v ON s.less = v.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) r USING (word)
"""

OP13 = r"""
WITH it AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM it GROUP BY ALL),
tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM tok SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM d, g),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op2_license_scan": OP2, "op6_mix_sources": OP6, "op7_line_dedup": OP7, "op11_spelling_variants": OP11, "op13_ranked_search": OP13}
