"""DuckDB SQL for the registered contract queries that SQL can express."""

from __future__ import annotations

W = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP = rf"[^{W})\]}}>,;，。；：！？）】》]"
TAIL = " {v1} <style id=''2''>GPP</style> 2.5 mm https://x.org/a. doi 10.1000/demo;"

STRIP = lambda x: rf"regexp_replace({x}, '\A[{W}]+|[{W}]+\z', '', 'g')"
NORMAL = lambda x: STRIP(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")
NUMBER = lambda x: rf"regexp_extract_all({x}, '(?:^|[^\p{{Nd}}A-Za-z])([-+−]?\p{{Nd}}+(?:[.,]\p{{Nd}}+)?(?:[eE][-+]?\p{{Nd}}+)?)', 1)"
ABBREVIATION = lambda x: rf"list_filter(regexp_extract_all(regexp_replace({x}, '([^A-Za-z0-9-])', '\1\1', 'g'), '(?:^|[^A-Za-z0-9])([A-Z][A-Z0-9-]+)(?:$|[^A-Za-z0-9])', 1), lambda v: v NOT IN ('ABSTRACT', 'KEYWORDS', 'REFERENCES'))"
FORMULA = lambda x: rf"regexp_extract_all({x}, '\{{v\p{{Nd}}+\}}')"
STYLE = lambda x: rf"regexp_extract_all({x}, '(?i)<style[{W}]+id=[''\x22]\p{{Nd}}+[''\x22]>|</style>')"
# units without looking around: every character but letters is doubled, so that a boundary can be taken by either neighbour; signs that are units get one of their own
APART = lambda x: rf"regexp_replace(regexp_replace(replace(replace({x}, '%', chr(4) || '%' || chr(4)), '°', chr(4) || '°'), '([A-Za-z])\x04([%°])', '\1\2', 'g'), '%\x04([A-Za-z])', '%\1', 'g')"
DOUBLE = lambda x: rf"regexp_replace({APART(x)}, '([^A-Za-z])', '\1\1', 'g')"
SINGLE = lambda x: rf"regexp_replace({x}, '([^A-Za-z])[^A-Za-z]', '\1', 'g')"
GAP = rf"(?:[{W}]{{2}})*"
UNITS = rf"%%|°°[CF]?|mm|cm|m|km|Pa|hPa|K|W{GAP}m(?:--)?22|g{GAP}C{GAP}m(?:--)?22(?:{GAP}d(?:--)?11)?|µµmol{GAP}m(?:--)?22{GAP}s(?:--)?11"
UNIT = lambda x: f"list_transform(regexp_extract_all({DOUBLE(x)}, '(?i)(?:^|[^A-Za-z])({UNITS})(?:$|[^A-Za-z])', 1), lambda v: {SINGLE('v')})"
BARE = lambda x: f"list_transform({x}, lambda v: rtrim(v, '.,;:!?。，、；：！？'))"
URL = lambda x: BARE(rf"regexp_extract_all({x}, '(?i)https?://{STOP}+')")
DOI = lambda x: BARE(rf"regexp_extract_all({x}, '(?i)\b10\.\p{{Nd}}{{4,9}}/{STOP}+')")

LINES = """l0 AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l1 AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, parts FROM l0),
lines AS (SELECT doc_id * 1000000 + line_no AS pos, doc_id, line_no, parts[line_no] AS source FROM l1 WHERE trim(parts[line_no], ' ') <> '')"""
SEGS = f"""{LINES},
keyed AS (SELECT *, sha256({NORMAL('source')}) AS id FROM lines),
segs AS (SELECT id, pos, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM keyed) WHERE rn = 1)"""
PAIRS = rf"""{SEGS},
p0 AS (SELECT id, source || '{TAIL}' AS source, substr(id, 1, 1) AS h FROM segs),
pairs AS (SELECT id, source, CASE WHEN h <= '3' THEN source WHEN h <= '6' THEN regexp_replace(source, '[0-9]', '', 'g') WHEN h = '7' THEN '  '
  WHEN h IN ('8', '9', 'a', 'b') THEN source || ' 中文 NEW 7' WHEN h <= 'd' THEN replace(source, '{{v1}}', '') ELSE replace(source, 'GPP', 'gross') END AS target FROM p0)"""


def lost(a: str, b: str) -> str:
    return f"array_to_string(list_transform(list_filter(range(1, len({a}) + 1), lambda i: list_position({a}, {a}[i]) = i AND len(list_filter({a}, lambda x: x = {a}[i])) > len(list_filter({b}, lambda x: x = {a}[i]))), lambda i: {a}[i]), '|')"


SIDES = {"f": FORMULA, "s": STYLE, "u": URL, "d": DOI, "n": NUMBER, "a": ABBREVIATION, "m": UNIT}
ERRORS = rf"""{PAIRS},
tok AS (SELECT id, source, target, {', '.join(f"{f('source')} AS {k}1, {f('target')} AS {k}2" for k, f in SIDES.items())} FROM pairs),
err AS (SELECT id, CASE WHEN {STRIP('target')} = '' THEN ['blank'] ELSE list_filter([
  CASE WHEN list_sort(f1) <> list_sort(f2) THEN 'formula_mismatch' END, CASE WHEN list_sort(s1) <> list_sort(s2) THEN 'style_mismatch' END,
  CASE WHEN list_sort(u1) <> list_sort(u2) THEN 'url_mismatch' END, CASE WHEN list_sort(d1) <> list_sort(d2) THEN 'doi_mismatch' END,
  CASE WHEN {lost('n1', 'n2')} <> '' THEN 'number_missing:' || {lost('n1', 'n2')} END, CASE WHEN {lost('a1', 'a2')} <> '' THEN 'abbreviation_missing:' || {lost('a1', 'a2')} END,
  CASE WHEN {lost('m1', 'm2')} <> '' THEN 'unit_missing:' || {lost('m1', 'm2')} END, CASE WHEN s1 <> s2 THEN 'style_order' END,
  CASE WHEN len(regexp_extract_all(source, '[A-Za-z]')) >= 40 AND NOT regexp_matches(target, '[\x{{3400}}-\x{{9fff}}]') THEN 'cjk_missing' END], lambda e: e IS NOT NULL) END AS e FROM tok)"""

FOLD = lambda x: f"replace(lower({x}), 'ß', 'ss')"
MATCH = lambda x: rf"regexp_replace({FOLD(rf'''regexp_replace({x}, '(?i)\{{v\p{{Nd}}+\}}', '', 'g')''')}, '[^a-z0-9]+', '', 'g')"

BLOCKS = f"""{LINES},
blocks AS (SELECT doc_id, line_no AS n, (line_no - 1) // 8 AS page, (line_no - 1) % 8 AS block_no, CASE WHEN line_no = 5 THEN '6 References' WHEN line_no = 20 THEN '7 Figures' ELSE source END AS text FROM lines),
heads AS (SELECT doc_id, count(*) AS c FROM blocks WHERE regexp_matches(text, '(?i)\\A[{W}]*(?:\\p{{Nd}}+[{W}]+)?REFERENCES?(?:[{W}]+\\p{{Nd}}+)?[{W}]*\\z') GROUP BY doc_id HAVING count(*) = 1),
stop AS (SELECT doc_id, min(n) AS stop FROM blocks WHERE n > 5 AND regexp_matches(text, '(?i)\\A[{W}]*\\p{{Nd}}+[{W}]+[A-Za-z][A-Za-z ]{{0,80}}[{W}]*\\z') GROUP BY doc_id)"""

PAGES = """pg AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_quantity) AS q, min(l_discount) AS d, min(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY 1, 2),
tg AS (SELECT * FROM pg WHERE NOT (page = 3 AND doc_id % 2 = 0))"""
DRAWN = """li AS (SELECT l_suppkey AS doc_id, l_orderkey AS ord, l_linenumber AS page, min(l_discount) AS d, min(l_tax) AS t FROM lineitem GROUP BY 1, 2, 3),
dr AS (SELECT doc_id, page, ord, printf('%.2f', d * 1.005) || ',' || printf('%.2f', t * 1.005) || ',' || printf('%.2f', d * 10.015) AS key, d, t FROM li)"""


def glossary_sql() -> str:
    terms = "(VALUES ('the', 'der', 'the'), ('tion', 'que', 'Tion')) AS g(s, t, term)"
    return f"{PAIRS}, glossary AS (SELECT id, term FROM pairs JOIN {terms} ON contains({FOLD('source')}, s) AND NOT contains({FOLD('target')}, t))"


def oracle_sql() -> dict[str, str]:
    rt = f"array_to_string({{}}, '|')".format
    return {
        "seg_collect": f"WITH {SEGS} SELECT id, pos, sha256(source) AS raw_sha FROM segs",
        "seg_dup_count": f"WITH {SEGS}, d AS (SELECT id, count(*) AS n FROM keyed GROUP BY id HAVING count(*) > 1) SELECT count(*) AS ids, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_them FROM d",
        "tok_number": f"WITH t AS (SELECT doc_id, {NUMBER('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n, {rt('t')} AS found FROM t WHERE len(t) > 0",
        "tok_abbreviation": f"WITH t AS (SELECT doc_id, {ABBREVIATION('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n, {rt('t')} AS found FROM t WHERE len(t) > 0",
        "tok_formula_style": f"WITH {PAIRS} SELECT id, {rt(FORMULA('target'))} AS formula, {rt(STYLE('target'))} AS style, {rt(DOI('target'))} AS doi FROM pairs WHERE target <> '  '",
        "tok_url": f"""SELECT page_id, {rt(URL("'see ' || url || ').'"))} AS found FROM pages""",
        "token_counts": f"WITH {PAIRS}, t AS (SELECT unnest({NUMBER('source')}) AS token FROM pairs) SELECT token, count(*) AS n FROM t GROUP BY token",
        "contract_errors": f"WITH {ERRORS} SELECT id, array_to_string(e, ',') AS errors FROM err",
        "tok_unit": f"WITH t AS (SELECT doc_id, {UNIT('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n, {rt('t')} AS found FROM t WHERE len(t) > 0",
        "contract_summary_all": f"WITH {ERRORS}{glossary_sql().removeprefix(PAIRS)}, x AS (SELECT unnest(e) AS e FROM err UNION ALL SELECT 'glossary' FROM glossary JOIN err USING (id) WHERE e <> ['blank']) SELECT split_part(e, ':', 1) AS code, count(*) AS n FROM x GROUP BY 1",
        "contract_summary": f"WITH {ERRORS}, x AS (SELECT unnest(CASE WHEN len(e) = 0 THEN ['clean'] ELSE e END) AS e FROM err) SELECT split_part(e, ':', 1) AS code, count(*) AS n FROM x GROUP BY 1",
        "multiset_missing": f"WITH {PAIRS}, a AS (SELECT id, unnest({NUMBER('source')}) AS token FROM pairs), b AS (SELECT id, unnest({NUMBER('target')}) AS token FROM pairs), x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b) SELECT token, count(*) AS n FROM x GROUP BY token",
        "glossary_violations": f"WITH {glossary_sql()} SELECT id, term FROM glossary",
        "id_closure": f"WITH {SEGS}, a AS (SELECT id FROM segs WHERE id < 'd'), b AS (SELECT id FROM segs WHERE id > '3') SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL",
        "validate_rows": rf"""WITH {SEGS},
t AS (SELECT id, source, id > 'e' AS changed, CASE WHEN id >= '58' AND id <= '68' THEN source || ' 7 中' ELSE source END AS target FROM segs WHERE id > '1' UNION ALL SELECT id, source, false, source FROM segs WHERE id >= 'c0' AND id <= 'c8'),
r AS (SELECT id, id >= '5c' AND id <= '7' AS through, id >= '3' AND id <= '60' AS ref, changed, source = target AS same, len(regexp_extract_all(source, '[A-Za-z]')) >= 40 AND NOT regexp_matches(target, '[\x{{3400}}-\x{{9fff}}]') AS cjk FROM t),
e AS (SELECT id, CASE WHEN changed THEN 'source' WHEN through THEN CASE WHEN NOT same THEN 'passthrough_changed' END WHEN ref THEN CASE WHEN NOT same THEN 'preserved_changed' END WHEN cjk THEN 'cjk_missing' END AS code FROM r)
SELECT id, code FROM e WHERE code IS NOT NULL UNION ALL SELECT id, 'missing' FROM segs WHERE id <= '1' UNION ALL SELECT id, 'duplicate_translation' FROM segs WHERE id >= 'c0' AND id <= 'c8'
UNION ALL SELECT id, 'reference_and_passthrough' FROM segs WHERE id >= '5c' AND id <= '60' UNION ALL VALUES ('zz', 'unexpected'), ('none', 'unknown_passthrough')""",
        "lookup_targets": f"WITH {SEGS} SELECT pos, CASE WHEN id < '4' THEN 'later' WHEN id < '8' THEN 'T:' || substr(id, 1, 6) END AS target FROM keyed",
        "batches": """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, i, 0 AS batch, 1 AS n, size AS total FROM d WHERE i = 1
UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN r.n >= 12 OR r.total + d.size > 30000 THEN batch + 1 ELSE batch END, CASE WHEN r.n >= 12 OR r.total + d.size > 30000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 12 OR r.total + d.size > 30000 THEN d.size ELSE r.total + d.size END
FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1) SELECT source, doc_id, CAST(batch AS INT) AS batch FROM r""",
        "resume_pending": f"WITH {SEGS} SELECT count(*) FILTER (id < '5') AS reused, count(*) FILTER (id >= '5' AND id <= '9') AS preserved, count(*) FILTER (id > '9') AS pending FROM segs",
        "passthrough_confirm": f"WITH {SEGS}, e AS (SELECT row_number() OVER (ORDER BY id) AS pos, id FROM segs WHERE id < '08'), n AS (SELECT id, row_number() OVER (ORDER BY pos) AS rn FROM segs WHERE id >= '08' AND id <= '0c') SELECT pos, id FROM e UNION ALL SELECT (SELECT coalesce(max(pos), 0) FROM e) + rn, id FROM n",
        "coverage_fastpath": f"WITH {LINES}, d AS (SELECT doc_id, length({MATCH('text')}) AS m FROM documents), c AS (SELECT doc_id, pos, length({MATCH('source')}) AS n FROM lines) SELECT doc_id, pos, CAST(n AS INT) AS n, CAST(m AS INT) AS m, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS coverage FROM c JOIN d USING (doc_id)",
        "region_slice": f"""WITH {BLOCKS}, i AS (SELECT b.* FROM blocks b JOIN heads USING (doc_id) LEFT JOIN stop USING (doc_id) WHERE n > 5 AND (stop IS NULL OR n < stop)),
g AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY n) AS region FROM i GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS numbers FROM blocks JOIN heads USING (doc_id) LEFT JOIN stop USING (doc_id) WHERE stop IS NULL OR n < stop GROUP BY doc_id)
SELECT h.doc_id, CAST(0 AS INT) AS heading_page, CAST(length(coalesce(region, '')) AS INT) AS characters, CAST(coalesce(numbers, 0) AS INT) AS numbers, sha256(coalesce(region, '')) AS sha FROM heads h LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)""",
        "page_pair_diff": f"""WITH {PAGES}, c AS (SELECT doc_id, 0 AS page, 0 AS rule, 'page_count' AS code FROM (SELECT doc_id, count(*) AS a FROM pg GROUP BY 1) JOIN (SELECT doc_id, count(*) AS b FROM tg GROUP BY 1) USING (doc_id) WHERE a <> b
UNION ALL SELECT doc_id, 0, 0, 'page_count' FROM (SELECT DISTINCT doc_id FROM pg) WHERE doc_id NOT IN (SELECT doc_id FROM tg)),
e AS (SELECT doc_id, page, 0 AS rule, 'media_box' AS code FROM tg WHERE abs(q - (q + d * 2)) > 0.1 UNION ALL SELECT doc_id, page, 2, 'placeholders:{{v9}}|</STYLE>' FROM tg WHERE t = 0
UNION ALL SELECT doc_id, page, 4, 'vectors_fewer' FROM tg WHERE t > 0.06 UNION ALL SELECT doc_id, page, 5, 'blank' FROM tg WHERE t + 0.005 < 0.01 UNION ALL SELECT * FROM c)
SELECT doc_id, count(*) AS n_errors, string_agg(page || ':' || code, ',' ORDER BY page, row_n) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY rule) AS row_n FROM e) GROUP BY doc_id""",
        "missing_drawings": f"WITH {DRAWN}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, key ORDER BY ord) AS nth FROM dr), b AS (SELECT doc_id, page, key, count(*) AS there FROM dr WHERE ord % 5 <> 0 GROUP BY ALL) SELECT a.doc_id, a.page, a.ord FROM a LEFT JOIN b USING (doc_id, page, key) WHERE nth > coalesce(there, 0)",
        "vector_repair": f"""WITH {PAGES}, x AS (SELECT pg.doc_id, CASE WHEN tg.doc_id IS NULL THEN 'pages' WHEN CASE WHEN tg.t > 0.06 THEN 2 ELSE 3 END + CASE WHEN tg.page = 2 THEN 2 ELSE 0 END < 3 THEN 'vectors_fewer' END AS bad,
CASE WHEN CASE WHEN tg.t > 0.06 THEN 2 ELSE 3 END + CASE WHEN tg.page = 2 THEN 2 ELSE 0 END > 3 AND tg.doc_id IS NOT NULL THEN 1 ELSE 0 END AS more FROM pg LEFT JOIN tg USING (doc_id, page)),
g AS (SELECT doc_id, list_sort(list_distinct(list_filter(list(bad), lambda b: b IS NOT NULL))) AS bad, CAST(sum(more) AS BIGINT) AS changed FROM x GROUP BY doc_id)
SELECT doc_id, array_to_string(CASE WHEN changed = 0 THEN bad || ['nothing_added'] ELSE bad END, ',') AS violations, changed FROM g""",
        "outside_words": f"""WITH {DRAWN}, w AS (SELECT doc_id, page, CAST(printf('%.2f', d * 1.005) AS DOUBLE) AS x0, CAST(printf('%.2f', t * 1.005) AS DOUBLE) AS y0, CAST(printf('%.2f', d * 1.005 + 0.02) AS DOUBLE) AS x1, CAST(printf('%.2f', t * 1.005 + 0.02) AS DOUBLE) AS y1, CAST(ord AS VARCHAR) AS word FROM li
WHERE NOT (greatest(d * 1.005, 0.0) < least(d * 1.005 + 0.02, 0.05::DOUBLE) AND greatest(t * 1.005, 0.0) < least(t * 1.005 + 0.02, 0.04::DOUBLE)))
SELECT doc_id, page, CAST(count(*) AS INT) AS n, first(x0 ORDER BY x0, y0, x1, y1, word) AS x0, first(word ORDER BY x0, y0, x1, y1, word) AS word FROM w GROUP BY doc_id, page""",
        "eval_report": f"WITH {ERRORS}, x AS (SELECT len(e) AS n, source = target AS same FROM err JOIN pairs USING (id)) SELECT count(*) AS cases, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed, count(*) FILTER (same) AS exact FROM x",
        "eval_cases": f"WITH {ERRORS} SELECT id, array_to_string(e, ',') AS errors, len(e) = 0 AS passed, source = target AS exact FROM err JOIN pairs USING (id)",
        "missing_glyphs": "WITH c AS (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS ch FROM documents), m AS (SELECT doc_id, ch FROM c WHERE ch <> '' AND NOT (unicode(ch) BETWEEN 32 AND 126)) SELECT doc_id, string_agg(ch, '' ORDER BY encode(ch)) AS missing FROM m GROUP BY doc_id",
    }
