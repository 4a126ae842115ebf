"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quoin.llm.mixing import BLOCK, GOLDEN, WORD
from quoin.llm.url_filter import CUT, RULES, STRONGEST, WEAKEST, Z


def warc_sql() -> str:
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INT) >> {s}) & 31 AS INT) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
f AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""


TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def mixing_sql() -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
s4 AS (SELECT *, min(CASE WHEN cap < w * level THEN 1 ELSE 0 END) OVER (ORDER BY cap / w, sid ROWS UNBOUNDED PRECEDING) AS capped FROM s3),
s5 AS (SELECT *, (SELECT level FROM s4 WHERE capped = 0 ORDER BY cap / w, sid LIMIT 1) AS open_level FROM s4),
s6 AS (SELECT source, source_size, CAST(CASE WHEN capped = 1 THEN cap ELSE w * open_level END AS DOUBLE) AS target FROM s5),
s7 AS (SELECT *, least(3 * source_size, CAST(floor(target + 0.5) AS BIGINT)) AS need FROM s6),
o AS (SELECT d.*, source_size, target, need,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
h AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS sid, coalesce(sum(target) OVER (ORDER BY encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS lo,
             sum(target) OVER (ORDER BY encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS up, lead(need) OVER (ORDER BY encode(source) NULLS LAST) IS NULL AS final FROM s7),
total AS (SELECT CAST(ceil(sum(source_size) / {BLOCK}) AS BIGINT) AS n FROM s7),
points AS (SELECT i, ((i >> 20) * {(GOLDEN * (1 << 20)) % 1.0!r}::DOUBLE + (i & 1048575) * {GOLDEN!r}::DOUBLE) % 1.0 AS x FROM (SELECT unnest(range((SELECT n FROM total))) AS i)),
ranked AS (SELECT i AS slot, sid, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS k FROM points JOIN h ON x >= lo AND (x < up OR final)),
lacks AS (SELECT sid, have, least_ AS want, greatest(least_ - have, 0) AS lacks FROM (SELECT h.sid, CAST(ceil(need / {BLOCK}) AS BIGINT) AS least_, (SELECT count(*) FROM ranked r WHERE r.sid = h.sid) AS have FROM h)),
late AS (SELECT sid, have, lacks, (SELECT n FROM total) + coalesce(sum(lacks) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lacks),
slots AS (SELECT sid, k, slot FROM ranked UNION ALL SELECT sid, have + i, CAST(base + i AS BIGINT) FROM (SELECT *, unnest(range(lacks)) AS i FROM late)),
starts AS (SELECT h.source, k, slot FROM slots JOIN h USING (sid))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (need // source_size) * size + greatest(0, least(a + size, need % source_size) - a) END AS BIGINT) AS taken,
       CASE WHEN size > 0 AND a < need THEN slot END AS first_slot,
       CAST(CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range(3), lambda p: CASE WHEN p * source_size + a < need THEN (least(p * source_size + a + size, need) - 1) // {BLOCK} - (p * source_size + a) // {BLOCK} + 1 ELSE 0 END)) END AS BIGINT) AS pieces
FROM o LEFT JOIN starts ON o.source IS NOT DISTINCT FROM starts.source AND starts.k = o.a // {BLOCK}"""


def strength_sql(name: str, of: str, parent: str) -> str:
    return f"""
{name}0 AS (SELECT {parent} AS parent, count(*) AS g, CAST(sum(n) AS DOUBLE) AS t, CAST(sum(k) AS DOUBLE) AS b, sum(k * k / n) AS kk, CAST(sum(n * n) AS DOUBLE) AS nn FROM {of} GROUP BY 1),
{name}1 AS (SELECT sum(kk - b * (b / t) - b / t * (1 - b / t) * (g - 1)) AS spread, sum(b / t * (1 - b / t) * (t - nn / t - (g - 1))) AS room FROM {name}0),
{name}2 AS (SELECT CASE WHEN room > 0 AND spread > 0 THEN spread / room ELSE 0 END AS rho FROM {name}1),
{name} AS (SELECT CASE WHEN rho <= 0 THEN {STRONGEST} WHEN rho >= 1 THEN {WEAKEST} ELSE greatest({WEAKEST}, least({STRONGEST}, (1 - rho) / rho)) END AS c FROM {name}2)"""


def url_sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda r: (lambda at, rest: f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}')")(*(r[1].partition('/')[i] for i in (0, 2)))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[1]}'" for r in rules)
    action = " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in rules)
    last = lambda x, n: f"array_to_string(string_split({x}, '.')[-{n}:], '.')"
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM a),
l AS (SELECT doc_id, max(greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1))) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
e AS (SELECT host, bad FROM p JOIN l ON TRY_CAST(regexp_extract(path, '\A/[a-z]+/([0-9]+)', 1) AS BIGINT) = l.doc_id),
h AS (SELECT host, count(*) AS n, sum(bad) AS k FROM e GROUP BY host),
dm AS (SELECT {last('host', 2)} AS domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1),
sx AS (SELECT {last('domain', 1)} AS suffix, sum(n) AS n, sum(k) AS k FROM dm GROUP BY 1),
m AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 10) AS m0 FROM sx),
{strength_sql("cs", "sx", "1")}, {strength_sql("cd", "dm", last("domain", 1))}, {strength_sql("ch", "h", last("host", 2))},
u AS (SELECT DISTINCT host, {last('host', 2)} AS domain, {last('host', 1)} AS suffix FROM p),
w AS (SELECT u.host, coalesce(h.n, 0) AS nh, coalesce(h.k, 0) AS kh, coalesce(dm.n, 0) AS nd, coalesce(dm.k, 0) AS kd, coalesce(sx.n, 0) AS ns, coalesce(sx.k, 0) AS ks, m0, cs.c AS cs, cd.c AS cd, ch.c AS ch
      FROM u LEFT JOIN h USING (host) LEFT JOIN dm USING (domain) LEFT JOIN sx USING (suffix), m, cs, cd, ch),
x AS (SELECT *, (kd + cd * ((ks + cs * m0) / (ns + cs))) / (nd + cd) AS md FROM w),
y AS (SELECT host, (kh + ch * md) / (nh + ch) AS rate, nh + ch AS n FROM x),
z AS (SELECT host, rate - {Z} * sqrt(rate * (1 - rate) / (n + 1)) AS bound FROM y)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {action} END, CASE WHEN bound > {CUT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN z USING (host)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc_sql(), "op3_topk": TOPK, "op6_mixing": mixing_sql(), "op7_url_filter": url_sql()}
