"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from riskloom.llm import quality, secret_scan

WORD = r"[^\x20\x09-\x0D]+"


def _spans(rule: secret_scan.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    keep = f"len(regexp_extract_all(t, '{pattern}', {rule.group})[k]) >= {rule.least}" if rule.least else "true"
    order = [r.name for r in secret_scan.RULES].index(rule.name)
    return f"""SELECT doc_id, '{rule.name}' AS kind, {order} AS ord, e - len(hits[k]) AS s, e FROM (
      SELECT doc_id, k, t, hits, list_sum(list_transform(gaps[1:k], lambda x: len(x)))::BIGINT
             + list_sum(list_transform(hits[1:k], lambda x: len(x)))::BIGINT AS e
      FROM (SELECT doc_id, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS k FROM (
        SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM docs)))
    WHERE {keep}"""


OP1 = """WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i))),
pts AS (SELECT pos, shard, row_number() OVER (ORDER BY pos, shard) - 1 AS arc FROM (
  SELECT s AS shard, ('0x' || substr(md5('shard-' || s || '/' || v), 1, 8))::BIGINT AS pos FROM range(16) a(s), range(128) b(v))),
docs AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), 4294967295) AS text_crc32,
  md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))) AS h FROM documents, tab),
met AS (SELECT d.*, coalesce(p.arc, 0) AS arc FROM (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS p FROM docs) d ASOF LEFT JOIN pts p ON d.p <= p.pos),
arcs AS (SELECT p.arc, p.shard, coalesce(n, 0) AS n FROM pts p LEFT JOIN (SELECT arc, count(*) AS n FROM met GROUP BY arc) c ON c.arc = p.arc),
total AS (SELECT sum(n) AS n, greatest(1, floor(sqrt(max(n)))) AS fine FROM arcs),
caps AS (SELECT s AS shard, n // 16 + CASE WHEN s < n % 16 THEN 1 ELSE 0 END AS cap FROM range(16) a(s), total),
home AS (SELECT a.*, cap, sum(a.n) OVER (PARTITION BY a.shard ORDER BY arc) - a.n AS earlier FROM arcs a JOIN caps c ON c.shard = a.shard),
stay AS (SELECT *, greatest(0, least(n, cap - earlier))::BIGINT AS stays, least(cap, earlier)::BIGINT AS base FROM home),
over AS (SELECT *, (sum(n - stays) OVER (ORDER BY arc) - (n - stays))::BIGINT AS over_before FROM stay),
lists AS (SELECT list(shard ORDER BY arc) AS shards, list_append(list(over_before ORDER BY arc), sum(n - stays)::BIGINT) AS arrived FROM over),
rooms AS (SELECT list(room ORDER BY shard) AS room FROM (SELECT shard, (any_value(cap) - sum(stays))::BIGINT AS room FROM stay GROUP BY shard)),
sweep(step, served, room, take, shard, slot) AS (
  SELECT -1::BIGINT, 0::BIGINT, room, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM rooms
  UNION ALL
  SELECT step, served, list_transform(room, lambda r, i: CASE WHEN i = shard + 1 THEN r - take ELSE r END), take, shard, slot FROM (
    SELECT step, served, room, shard, least(arrived[least(step, 2048) + 1] - served, room[shard + 1]) AS take, cap - room[shard + 1] AS slot FROM (
      SELECT w.step + 1 AS step, w.served + w.take AS served, w.room, l.shards[((w.step + 1) % 2048) + 1] AS shard, l.arrived
      FROM sweep w, lists l WHERE w.step < 4095) JOIN (SELECT shard AS s, cap::BIGINT AS cap FROM caps) ON s = shard)),
ranked AS (SELECT m.*, row_number() OVER (PARTITION BY m.arc ORDER BY floor(('0x' || substr(h, 9, 8))::BIGINT * fine / 4294967296), h, doc_id, size, text_crc32) - 1 AS r
  FROM met m, total),
known AS (SELECT k.*, o.shard AS own, o.stays, o.base, o.over_before + k.r - o.stays AS o FROM ranked k JOIN over o ON o.arc = k.arc),
moved AS (SELECT doc_id, size, text_crc32, w.shard, w.slot + k.o - w.served AS slot FROM known k JOIN sweep w ON k.r >= k.stays AND k.o >= w.served AND k.o < w.served + w.take)
SELECT doc_id, size, text_crc32, 'rows' AS law, own::INT AS shard, base + r AS slot, NULL::INT AS grown_shard FROM known WHERE r < stays
UNION ALL SELECT doc_id, size, text_crc32, 'rows', shard::INT, slot, NULL::INT FROM moved"""

OP2 = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_spans(r) for r in secret_scan.RULES)}),
per AS (SELECT doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per p ON p.doc_id = d.doc_id"""

OP3 = f"""WITH RECURSIVE words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
top AS (SELECT d.doc_id, least(d.doc_id, min(v)) AS component_id FROM documents d LEFT JOIN reach r ON r.u = d.doc_id GROUP BY d.doc_id)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM top t LEFT JOIN sizes s ON s.doc_id = t.doc_id"""

OP4 = """WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT *, sqrt(list_dot_product(e, e)) AS r FROM good),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM normed a JOIN normed b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.98),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
top AS (SELECT u, min(v) AS m FROM reach GROUP BY u), deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings e LEFT JOIN top t ON t.u = e.vec_id LEFT JOIN deg d ON d.u = e.vec_id"""

OP6 = f"""WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('17:' || doc_id) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, 3 * source_size AS cap,
  [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM src),
levels AS (SELECT *, (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest
  FROM weighed WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
fit AS (SELECT rest, w_rest FROM levels WHERE rest * w <= cap * w_rest ORDER BY cap / w, source IS NULL, source LIMIT 1),
plan AS (SELECT source, source_size, CASE WHEN l.rest * w <= cap * l.w_rest OR l.cap / l.w > (SELECT rest / w_rest FROM fit)
    THEN (SELECT rest FROM fit)::DOUBLE * w / (SELECT w_rest FROM fit) ELSE cap::DOUBLE END AS target FROM levels l),
part AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan),
marked AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
  d.size * 50 > p.target - p.whole * p.source_size AS large
  FROM docs d JOIN part p ON d.source IS NOT DISTINCT FROM p.source),
lined AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, large ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + size / 2.0 AS mid, sum(size) OVER (PARTITION BY source, large) AS grp FROM marked),
picked AS (SELECT *, large AND mid <= part * grp / source_size AS pick FROM lined),
drawn AS (SELECT *, coalesce(sum(size) FILTER (pick) OVER (PARTITION BY source), 0) AS d FROM picked)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN pick OR (NOT large AND mid <= part - d) THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn"""

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
OP10 = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
places AS (SELECT doc_id, ws[i:i + 4] AS win, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM places) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(list_aggregate(ws, 'string_agg', ''))::BIGINT AS word_chars,
  (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(t) - len(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
  (len(t) - len(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_marks,
  len(list_filter(ws, lambda x: lower(rtrim(x, '.,!?;:')) IN ({_STOP})))::BIGINT AS n_stop,
  len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND 10 * n_symbols <= n_words
  AND 2 * n_upper <= word_chars AND 2 * n_marks <= n_words AND 2 * n_dup_lines <= n_lines AND 50 * n_stop >= n_words AS kept FROM f"""

OP11 = """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM words, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, g, any_value(m) AS m, count(*) AS n FROM grams GROUP BY lang, g),
tot AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, g, m, n AS a, string_split(g, ' ') AS w FROM f WHERE m > 1 AND n >= 30),
cuts AS (SELECT c.lang, c.g, c.a, c.k, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a) // (x.n + y.n) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.w[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS g, max(a) AS around
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand WHERE m > 2)) GROUP BY 1, 2),
kept AS (SELECT s.* FROM scored s LEFT JOIN inner_parts i ON i.lang = s.lang AND i.g = s.g WHERE i.around IS NULL OR 100 * i.around < 80 * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, t.n, score::BIGINT AS score
FROM kept k JOIN tot t ON t.lang = k.lang QUALIFY rank <= 2000"""

OP12 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
top AS (SELECT d, max(page_id) AS t FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, p.d AS payload_digest, CASE WHEN t <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN t <> page_id THEN t END AS refers_to FROM p LEFT JOIN top ON top.d = p.d AND p.b >= 1000"""

TWINS = {"op1_sharding": OP1, "op2_secret_scans": OP2, "op3_minhash": OP3, "op4_embeddings": OP4, "op6_mixing": OP6, "op10_quality_rules": OP10,
         "op11_collocations": OP11, "op12_warc": OP12}
