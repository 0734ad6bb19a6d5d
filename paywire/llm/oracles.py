"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fit(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_SECOND = r"^(ac|asn|co|com|ed|edu|go|gob|gouv|gov|gv|id|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch)\.[a-z]{2}$"
_ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"


def _last(n: int) -> str:
    return f"array_to_string(string_split(site, '.')[-{n}:], '.')"


def _moments(name: str, level: str) -> str:
    return f"""{name} AS (
  SELECT coalesce(m, 0) AS m, coalesce(least(greatest(m * (1 - m) / greatest(sq / n - m * m - m * (1 - m) * k / n, 1e-9) - 1, 1.0), 1000.0), 1.0) AS s
  FROM (SELECT sum(bad)::DOUBLE / nullif(sum(n), 0) AS m, sum(n)::DOUBLE AS n, count(*) AS k, sum(n * (bad / n) * (bad / n)) AS sq FROM {level} WHERE n > 0))"""


ORACLE_SQL["op2_url_reputation"] = f"""
WITH seen AS (
  SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
outcomes AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
sites AS (
  SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS site, n, bad
  FROM (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM seen LEFT JOIN outcomes USING (page_id) GROUP BY host)),
hosts AS (
  SELECT host, n, bad,
         CASE WHEN regexp_matches(site, '{_ADDRESS}') THEN site WHEN regexp_matches({_last(2)}, '{_SECOND}') THEN {_last(3)} ELSE {_last(2)} END AS domain,
         CASE WHEN regexp_matches(site, '{_ADDRESS}') THEN '#' WHEN regexp_matches({_last(2)}, '{_SECOND}') THEN {_last(2)} ELSE {_last(1)} END AS suffix
  FROM sites),
domains AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY ALL),
{_moments("ms", "suffixes")}, {_moments("md", "domains")}, {_moments("mh", "hosts")},
up1 AS (SELECT suffix, (bad + s * m) / (n + s) AS m1, (n + s) / (n + s + 1) AS k1 FROM suffixes, ms),
up2 AS (SELECT suffix, domain, (bad + s * m1) / (n + s) AS m2, CASE WHEN n > 0 THEN (n + s) / (n + s + 1) ELSE k1 * s / (s + 1) END AS k2 FROM domains JOIN up1 USING (suffix), md),
post AS (SELECT host, n, (bad + s * m2) / (n + s) AS p, CASE WHEN n > 0 THEN (n + s) / (n + s + 1) ELSE k2 * s / (s + 1) END AS k FROM hosts JOIN up2 USING (suffix, domain), mh),
judged AS (SELECT host, n, p - 1.645 * sqrt(p * (1 - p) * (1 - k)) > 0.2 AS bad FROM post)
SELECT page_id, host, path,
  CASE WHEN {_fit("example.com", "/en/7")} THEN 'example.com/en/7' WHEN {_fit("example.net", "/de/8")} THEN 'example.net/de/8'
       WHEN {_fit("com", "/en/")} THEN 'com/en/' WHEN {_fit("net", "/de/")} THEN 'net/de/' WHEN {_fit("org", "/es/")} THEN 'org/es/' END AS rule,
  CASE WHEN {_fit("example.com", "/en/7")} THEN 'allow' WHEN {_fit("example.net", "/de/8")} THEN 'block'
       WHEN {_fit("com", "/en/")} THEN 'block' WHEN {_fit("net", "/de/")} THEN 'allow' WHEN {_fit("org", "/es/")} THEN 'block'
       WHEN bad THEN 'block' ELSE 'allow' END AS verdict,
  n AS n_labelled
FROM seen JOIN judged USING (host)
"""

_W4 = _LOWER.format("text")
_WORD4 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL["op4_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_W4}, {_WORD4}) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_W4}, {_WORD4}) AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT l FROM phrases),
windows AS (
  SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS p
  FROM (SELECT r, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, lengths WHERE len(w) >= l)),
found AS (SELECT r, i, windows.l, item_id FROM windows JOIN phrases ON windows.l = phrases.l AND windows.p = phrases.p),
hit AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(generate_series(i, i + l - 1)) AS k FROM (SELECT DISTINCT r, i, l FROM found)) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM found) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE_SQL["op8_exact_dedup"] = f"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256({_NORM}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {_NORM})
"""

ORACLE_SQL["op9_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_W4}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT a AS v, b AS r FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.r, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m.r, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(r) AS r FROM reach GROUP BY v) m USING (doc_id)
"""

ORACLE_SQL["op6_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (SELECT *, replace(replace(replace(text, '\', '\\'), '[', '\['), '<', '\<') AS e FROM rows)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('[INST:') + length(role) + 2 + length(e) + length('[/INST]</s>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

ORACLE_SQL["op12_knn_join"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r AS qr, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.r <> x.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM pairs)
WHERE rank <= 10
"""


def _marked(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*map(_marked, ("doc_id", "source", "lang", "n_chars")), f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"]) + ")"


#: crc32 by its bits, as DuckDB has no such function: a character of the decimal id a round.
_CRC = """crc AS (
  SELECT r, doc_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS c FROM d WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, s, i + 1, xor(c >> 8, list_reduce(list_prepend(xor(c & 255, ascii(s[i + 1])::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))
  FROM crc WHERE i < length(s))"""

ORACLE_SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, * FROM documents),
{_CRC},
leaves AS (
  SELECT d.r, d.doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN xor(c, 4294967295) % 3 = 0 THEN {_leaf(_LOWER.format("text"))} END AS other
  FROM d LEFT JOIN crc ON crc.r = d.r AND crc.i = length(crc.s)),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level, pos, h, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, any_value(level) + 1 AS level, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM nodes WHERE n > 1 GROUP BY tree, pos // 8)),
roots AS (SELECT tree, level AS height, h AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, tree AS pos, subroot AS h, count(*) OVER () AS n FROM roots
  UNION ALL
  SELECT level, pos, h, count(*) OVER () FROM (SELECT any_value(level) + 1 AS level, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM tops WHERE n > 1 GROUP BY pos // 8)),
every AS (
  SELECT tree, level, pos, h FROM nodes WHERE n > 1
  UNION ALL SELECT r.tree, r.height + t.level, t.pos, t.h FROM roots r, tops t WHERE t.n > 1),
steps AS (
  SELECT p.r, p.tree, 0 AS level, p.pos, coalesce(p.other, p.leaf) AS h, '' AS beside, roots.height FROM placed p JOIN roots USING (tree)
  UNION ALL
  SELECT r, tree, level + 1, any_value(pos) // 8, sha256(string_agg(CASE WHEN x = pos THEN h ELSE xh END, '' ORDER BY x)),
         any_value(beside) || coalesce(string_agg(xh, '' ORDER BY x) FILTER (x <> pos), ''), any_value(height)
  FROM (SELECT s.r, s.tree, s.level, CASE WHEN s.level = s.height THEN s.tree ELSE s.pos END AS pos, s.h, s.beside, s.height, a.pos AS x, a.h AS xh
        FROM steps s JOIN every a ON a.tree = s.tree AND a.level = s.level AND a.pos // 8 = (CASE WHEN s.level = s.height THEN s.tree ELSE s.pos END) // 8)
  GROUP BY r, tree, level),
folded AS (SELECT r, arg_max(h, level) AS folded_root, arg_max(beside, level) AS beside FROM steps GROUP BY r),
whole AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN roots USING (tree) JOIN folded USING (r), whole
"""
