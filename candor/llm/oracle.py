"""The same rows in SQL for DuckDB, for the operators SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORDS = r"len(regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+'))"

# Windows of 3 lines or 50 words, whichever comes first; a window seen before is deleted.
ORACLE["op2_line_dedup"] = rf"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM split
), wordy AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r,
         sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM (SELECT *, {_WORDS.format("line")} AS words FROM numbered) WHERE words > 0
), ends AS (
  SELECT a.doc_id, a.i, a.r, min(b.r) AS last_r
  FROM wordy a JOIN wordy b
    ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + 2
   AND (b.r = a.r + 2 OR b.upto - a.upto + a.words >= 50)
  GROUP BY ALL
), windows AS (
  SELECT e.doc_id, e.i, e.r, e.last_r, max(w.i) AS last_i, string_agg(w.line, chr(10) ORDER BY w.r) AS content
  FROM ends e JOIN wordy w ON w.doc_id = e.doc_id AND w.r BETWEEN e.r AND e.last_r
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER place AS nth, first_value(doc_id) OVER place AS doc_1,
         first_value(last_i) OVER place AS last_1
  FROM windows WINDOW place AS (PARTITION BY content ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT w.doc_id, w.i, w.r
  FROM ranked x JOIN wordy w ON w.doc_id = x.doc_id AND w.r BETWEEN x.r AND x.last_r
  WHERE x.nth > 1 AND NOT (x.doc_id = x.doc_1 AND x.i <= x.last_1)
), islands AS (
  SELECT doc_id, min(i) AS first, max(i) AS last
  FROM (SELECT *, r - row_number() OVER (PARTITION BY doc_id ORDER BY r) AS island FROM gone)
  GROUP BY doc_id, island
), runs AS (
  SELECT doc_id, string_agg(first || '-' || last, ',' ORDER BY first) AS removed
  FROM islands GROUP BY doc_id
), kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) AS clean
  FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i
  GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(r.removed, '') AS removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.clean, '') END AS clean_text
FROM documents d LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

# Water-filling of targets, then documents in the order of u ** (1 / w).
ORACLE["op4_mix"] = rf"""
WITH docs AS (
  SELECT doc_id, source, {_WORDS.format("text")}::BIGINT AS size,
         length(coalesce(text, '')) AS chars,
         length(translate(coalesce(text, ''), '#*$%&|<>!{{}}[]=~^_', '')) AS plain,
         ('0x' || substr(md5('23:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents
), weighed AS (
  SELECT *, CASE WHEN chars = 0 THEN 4
                 ELSE greatest(16 - floor(16 * 4 * (chars - plain) / chars), 4) END AS steps
  FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM docs GROUP BY source
), capped AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight, 3 * source_size AS cap
  FROM sources
), levels AS (
  SELECT *, cap / weight AS per_weight,
         sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM capped
  WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT * FROM levels WHERE rest * weight <= cap * weights ORDER BY per_weight, place LIMIT 1
), targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN (s.per_weight, s.place) >= (l.per_weight, l.place)
              THEN least(l.rest::DOUBLE * s.weight / l.weights::DOUBLE, s.cap::DOUBLE)
              ELSE s.cap::DOUBLE END AS target
  FROM levels s LEFT JOIN level l ON true
), summed AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::INT ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (
           PARTITION BY d.source ORDER BY 1 - pow((d.draw + 0.5::DOUBLE) / pow(2::DOUBLE, 60), 4::DOUBLE / d.steps), d.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM weighed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND earlier + size / 2 < target - epochs * source_size
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

ORACLE["op7_url_verdicts"] = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule, host_part, path_part, says) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), matched AS (
  SELECT p.*, r.rule, r.says,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS nth
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host_part OR ends_with(p.host, '.' || r.host_part))
   AND starts_with(p.path, r.path_part)
), listed AS (
  SELECT DISTINCT host || path AS key FROM parts
  WHERE regexp_matches(host, '(^|\.)(spam-farm|adult-x|free-bets)\.')
)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
       host || path IN (SELECT key FROM listed) AS listed
FROM matched WHERE nth = 1
"""


# CRC-32 bit by bit: a byte is taken in with the first of eight steps.
_CRC32 = """(xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
  range(1, length({0}) + 1), lambda i: [ascii(substr({0}, i, 1)), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))))"""

# Prefixes are named by a hash of the turns so far; a subtree's nodes are those whose smallest
# conversation passes through its top.
ORACLE["op13_prefix_trie"] = rf"""
WITH ordered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, count(*) AS n, {_CRC32.format("c::VARCHAR")} % 4 AS h FROM ordered GROUP BY c
), shares AS (
  SELECT v.c, v.h, v.c - v.c % 20 AS base, least(v.h, coalesce(b.n, 0)) AS taken
  FROM convs v LEFT JOIN convs b ON b.c = v.c - v.c % 20
), rebuilt AS (
  SELECT s.c, t.i, t.role, t.text FROM shares s JOIN ordered t ON t.c = s.base AND t.i <= s.h
  UNION ALL
  SELECT s.c, t.i - s.h + s.taken, t.role, t.text FROM shares s JOIN ordered t ON t.c = s.c AND t.i > s.h
), paths AS (
  SELECT c, i AS depth, {_WORDS.format("text")} AS words,
         sha256(string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY i)
                OVER (PARTITION BY c ORDER BY i)) AS id
  FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs
), linked AS (
  SELECT *, lag(id) OVER (PARTITION BY c ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY c) AS is_end
  FROM paths
), nodes AS (
  SELECT id, min(c) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs,
         any_value(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end) AS ends
  FROM linked GROUP BY id
), children AS (
  SELECT parent AS id, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT p.id, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved
  FROM nodes v JOIN paths p ON p.c = v.conv_id AND p.depth <= v.depth LEFT JOIN children k ON k.id = v.id
  GROUP BY p.id
)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN subtrees s USING (id) LEFT JOIN children k USING (id) LEFT JOIN nodes u ON u.id = v.parent
"""
