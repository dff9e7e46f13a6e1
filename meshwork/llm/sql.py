"""DuckDB SQL for the queries that SQL can express. Views of the tables' names stand for the Parquet files."""

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {BLANKS}), {UPPER}, {LOWER}) AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
),
frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (k)
GROUP BY doc_id
"""

EXACT_DEDUP = f"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(translate(coalesce(text, ''), {BLANKS}, '')) AS text_sha256
  FROM documents
),
ranked AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM docs
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""

JACCARD_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id)
GROUP BY d.doc_id
"""

DECONTAMINATION = """
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
),
words AS (
  SELECT kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM texts
),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)
),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'b' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles b ON d.s = b.s WHERE d.kind = 'd' AND b.kind = 'b' GROUP BY 1, 2
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes ON id = item_id WHERE n_shared * 100 >= n_item * 80
"""


_URL = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
URL_FILTER = f"""
WITH rules(rule_host, rule_path, rule, rule_verdict) AS (
  VALUES ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'block'),
    ('example.net', '/de/8', 'example.net/de/8', 'allow'), ('org', '/es/', 'org/es/', 'block')
),
seen AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, {_URL}, 1), ''), {UPPER}, {LOWER}) AS host, coalesce(regexp_extract(url, {_URL}, 2), '') AS path
  FROM pages
),
judged AS MATERIALIZED (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM seen LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
),
hosts AS (
  SELECT host, count(*) FILTER (WHERE rule_verdict = 'allow') AS allowed, count(*) FILTER (WHERE rule_verdict = 'block') AS blocked FROM judged GROUP BY 1
),
-- the pages hold no absolute links, so trust and distrust stay with the seeds
bad AS (
  SELECT host FROM hosts WHERE blocked > 0 AND blocked / (SELECT sum(blocked) FROM hosts) > 0.5 * (allowed / (SELECT greatest(sum(allowed), 1) FROM hosts) + blocked / (SELECT sum(blocked) FROM hosts))
)
SELECT page_id, j.host, path, rule, coalesce(rule_verdict, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM judged j LEFT JOIN bad USING (host)
"""

#: Trust and distrust on the links that linked_pages makes, as 150 rounds of walks from the seeds; a walk of that length brings next to nothing.
URL_PROPAGATION = """
WITH RECURSIVE pages_ AS (SELECT o_orderkey AS page_id, o_custkey % 200 AS i, (o_custkey * 7 + o_orderkey) % 200 AS j FROM orders),
ways AS MATERIALIZED (
  SELECT 'trust' AS kind, i AS src, j AS dst, count(*) AS w FROM pages_ WHERE i <> j GROUP BY ALL
  UNION ALL SELECT 'distrust', j, i, count(*) FROM pages_ WHERE i <> j GROUP BY ALL
),
shares AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS share FROM ways),
walk AS (
  SELECT kind, i AS host, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS mass, 0 AS n
  FROM (SELECT CASE WHEN i < 5 THEN 'distrust' ELSE 'trust' END AS kind, i FROM pages_ WHERE i < 10) GROUP BY 1, 2
  UNION ALL
  SELECT kind, dst, 0.85 * sum(mass * share), n + 1 FROM walk JOIN shares USING (kind) WHERE host = src AND n < 150 GROUP BY kind, dst, n
),
ranks AS (SELECT kind, host, sum(mass) / sum(sum(mass)) OVER (PARTITION BY kind) AS mass FROM walk GROUP BY 1, 2),
bad AS (
  SELECT host FROM ranks GROUP BY host
  HAVING coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) > 0.5 * sum(mass)
)
SELECT page_id, 'c' || i || CASE WHEN i < 5 THEN '.com' WHEN i < 10 THEN '.example.com' ELSE '.info' END AS host, '/en/7' AS path,
  CASE WHEN i < 5 THEN 'com/en/' WHEN i < 10 THEN 'example.com/en/7' END AS rule,
  CASE WHEN i < 5 THEN 'block' WHEN i < 10 THEN 'allow' WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END AS verdict
FROM pages_ LEFT JOIN bad ON host = i
"""

_CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|unk>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def _escaped_length(text: str) -> str:
    return f"length(regexp_replace({text}, '{_CONTROL}', '\\1\\\\\\2\\3', 'g'))"


CHAT_FORMAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
grouped AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum({_escaped_length("role")} + {_escaped_length("text")} + length('<|im_start|><|im_sep|><|im_end|>')) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM grouped
"""
