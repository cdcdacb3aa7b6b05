"""The corpus operators as registered queries: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qaspark.llm import alignment, bpe, chat, decontamination, fingerprints, html_extract, line_runs, minhash_dedup, prefix_trie, quality, sharding, substring_dedup, toxicity
from qaspark.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, messages = chat.from_turns(read(spark, sf_dir, "conversations"))
    return chat.with_messages(chat.link_calls(calls, results, chat.TURN_TOOLS), messages)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.frequent_lines(read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash_dedup, op3_sharding, op4_fingerprints, op5_chat_formatting, op6_html_extraction, op7_decontamination, op8_quality, op9_substring_dedup, op10_bpe, op11_prefix_trie, op12_line_dedup, op13_alignment)}
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_dedup": f"""
WITH RECURSIVE docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM docs),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (shingle) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS doc, doc_id AS comp FROM n UNION SELECT e.b, r.comp FROM r JOIN e ON r.doc = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, d.doc_id = coalesce(c.comp, d.doc_id) AS kept
FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc, min(comp) AS comp FROM r GROUP BY 1) c ON c.doc = d.doc_id
""",
    "op6_html_extraction": r"""
WITH blocks AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<br>', ' ', 'g'), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda b: b <> '') AS parts FROM pages)
SELECT page_id, url, array_to_string(parts, chr(10) || chr(10)) AS text, length(array_to_string(parts, chr(10) || chr(10))) AS n_chars FROM blocks
""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, start, md5(array_to_string(ws[start:start + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS start FROM w)),
f AS (SELECT h, min(doc_id) AS least FROM p GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, start + k AS pos FROM (SELECT p.doc_id, p.start FROM p JOIN f USING (h) WHERE p.doc_id > f.least), range(50) g(k)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w) ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k USING (doc_id)
""",
    "op5_chat_formatting": """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, CASE WHEN turn >= 2 THEN 'call_' || (turn - 2) END AS needs, text,
         CASE WHEN length(coalesce(text, '')) < 200 THEN 'lookup' ELSE 'compose' END AS name
  FROM conversations WHERE role = 'user'),
ids AS (SELECT conv_id, call_id, min(needs) AS needs, min(turn) AS turn FROM calls WHERE conv_id IS NOT NULL AND call_id IS NOT NULL GROUP BY ALL),
steps AS (
  SELECT conv_id, call_id, turn, 0 AS depth FROM ids WHERE needs IS NULL
  UNION ALL
  SELECT i.conv_id, i.call_id, i.turn, d.depth + 1 FROM ids i JOIN steps d ON i.conv_id = d.conv_id AND i.needs = d.call_id),
depths AS (SELECT conv_id, call_id, depth, row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn, call_id) - 1 AS position FROM steps),
answers AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, min({'turn': turn, 'text': text}) AS first, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.turn AS call_turn, a.first.turn AS result_turn, d.position, d.depth,
  CASE WHEN c.turn IS NULL THEN 'no_call' WHEN c.errors > 0 THEN 'invalid' WHEN d.depth IS NULL THEN 'unordered'
       WHEN a.first IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  coalesce(c.errors, 0) AS n_errors, coalesce(a.n_results, 0) AS n_results,
  '{"call":' || CASE WHEN c.turn IS NULL THEN 'null' ELSE
      '{"arguments":{"query":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || ',"turn":' || c.turn || '},"id":"' || c.call_id
      || '","name":"' || c.name || '","needs":' || coalesce('"' || c.needs || '"', 'null') || '}' END
  || ',"result":' || CASE WHEN a.first IS NULL THEN 'null' ELSE
      '{"content":' || coalesce(CAST(to_json(a.first.text) AS VARCHAR), 'null') || ',"turn":' || a.first.turn || '}' END || '}' AS json
FROM (SELECT *, CASE WHEN text IS NULL OR length(text) < 1 OR (name = 'lookup' AND length(text) > 150) THEN 1 ELSE 0 END AS errors FROM calls) c
LEFT JOIN depths d ON c.conv_id = d.conv_id AND c.call_id = d.call_id
FULL JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
UNION ALL
SELECT conv_id, NULL, turn, NULL, NULL, NULL, 'message', 0, 0,
  '{"message":{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
""",
    "op11_prefix_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END)) % 6 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, length(text) AS len, md5(length(role) || ':' || role || text) AS e FROM r),
p AS (SELECT conv_id, depth, len, md5(string_agg(e, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS id FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT id, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, max(len) AS len FROM p GROUP BY id),
up AS (SELECT n.id, q.id AS parent FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
k AS (SELECT parent AS id, count(*) AS n FROM up GROUP BY 1),
s AS (SELECT q.id, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.len) AS saved
  FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN k ON k.id = n.id GROUP BY 1),
e AS (SELECT id, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, id, depth, max(depth) OVER (PARTITION BY conv_id) AS most FROM p) x WHERE depth = most GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n LEFT JOIN up ON up.id = n.id LEFT JOIN n m ON m.id = up.parent LEFT JOIN k ON k.id = n.id JOIN s ON s.id = n.id LEFT JOIN e ON e.id = n.id
""",
    "op12_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, coalesce(doc_id::VARCHAR, '') AS doc, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10),
s AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS text FROM k ANTI JOIN f USING (key) GROUP BY r)
SELECT d.doc_id, len(d.ls)::BIGINT AS n_lines, (len(d.ls) - coalesce(s.n, 0))::BIGINT AS n_dropped, sha256(coalesce(s.text, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
""",
}
