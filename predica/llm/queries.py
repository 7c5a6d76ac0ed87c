"""The queries of this subpackage, each over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, license_scan, media, packing, simhash, source_mix, suffix_dedup, toxicity, url_rules
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digest(spark, table(spark, sf_dir, "conversations"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM again),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT p.doc_id, string_agg(substring(h, 2 * s + 1, CASE WHEN e IS NULL THEN length(h) ELSE 2 * (e - s) END), '' ORDER BY s) AS k FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
counts AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN counts ON counts.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP2_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT AS spread FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s GROUP BY source),
wts AS (SELECT *, (sid - 1) % 3 + 1 AS weight, (SELECT sum(source_size)::BIGINT FROM src) AS total, 3 * source_size AS cap FROM src),
filled AS (SELECT *, cap::DOUBLE * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= weight::DOUBLE * (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f
  FROM wts WINDOW o AS (ORDER BY source_size::DOUBLE / weight, sid)),
targets AS (SELECT sid, source, source_size, total, CASE WHEN f THEN cap::DOUBLE ELSE weight::DOUBLE * (total - (SELECT coalesce(sum(cap), 0) FROM filled WHERE f))::DOUBLE / (SELECT sum(weight) FROM filled WHERE NOT f)::DOUBLE END AS target FROM filled),
size AS (SELECT greatest(1, least(1024, max(total) // 131072)) AS block, max(total) AS total FROM targets),
plan AS (SELECT block, (total + block - 1) // block AS slots, length(bin((total + block - 1) // block - 1)) AS bits FROM size),
points AS (SELECT slot, list_sum(list_transform(range(bits), lambda k: ((slot >> k) & 1) << (bits - 1 - k)))::DOUBLE / (1::BIGINT << bits)::DOUBLE AS point FROM (SELECT unnest(range(slots)) AS slot, bits FROM plan)),
ranges AS (SELECT sid, source_size, (upto - target) / whole AS low, CASE WHEN sid = max(sid) OVER () THEN 2.0 ELSE upto / whole END AS high
  FROM (SELECT *, sum(target) OVER (ORDER BY sid) AS upto, sum(target) OVER () AS whole FROM targets) WHERE target > 0),
ranked AS (SELECT sid, source_size, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM points JOIN ranges ON point >= low AND point < high),
numbered AS (SELECT sid, rank % ((source_size + block - 1) // block) AS b, rank // ((source_size + block - 1) // block) AS epoch FROM ranked, plan),
read AS (SELECT sid, b, count(*) AS times FROM numbered WHERE epoch < 3 GROUP BY sid, b),
placed AS (SELECT doc_id, s.size, sid, t.source_size, target, (sum(s.size) OVER (PARTITION BY sid ORDER BY spread, doc_id) - s.size)::BIGINT AS start FROM s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source),
spans AS (SELECT doc_id, sid, p.size, start, block, unnest(range(start // block, (start + p.size - 1) // block + 1)) AS b FROM placed p, plan WHERE p.size > 0),
taken AS (SELECT doc_id, sum((least(start + size, (spans.b + 1) * block) - greatest(start, spans.b * block)) * times)::BIGINT AS taken FROM spans JOIN read ON read.sid = spans.sid AND read.b = spans.b GROUP BY doc_id)
SELECT p.doc_id, p.size, source_size, target, coalesce(taken, 0) AS taken FROM placed p LEFT JOIN taken ON taken.doc_id = p.doc_id
"""

OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) + 24 AS written FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(written)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_source_mix, op3_url_rules, op4_pack, op5_license_scan, op6_chat_format, op7_exact_dedup, op8_simhash, op9_toxicity, op10_media)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_source_mix": OP2_SQL, "op6_chat_format": OP6_SQL, "op7_exact_dedup": OP7_SQL}
