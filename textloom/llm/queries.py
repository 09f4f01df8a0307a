"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, chat_format, conversation_repair, exact_dedup, fingerprints, line_dedup, merkle, ngram_join, packing, substring_dedup, token_store, toxicity, warc
from textloom.llm.shared import new_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, window=2048)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"), size=5, percent=80).drop("text_key", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, read(spark, sf_dir, "labels"), threshold=0.7).drop("text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.read_back(chat_format.examples(turns)))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("payload")


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-store"), end_id=0)
    return store.documents(store.keys()).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, present = conversation_repair.damaged(read(spark, sf_dir, "conversations"))
    return conversation_repair.repair(turns, present)[0]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = merkle.leaf_digest([F.col(c) if c != "text" else lowered for c in merkle.FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    found = merkle.merkle(docs.withColumn("tampered", tampered), arity=16, keep=("tampered",))
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(s: str) -> str:
    """The CRC of a text of ASCII characters, bit by bit."""
    byte = f"CASE WHEN k % 8 = 0 THEN xor(c, ord({s}[(k // 8 + 1)::INT])) ELSE c END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * len({s}))), lambda c, k: xor({byte} >> 1, CASE WHEN ({byte}) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12_SQL = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
f AS (SELECT *, {crc32_sql("name")} % 20 AS fault FROM t),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS again FROM f WHERE fault <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth,
  trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM p),
r AS (SELECT conv_id, k, turn, role, text, left(role, 1) AS c, body = '' AS blank, body <> '' AND nth > 1 AS duplicate, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prior FROM o),
e AS (SELECT * FROM (VALUES (0, 0, 3, 'D', NULL), (1, 1, 3, 'D', NULL), (2, 2, 3, 'D', NULL), (3, 3, 3, 'D', NULL), (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a'),
  (0, 2, 2, 'R', NULL), (1, 2, 2, 'R', NULL), (3, 2, 2, 'R', NULL), (2, 3, 2, 'R', NULL)) v(a, b, cost, l, c)),
i AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (3, 2, 2, 'I'), (2, 3, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')) v(a, b, cost, l)),
st AS (SELECT c.conv_id, 0::BIGINT AS k, i.b AS state, {{'cost': i.cost, 'audit': i.l}} AS best FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN i ON i.a = 0
  UNION ALL SELECT r.conv_id, r.k, i.b, min({{'cost': best.cost + e.cost + CASE WHEN truncated AND e.l <> 'D' THEN 1 ELSE 0 END + i.cost, 'audit': best.audit || e.l || i.l}})
  FROM st JOIN r ON st.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = st.k + 1 JOIN e ON e.a = st.state AND (e.c IS NULL OR e.c = r.c) AND (e.l = 'D' OR NOT blank AND NOT duplicate) JOIN i ON i.a = e.b
  GROUP BY r.conv_id, r.k, i.b),
won AS (SELECT st.conv_id, min(best) AS best FROM st LEFT JOIN (SELECT conv_id, max(k) AS n FROM r GROUP BY conv_id) n ON st.conv_id IS NOT DISTINCT FROM n.conv_id WHERE st.k = coalesce(n, 0) AND state IN (0, 3) GROUP BY st.conv_id),
letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS l, unnest(range(1, len(best.audit) + 1)) AS ix FROM won WHERE best.audit <> ''),
steps AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS k, count(*) FILTER (l <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY ix)),
said AS (SELECT s.conv_id, s.ix, s.l, s.place, r.role, r.c, CASE WHEN s.l = 'I' THEN '' ELSE r.text END AS text, max(CASE WHEN s.place = 1 AND s.l = 'K' AND r.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS shift
  FROM steps s LEFT JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.k = r.k AND s.l <> 'I' WHERE s.l <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY ix) AS repaired FROM said GROUP BY conv_id),
totals AS (SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (prior || c NOT IN ('su', 'ua', 'au')) AS illegal,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM won w LEFT JOIN totals t ON w.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN lines l ON w.conv_id IS NOT DISTINCT FROM l.conv_id
"""

OP13_SQL = f"""
WITH RECURSIVE crcs AS (SELECT *, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS crc FROM documents),
leaves AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS tree, {leaf_sql("text")} AS leaf,
  CASE WHEN crc % 5 = 0 THEN {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf_sql("text")} END AS tampered FROM crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16, n),
kids AS (SELECT tree, level, pos // 16 AS parent, list(digest ORDER BY pos) AS own FROM up WHERE n > 1 GROUP BY ALL),
subs AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
tops AS (SELECT 0 AS level, pos, n, digest FROM subs
  UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16, n),
heads AS (SELECT level, pos // 16 AS parent, list(digest ORDER BY pos) AS own FROM tops WHERE n > 1 GROUP BY ALL),
climb AS (SELECT row, tree, 0 AS level, pos, n, '' AS proof, tampered AS fold FROM placed
  UNION ALL SELECT c.row, c.tree, c.level + 1, c.pos // 16, (c.n + 15) // 16,
    c.proof || list_aggregate(own[:c.pos % 16] || own[c.pos % 16 + 2:] || [''], 'string_agg', ''),
    sha256(list_aggregate(own[:c.pos % 16] || [fold] || own[c.pos % 16 + 2:], 'string_agg', ''))
  FROM climb c JOIN kids k ON c.tree = k.tree AND c.level = k.level AND c.pos // 16 = k.parent WHERE c.n > 1),
higher AS (SELECT c.row, 0 AS level, s.pos, s.n, proof, fold FROM climb c JOIN subs s ON c.tree = s.tree WHERE c.n = 1
  UNION ALL SELECT c.row, c.level + 1, c.pos // 16, (c.n + 15) // 16,
    c.proof || list_aggregate(own[:c.pos % 16] || own[c.pos % 16 + 2:] || [''], 'string_agg', ''),
    sha256(list_aggregate(own[:c.pos % 16] || [fold] || own[c.pos % 16 + 2:], 'string_agg', ''))
  FROM higher c JOIN heads k ON c.level = k.level AND c.pos // 16 = k.parent WHERE c.n > 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(h.proof) AS proof_sha256, h.fold AS folded_root, h.fold = t.digest AS verified
FROM placed p JOIN subs s ON p.tree = s.tree JOIN higher h ON p.row = h.row AND h.n = 1 JOIN tops t ON t.n = 1
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""

OP9_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

OP8_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
flagged AS (SELECT k.*, coalesce(h.owner <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'),
  '<|turn|>', '&lt;|turn|>'), '<|end|>', '&lt;|end|>'), '<|im_start|>', '&lt;|im_start|>'), '<|im_end|>', '&lt;|im_end|>'), '<|endoftext|>', '&lt;|endoftext|>'),
  '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]'), '<<SYS>>', '&lt;<SYS>>'), '<</SYS>>', '&lt;</SYS>>'))
  + len(role) + 16 AS size FROM t),
c AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup, "op2_packing": op2_packing, "op3_ngram_join": op3_ngram_join, "op4_toxicity": op4_toxicity, "op5_bpe": op5_bpe, "op6_chat_format": op6_chat_format,
    "op7_fingerprints": op7_fingerprints, "op8_line_dedup": op8_line_dedup, "op9_exact_dedup": op9_exact_dedup, "op10_warc": op10_warc, "op11_token_store": op11_token_store, "op12_conversation_repair": op12_conversation_repair, "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {"op6_chat_format": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op10_warc": OP10_SQL, "op12_conversation_repair": OP12_SQL, "op13_merkle": OP13_SQL}
