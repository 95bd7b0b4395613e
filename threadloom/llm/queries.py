"""The registered query of each operator, with production parameters over its whole table, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, brown, chat, decontaminate, exact_dedup, filter_audit, line_dedup, merkle, near_dedup, sharding, suffix_dedup, token_counts, toxicity
from threadloom.llm.common import fold_ascii, table

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE_SQL["op2_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown' ELSE role END AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (SELECT DISTINCT conv_id AS of_conv, speaker AS participant FROM said WHERE speaker <> 'system'), each AS (
  SELECT conv_id, participant, turn, speaker, text, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user' END AS role
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM of_conv
), headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head FROM each
), placed AS (
  SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS piece,
         coalesce(sum(length(head || text || chr(10) || '<|end|>' || chr(10))) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM headed
)
SELECT conv_id, participant, turn, speaker, role, name, piece, role = 'assistant' AS train, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS stop FROM placed
"""


@query
def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda doc_id: toxicity.remainder(doc_id, 5) == 1
    model = brown.fit(docs.filter(~held_out(F.col("doc_id"))))
    out = brown.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True, drop_text=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, unnest(generate_series(1, len(ls))) AS g(i)
), common AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common ON lines.k = common.k GROUP BY doc_id
"""


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    out = sharding.shard(slim)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.report(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL["op8_decontaminate"] = r"""
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), items AS (
  SELECT DISTINCT id AS item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
  FROM folded, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS g(i) WHERE kind = 'b' AND len(ws) > 0
), docs AS (
  SELECT id AS doc_id, n.n, i, array_to_string(ws[i:i + n.n - 1], ' ') AS w
  FROM folded, (SELECT DISTINCT n FROM items) AS n, unnest(generate_series(1, len(ws) - n.n + 1)) AS g(i) WHERE kind = 'd'
), hit AS (
  SELECT doc_id, item_id, i, docs.n FROM docs JOIN items ON docs.n = items.n AND docs.w = items.w
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS g(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id
)
SELECT f.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN covered ON f.id = covered.doc_id LEFT JOIN named ON f.id = named.doc_id WHERE kind = 'd'
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(toxicity.remainder(F.col("doc_id"), 4) != 2))
    slim = docs.withColumn("held_out", toxicity.remainder(F.col("doc_id"), 4) == 2)
    out = toxicity.score(slim, model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL["op10_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=1024)


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op13_filter_audit"] = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), labelled AS (
  SELECT doc_id AS id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM said LEFT JOIN labelled ON doc_id = id
), counts AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter), orders AS (
  SELECT letter AS o FROM letters
  UNION ALL
  SELECT o || letter FROM orders, letters WHERE NOT contains(o, letter)
), steps AS (
  SELECT o AS filter_order, i AS step, o[i] AS letter, o[1:i - 1] AS earlier FROM orders, unnest(generate_series(1, 5)) AS g(i) WHERE length(o) = 5
), each AS (
  SELECT part, filter_order, step, letter, n, good, toxic, length(fails) AS width, contains(fails, letter) AS fail, translate(fails, earlier, '') <> fails AS gone
  FROM counts, steps
), summed AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant, coalesce(sum(n) FILTER (fail AND width = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fields(fold_ascii(F.col("text"))))
    out = merkle.manifest(docs.select("doc_id", "lang", fields(F.col("text")).alias("leaf"), tampered.alias("tampered")))
    folded = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE_SQL["op11_merkle_manifest"] = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab FROM range(256) AS r(b)
), said AS (
  SELECT row_number() OVER () AS id, coalesce('=' || lang, '') AS g, doc_id,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])) AS crc,
         list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda a, b: a || b) AS head, text
  FROM documents, bits
), leaves AS (
  SELECT id, g, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM said
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM leaves
), up AS (
  SELECT 0 AS level, g, spot, leaf AS node FROM placed
  UNION ALL
  SELECT level + 1, g, spot // 8, sha256(string_agg(node, '' ORDER BY spot)) FROM up WHERE g IN (SELECT g FROM up GROUP BY g HAVING count(*) > 1) GROUP BY level, g, spot // 8
), tops AS (
  SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS spot FROM (SELECT g, arg_max(node, level) AS node FROM up GROUP BY g)
), higher AS (
  SELECT 0 AS level, spot, subroot AS node FROM tops
  UNION ALL
  SELECT level + 1, spot // 8, sha256(string_agg(node, '' ORDER BY spot)) FROM higher WHERE (SELECT count(*) FROM higher) > 1 GROUP BY level, spot // 8
), steps AS (
  SELECT id, u.level, string_agg(CASE WHEN u.spot < p.spot // CAST(pow(8, u.level) AS BIGINT) THEN u.node END, '' ORDER BY u.spot) AS before,
         string_agg(CASE WHEN u.spot > p.spot // CAST(pow(8, u.level) AS BIGINT) THEN u.node END, '' ORDER BY u.spot) AS after
  FROM placed p JOIN up u ON p.g = u.g AND u.spot // 8 = p.spot // CAST(pow(8, u.level + 1) AS BIGINT) WHERE u.level < (SELECT max(level) FROM up x WHERE x.g = p.g) GROUP BY id, u.level
  UNION ALL
  SELECT id, 100 + h.level, string_agg(CASE WHEN h.spot < t.spot // CAST(pow(8, h.level) AS BIGINT) THEN h.node END, '' ORDER BY h.spot),
         string_agg(CASE WHEN h.spot > t.spot // CAST(pow(8, h.level) AS BIGINT) THEN h.node END, '' ORDER BY h.spot)
  FROM placed p JOIN tops t ON p.g = t.g JOIN higher h ON h.spot // 8 = t.spot // CAST(pow(8, h.level + 1) AS BIGINT) WHERE h.level < (SELECT max(level) FROM higher) GROUP BY id, h.level
), proofs AS (
  SELECT id, list({'b': coalesce(before, ''), 'a': coalesce(after, '')} ORDER BY level) AS proof FROM steps GROUP BY id
), folded AS (
  SELECT p.*, subroot, coalesce(proof, []) AS proof,
         list_reduce(list_prepend({'b': coalesce(tampered, leaf), 'a': ''}, coalesce(proof, [])), lambda x, y: {'b': sha256(y.b || x.b || y.a), 'a': ''}).b AS folded_root,
         (SELECT arg_max(node, level) FROM higher) AS root
  FROM placed p JOIN tops USING (g) LEFT JOIN proofs USING (id)
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(proof, lambda x: x.b || x.a), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
