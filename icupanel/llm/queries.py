"""The operators' queries over the test tables, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icupanel.llm import alignment, chat, decontaminate, licenses, lines, merkle, mixing, quality, secrets, sharding, simhash, tokens, topk
from icupanel.llm.common import table

SHARDS = 40


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.near_lines(table(spark, sf_dir, "documents"))


def op10_topk_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    n = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.BASE)]
    return found.select("doc_id", *n, F.sha2(secrets.shown(base), 256).alias("base_sha256"), secrets.shown(F.col("spans")).alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = merkle.leaf_digest([lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    proved = merkle.manifest(docs, {"tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered)})
    siblings = F.array_join(F.transform(F.arrays_zip("left", "right"), lambda s: F.concat(s["left"], s["right"])), "")
    out = proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), F.col("left"), F.col("right")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers

    place = public_tokenizers.path
    return alignment.alignment(table(spark, sf_dir, "documents"), a_path or place("byte_bpe_50k.json"), b_path or place("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_rotation, op2_license_scan, op3_quality_gam, op4_poisson_mix, op5_token_counts, op6_histogram_shards, op7_simhash_gph, op8_decontaminate, op9_fuzzy_lines,
        op10_topk_impact, op11_secret_links, op12_merkle_manifest, op13_token_alignment)}


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = {
    "op1_chat_rotation": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker <> 'system'
), named AS (
  SELECT conv_id, perspective, turn, speaker, text,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM c
), headed AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN speaker END AS name,
         '<|start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM named
), rendered AS (
  SELECT *, head || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, perspective, position, turn, speaker, chat_role, name, segment,
       stop - length(segment) AS "start", stop,
       CASE WHEN chat_role = 'assistant' THEN stop - length(segment) + length(head) END AS loss_start,
       CASE WHEN chat_role = 'assistant' THEN stop - 1 END AS loss_stop
FROM placed""",
    "op4_poisson_mix": """
WITH RECURSIVE sizes AS (
  SELECT source AS s, sum(coalesce(strlen(text), 0))::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
  SELECT s, CASE WHEN size > 0 THEN (sum(size) OVER ()) * (pow(size, 0.5) / sum(CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END) OVER ()) / size ELSE 1.0 END AS mean FROM sizes
), cdf AS (
  SELECT s, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rates
  UNION ALL
  SELECT s, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < mean + 12 * sqrt(mean) + 23
), drawn AS (
  SELECT *, CAST('0x' || substr(md5('17|1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(count(cdf.k) AS INTEGER) AS n_copies
  FROM drawn d LEFT JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.s AND cdf.c <= d.u GROUP BY ALL
), copies AS (
  SELECT *, CAST(unnest(range(n_copies)) AS INTEGER) AS copy_no FROM counted
)
SELECT *, CAST('0x' || substr(md5('order17|' || copy_no || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS shuffle_key FROM copies""",
    "op6_histogram_shards": """
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS step FROM steps WHERE k = 8
), keyed AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 16 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS stop, sum(size) OVER () AS total FROM keyed
), placed AS (
  SELECT *, CAST(((2 * stop - size) * 40) // (2 * total) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, 
       xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
           lambda a, b: xor(a // 256, step[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, crc""",
    "op10_topk_impact": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5""",
    "op11_secret_links": f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), matches AS (
  {" UNION ALL ".join(f"SELECT row, {k} AS kind, regexp_extract_all(text, '{_sql(p)}') AS whole, regexp_extract_all(text, '{_sql(p)}', {g}) AS body, regexp_split_to_array(text, '{_sql(p)}') AS gap FROM texts" for k, (p, g) in enumerate([*secrets.PATTERNS.values(), (secrets.BREAK, 0)]))}
), each AS (
  SELECT row, kind, unnest(range(1, len(whole) + 1)) AS n, unnest(whole) AS whole, unnest(body) AS body, unnest(gap[: len(whole)]) AS gap FROM matches WHERE len(whole) > 0
), placed AS (
  SELECT row, kind, stop - length(whole) AS start, stop FROM (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY row, kind ORDER BY n) AS stop FROM each)
  WHERE CASE kind WHEN 0 THEN length(body) >= 6 WHEN 3 THEN length(body) >= 3 WHEN 4 THEN regexp_matches(body, '[0-9]') AND regexp_matches(body, '[a-z]') AND regexp_matches(body, '[A-Z]') ELSE true END
), scoped AS (
  SELECT *, count(*) FILTER (WHERE kind = 6) OVER (PARTITION BY row ORDER BY start, kind, stop) AS scope FROM placed
), near AS (
  SELECT p.row, p.kind, p.start, p.stop, coalesce(bool_or(q.kind < 3 AND q.start < p.stop AND p.start < q.stop), false) AS inside,
         coalesce(bool_or(close AND q.kind IN (1, 3)), false) AS names, coalesce(bool_or(close AND q.kind IN (0, 2, 4)), false) AS keys, coalesce(bool_or(close AND q.kind = 5), false) AS places
  FROM (SELECT p, q, q.start - p.stop <= 200 AND p.start - q.stop <= 200 AS close FROM scoped p LEFT JOIN scoped q ON p.row = q.row AND p.scope = q.scope AND q.kind < 6 AND (p.start, p.kind, p.stop) <> (q.start, q.kind, q.stop) WHERE p.kind < 6)
  GROUP BY ALL
), kept AS (
  SELECT * FROM near WHERE kind < 3 OR (NOT inside AND CASE kind WHEN 3 THEN keys WHEN 4 THEN names OR places ELSE names AND keys END)
), shown AS (
  SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'identifier', 'secret', 'endpoint'][kind + 1] || ':' || start || ':' || stop AS span FROM kept) GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN shown USING (row)""",
    "op12_merkle_manifest": """
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS step FROM steps WHERE k = 8
), texts AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a // 256, step[xor(a, b) % 256 + 1])), 4294967295) % 5 = 0 AS tamper
  FROM documents, crc
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tamper THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM texts
), rows AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS gid,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), up AS (
  SELECT 0 AS level, gid, place, CAST(leaf AS VARCHAR) AS digest, count(*) OVER (PARTITION BY gid) AS n FROM rows
  UNION ALL
  SELECT level + 1, gid, place // 16, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 15) // 16) FROM up WHERE n > 1 GROUP BY level, gid, place // 16
), over AS (
  SELECT 0 AS level, gid AS place, digest, count(*) OVER () AS n FROM up WHERE n = 1
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 15) // 16) FROM over WHERE n > 1 GROUP BY level, place // 16
), runs AS (
  SELECT 0 AS tree, level, gid, place // 16 AS run, list(digest ORDER BY place) AS own FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 1, level, 0, place // 16, list(digest ORDER BY place) FROM over WHERE n > 1 GROUP BY ALL
), paths AS (
  SELECT row, tree, level, own[1 : spot % 16] AS l, own[spot % 16 + 2 : 16] AS r
  FROM (SELECT row, r.tree, r.level, own, run, CASE WHEN r.tree = 0 THEN place ELSE rows.gid END // CAST(pow(16, r.level) AS BIGINT) AS spot
        FROM rows JOIN runs r ON (r.tree = 0 AND r.gid = rows.gid) OR r.tree = 1) WHERE spot // 16 = run
), sides AS (
  SELECT row, row_number() OVER (PARTITION BY row ORDER BY tree, level) AS k, array_to_string(l, '') AS l, array_to_string(r, '') AS r FROM paths
), fold AS (
  SELECT row, 0 AS k, CAST(coalesce(tampered, leaf) AS VARCHAR) AS digest FROM rows
  UNION ALL
  SELECT f.row, s.k, sha256(s.l || f.digest || s.r) FROM fold f JOIN sides s ON s.row = f.row AND s.k = f.k + 1
), ends AS (
  SELECT row, max_by(digest, k) AS folded_root FROM fold GROUP BY row
), proofs AS (
  SELECT row, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM sides GROUP BY row
)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM rows JOIN (SELECT gid, digest FROM up WHERE n = 1) s USING (gid) CROSS JOIN (SELECT digest FROM over WHERE n = 1) t JOIN ends USING (row) LEFT JOIN proofs USING (row)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
