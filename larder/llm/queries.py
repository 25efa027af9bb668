"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import op1_scoring, op2_packing, op3_mixing, op4_jaccard, op5_vectors, op6_quality, op7_chat, op8_pii, op9_rules, op10_sharding, op11_manifest, op12_negatives, op13_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document against the documents labelled as good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = op1_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return scored.withColumns({"target_loss": F.round("target_loss", 5), "background_loss": F.round("background_loss", 5), "score": F.round("score", 8)})


def op2_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op3_mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1), 1.5, 2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return op7_chat.digest(op7_chat.format_chats(turns.select("conv_id", "turn", "role", op7_chat.text_parts(F.col("text")).alias("parts"))))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_rules.score(table(spark, sf_dir, "documents")).select("doc_id", *op9_rules.BASE, "base_failed", "kept", "posterior")


def op10_sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against one in which n_chars grew by 1 where 7 divides the id's crc32."""
    docs = table(spark, sf_dir, "documents")
    changed = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    return op11_manifest.verify(op11_manifest.manifest(docs, tampered={"n_chars": changed}))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op12_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op13_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_packing": op2_packing_query,
        "op3_mixing": op3_mixing_query,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_personal_data": op8_personal_data,
        "op9_quality_rules": op9_quality_rules,
        "op10_sharding": op10_sharding_query,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_byte_bpe": op13_byte_bpe,
        "pipeline": pipeline,
    }


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i.c >= 75 * (a.c + b.c - i.c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = w.doc_id
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + 2 * length(role) - length(translate(role, '\<>', '')) + 2 * length(text) - length(translate(text, '\<>', '')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY 1),
n AS (SELECT x, count(*) AS c FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.c, 0) AS n_links, least(vec_id, coalesce(m.y, vec_id)) AS component_id, vec_id <= coalesce(m.y, vec_id) AS kept
FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN m ON m.x = vec_id
"""


SCORING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_target FROM documents),
t AS (SELECT doc_id, is_target, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k, ws FROM d),
u AS (SELECT doc_id, is_target, n, w, k, CASE WHEN k > 1 THEN ws[k - 1] END AS before FROM t),
one AS (SELECT w, count(*) AS c, count(*) FILTER (is_target) AS ct FROM u GROUP BY 1),
two AS (SELECT before, w, count(*) AS c, count(*) FILTER (is_target) AS ct FROM u WHERE k > 1 GROUP BY 1, 2),
own1 AS (SELECT doc_id, w, count(*) AS m FROM u GROUP BY 1, 2),
own2 AS (SELECT doc_id, before, w, count(*) AS m FROM u WHERE k > 1 GROUP BY 1, 2, 3),
all_ AS (SELECT count(*) AS n, count(*) FILTER (is_target) AS nt, count(DISTINCT w) AS v FROM u),
x AS (SELECT u.*, side, CASE WHEN side = 1 OR is_target THEN 1 ELSE 0 END AS out FROM u, (VALUES (0), (1)) s(side)),
p AS (SELECT x.doc_id, x.side, x.k, x.n AS len, CASE WHEN side = 1 THEN a.c ELSE a.ct END - out * oa.m AS single, CASE WHEN side = 1 THEN b.c ELSE b.ct END - out * ob.m AS prior,
  CASE WHEN side = 1 THEN j.c ELSE j.ct END - out * oj.m AS joint, CASE WHEN side = 1 THEN all_.n ELSE all_.nt END - out * x.n + 0.1::DOUBLE * (all_.v + 1) AS total
  FROM x CROSS JOIN all_ JOIN one a ON a.w = x.w JOIN own1 oa ON oa.doc_id = x.doc_id AND oa.w = x.w LEFT JOIN one b ON b.w = x.before LEFT JOIN own1 ob ON ob.doc_id = x.doc_id AND ob.w = x.before
  LEFT JOIN two j ON j.before = x.before AND j.w = x.w LEFT JOIN own2 oj ON oj.doc_id = x.doc_id AND oj.before = x.before AND oj.w = x.w),
l AS (SELECT doc_id, sum(-ln(q)) FILTER (side = 0) AS t, sum(-ln(q)) FILTER (side = 1) AS b FROM (
  SELECT doc_id, side, CASE WHEN k = 1 THEN (single + 0.1::DOUBLE) / total ELSE (joint + 2 * ((single + 0.1::DOUBLE) / total)) / (greatest(prior, joint) + 2) END AS q FROM p) GROUP BY 1)
SELECT d.doc_id, is_target, len(ws) AS n_tokens, round(coalesce(t, 0.0), 5) AS target_loss, round(coalesce(b, 0.0), 5) AS background_loss, round(coalesce((t - b) / len(ws), 0.0), 8) AS score FROM d LEFT JOIN l USING (doc_id)
"""

MIXING_SQL = r"""
WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM w GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM f),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM g),
o AS (SELECT w.*, source_size, target, passes, target - passes * source_size AS need, coalesce(sum(size) OVER (PARTITION BY w.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w JOIN k ON w.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN passes < 2 AND (before + size <= need OR before <= need AND size < 2 * (need - before)) THEN 1 ELSE 0 END))::BIGINT AS taken, source FROM o
"""

SHARDING_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS bytes FROM documents),
s AS (SELECT doc_id, bytes + 16 AS size, xor(list_reduce(list_transform(range(bytes), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1),
  lambda c, b: xor(c // 256, tab.crc[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, tab),
m0 AS (SELECT DISTINCT coalesce(doc_id, 0)::UBIGINT AS key FROM documents),
m1 AS (SELECT key, (xor(key, key >> 32)::UHUGEINT * 15485907386658061715 % 18446744073709551616)::UBIGINT AS h FROM m0),
m2 AS (SELECT key, (xor(h, h >> 29)::UHUGEINT * 14029467366897019727 % 18446744073709551616)::UBIGINT AS h FROM m1),
j(key, state, t) AS (SELECT key, xor(h, h >> 32), 0::BIGINT FROM m2 UNION ALL
  SELECT key, n, floor((t + 1) * (2147483648::DOUBLE / ((n >> 33) + 1)))::BIGINT FROM (SELECT key, t, (state::UHUGEINT * 2862933555777941757 % 18446744073709551616 + 1)::UHUGEINT % 18446744073709551616 AS w, w::UBIGINT AS n FROM j WHERE t < 41)),
p AS (SELECT key, max(t) FILTER (t < 40)::INT AS shard, max(t) FILTER (t < 41)::INT AS grown_shard FROM j GROUP BY 1)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM s JOIN p ON key = coalesce(doc_id, 0)::UBIGINT
"""


MANIFEST_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc),
r AS (SELECT *, n_chars + CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c // 256, tab.crc[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 7 = 0
  THEN 1 ELSE 0 END AS changed FROM documents, tab),
f AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, changed, n_chars, text, lang,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM r),
d AS (SELECT doc_id, g, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen(changed::VARCHAR) || ':' || changed, '-') || tail) AS claimed FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS size FROM d),
a(k, g, i, size, node) AS (SELECT 0, g, i, size, leaf FROM n UNION ALL SELECT k + 1, g, i // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM a WHERE size > 1 GROUP BY k, g, i // 2, size),
s AS (SELECT g, node AS subroot, max(k) OVER () AS deep, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS size FROM a WHERE size = 1),
t(k, i, size, node) AS (SELECT 0, j, size, subroot FROM s UNION ALL SELECT k + 1, i // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE size > 1 GROUP BY k, i // 2, size),
w AS (SELECT doc_id, n.g, n.i, leaf, claimed, l.k, (n.i // (2 ** l.k)::BIGINT) % 2 AS side, b.node AS beside FROM n JOIN (SELECT DISTINCT g, k FROM a WHERE size > 1) l USING (g)
        LEFT JOIN a b ON b.g = n.g AND b.k = l.k AND b.i = xor(n.i // (2 ** l.k)::BIGINT, 1)
      UNION ALL SELECT doc_id, n.g, n.i, leaf, claimed, 1000 + l.k, (s.j // (2 ** l.k)::BIGINT) % 2, b.node FROM n JOIN s USING (g) JOIN (SELECT DISTINCT k FROM t WHERE size > 1) l ON true
        LEFT JOIN t b ON b.k = l.k AND b.i = xor(s.j // (2 ** l.k)::BIGINT, 1)),
steps AS (SELECT g, i, list(struct_pack(l := CASE WHEN side = 1 THEN beside ELSE '' END, r := CASE WHEN side = 0 THEN coalesce(beside, '') ELSE '' END) ORDER BY k) AS path, string_agg(coalesce(beside, ''), '' ORDER BY k) AS beside FROM w GROUP BY 1, 2),
c(g, i, z, node) AS (SELECT g, i, 0, claimed FROM n UNION ALL SELECT c.g, c.i, z + 1, sha256(path[z + 1].l || node || path[z + 1].r) FROM c JOIN steps ON c.g = steps.g AND c.i = steps.i WHERE z < len(path)),
e AS (SELECT g, i, arg_max(node, z) AS folded_root FROM c GROUP BY 1, 2)
SELECT n.doc_id, leaf, subroot, root, sha256(coalesce(beside, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM n JOIN s USING (g) JOIN e ON e.g = n.g AND e.i = n.i LEFT JOIN steps p ON p.g = n.g AND p.i = n.i, (SELECT node AS root FROM t WHERE size = 1)
"""

NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.other AS positive_id, p.k AS positive_rank, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, positive_rank::INT AS positive_rank, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": SCORING_SQL, "op3_mixing": MIXING_SQL, "op4_ngram_jaccard": JACCARD_SQL, "op5_embedding_dedup": VECTOR_SQL, "op7_chat_formatting": CHAT_SQL, "op10_sharding": SHARDING_SQL, "op11_merkle_manifest": MANIFEST_SQL, "op12_hard_negatives": NEGATIVES_SQL}
