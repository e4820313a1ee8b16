"""The queries of the training-data operators, one for each, and their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminet.llm import bpe, hashtree, langid, linededup, minhash, mixing, mtree, multiindex, perspectives, secretscan
from laminet.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARDS = 40


def digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256 of docs (keep, text), from the ids of their texts and what these decode to."""
    got = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep)
    return got.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", F.size("gone").alias("n_gone"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("gone_lines"), "text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.trained(docs)
    got = langid.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = secretscan.scan(docs, secretscan.train(secretscan.samples(docs)), keep=["doc_id"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.array(*map(F.lit, secretscan.KINDS))
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *map(count, secretscan.KINDS[:3]), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = perspectives.rotate(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return got.withColumn("masks", masks)


def op8_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = hashtree.assign(table(spark, sf_dir, "documents"), hashtree.Tree.even(SHARDS))
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_minhash_near_dedup, op3_line_dedup, op4_mixing, op5_language_id, op6_secret_scan, op7_perspective_rotation, op8_mtree_top_k, op9_sharding, op10_embedding_near_dedup, pipeline)}

ORACLES = {
    # All pairs that share a shingle, compared in full.
    "op2_minhash_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 4 THEN list_concat(w, list_transform(range(5 - len(w)), lambda x: '')) ELSE w END AS w FROM w WHERE len(w) > 0),
g AS (SELECT doc_id, array_to_string(w[i:i+4], ' ') AS g, count(*) AS n FROM p, unnest(range(1, len(w) - 3)) AS t(i) GROUP BY ALL),
m AS (SELECT doc_id, sum(n) AS m FROM g GROUP BY 1),
s AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS s FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT s.a, s.b FROM s JOIN m x ON x.doc_id = s.a JOIN m y ON y.doc_id = s.b WHERE s.s >= 0.8 * (x.m + y.m - s.s)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS to_id FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.to_id),
c AS (SELECT id, min(to_id) AS class_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN c ON c.id = doc_id
""",
    # Prefixes in alphabetical order, which is as exact as any other order, and no further filter.
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda x: x <> ''))) AS k FROM l),
f AS (SELECT k, len(k) AS s, min((doc_id, pos)) AS p, row_number() OVER () AS h FROM k WHERE len(k) > 0 GROUP BY k),
t AS (SELECT h, s, k, p, unnest(k[1:s - ((4 * s + 4) // 5) + 1]) AS t FROM f),
c AS (SELECT DISTINCT a.h AS ha, b.h AS hb, a.k AS ka, b.k AS kb, a.p AS pa, b.p AS pb, a.s AS sa, b.s AS sb FROM t a JOIN t b ON a.t = b.t AND a.p < b.p AND least(a.s, b.s) * 5 >= greatest(a.s, b.s) * 4),
late AS (SELECT DISTINCT hb AS h FROM c WHERE len(list_intersect(ka, kb)) * 9 >= (sa + sb) * 4),
gone AS (SELECT k.doc_id, k.pos FROM k JOIN f ON f.k = k.k WHERE (k.doc_id, k.pos) <> f.p OR f.h IN (SELECT h FROM late)),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_gone, coalesce(string_agg(g.pos::VARCHAR, ',' ORDER BY g.pos), '') AS gone_lines, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_gone, 0)::INT AS n_gone, coalesce(gone_lines, '') AS gone_lines, o.text FROM documents d LEFT JOIN o USING (doc_id)
""",
    "op7_perspective_rotation": """
WITH c AS (SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' WHEN regexp_full_match(role, 'unknown_*') THEN role || '_'
    ELSE replace(replace(regexp_replace(role, '[\r\n]', ' ', 'g'), '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') END AS role,
  replace(replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM c),
s AS (SELECT c.conv_id, w.perspective, coalesce(floor(turn / 64), -1)::BIGINT AS part, turn, c.role, text, CASE WHEN c.role = w.perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || c.role || '|>' || chr(10) END AS head
  FROM c JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text) AS k FROM s),
o AS (SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS b FROM n)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS rendered,
  string_agg(CASE WHEN role = perspective THEN b || '-' || (b + length(text)) END, ',' ORDER BY k) AS masks FROM o GROUP BY 1, 2, 3
""",
    "op8_mtree_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT a AS id, a AS to_id FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id),
c AS (SELECT id, min(to_id) AS c FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
""",
}
