"""The operators as queries over the driver's tables, with the SQL that says
the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import automaton, katz, merkle, mixing, near_text, near_vectors, packing, quality, repeats, sharding, topk, warc, whitening

MIX = {"good": 0.9, "low": 0.1, "toxic": 0.0}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").alias("domain"))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))[0]


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


def op3_collision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), trusted(_table(spark, sf_dir, "labels")))


def op5_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("tokens")


def op7_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_corpus(_table(spark, sf_dir, "documents"), order=3, keep_model=False)[0]


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(_table(spark, sf_dir, "documents"), domains(_table(spark, sf_dir, "labels")), MIX)
    return out.select("doc_id", "tokens", "domain", *[F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(MIX)], "rate", mixing.copies(F.col("rate"), F.col("draw")).alias("copies"))


def op11_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    coded = automaton.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    out = automaton.decode(coded, path)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))[0]


def op13_concatenated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_segment_topk, op3_collision_dedup, op4_kneser_ney_quality, op5_seekable_warc, op6_sum_of_squares,
                                   op7_label_propagation, op8_katz_backoff, op9_suffix_repeats, op10_soft_mixing, op11_tokenization_automaton, op12_jacobi_davidson, op13_concatenated_levels)}

_VALID = "len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
ORACLE = {
    "op13_concatenated_levels": merkle.manifest_sql(),
    "op2_segment_topk": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_VALID}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op3_collision_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_VALID}
              AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        c(v, t) AS (SELECT a, b FROM l UNION SELECT c.v, l.b FROM c JOIN l ON l.a = c.t),
        m AS (SELECT v, min(t) AS t FROM c GROUP BY v), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(m.t, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.t, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN m ON m.v = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
}
