"""The registered queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, knn, media, minhash, packing, secrets, substring, token_count, token_orc, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), separator=0, longest=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-orc")
    token_orc.write_tokens(common.documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_orc.offsets(spark, path)


@query
def op7_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.stored(common.documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query
def op4_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(common.documents(spark, sf_dir)))


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    """Fitted to the labels table: low quality first, then toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


@query
def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_chain(spark, docs, sf_dir))
    return scored.withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


@query
def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn.top_k(table, F.col("id") % 20 == 0, k=20)


ORACLES["op1_voronoi_knn"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op8_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.documents(spark, sf_dir))


@query
def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.removed(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the document's place: file, ordinal and start."""
    return token_count.counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), separator=50256)
