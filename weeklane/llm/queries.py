"""The registered queries of the ten operators, and their SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from weeklane.llm.bpe_count import token_counts
from weeklane.llm.common import table
from weeklane.llm.fingerprints import edited, fingerprinted
from weeklane.llm.hard_negatives import mined
from weeklane.llm.minhash import near_copies
from weeklane.llm.lattice_lm import lattice_scores
from weeklane.llm.mixing import mixed_words
from weeklane.llm.nn_descent import nearest
from weeklane.llm.oracle import SQL
from weeklane.llm.repeats import repeats
from weeklane.llm.secret_scan import secret_spans, span_text
from weeklane.llm.toxicity import toxicity
from weeklane.llm.url_cascade import judged
from weeklane.llm.whitening import whiten
from weeklane.llm.winnowing import contamination


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op3_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_text().alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


RULES = "VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS t(host, path, verdict)"


def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {RULES}"))


def op7_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("spans")


def remainder(by: int):
    return F.crc32(F.col("doc_id").cast("string")) % by


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4) != 2)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), remainder(7) == 2, public_tokenizers.path("piece_bpe_32k.model"))


def op11_polar_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained]) if model else F.array().cast("array<double>")
    one = rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return one.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def queries() -> dict:
    every = (
        op1_minhash, op2_winnowing, op3_fair_queueing, op4_secret_scan, op5_nn_descent, op6_bloom_cascade, op7_bpe_count, op8_column_bwt,
        op9_ftrl_toxicity, op10_lattice_lm, op11_polar_whitening, op12_scaled_sketch, op13_bond_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
