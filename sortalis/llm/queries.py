"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(divisor: int) -> F.Column:
    """crc32 of doc_id as text, modulo a number: the fold of a document; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.langid import predicted, trained

    docs = documents(spark, sf_dir)
    model = trained(docs.where(remainder(3) != 1))
    return predicted(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "n_words", F.size("spans").alias("n_spans"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.kneser_ney import scored, trained

    docs = documents(spark, sf_dir)
    model = trained(docs.where(remainder(5) != 1), order=3)
    return scored(docs, model).select("doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.token_file import read_token_files, write_token_files

    return read_token_files(spark, write_token_files(documents(spark, sf_dir), tokenizer("word_bpe_49k.json")))


def op5_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.mpeg import media_features

    return media_features(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.substring import removed

    return removed(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.secrets import scanned

    return scanned(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.packing import packed

    return packed(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op9_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.sharding import sharded

    return sharded(documents(spark, sf_dir)).drop("home_node")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sortalis.llm.decontam import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_kneser_ney_scores": op3_kneser_ney_scores,
    "op4_token_file": op4_token_file,
    "op5_mpeg_media": op5_mpeg_media,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_bounded_ring_shards": op9_bounded_ring_shards,
    "op10_decontamination": op10_decontamination,
}

#: The one of the ten whose rows SQL can give at this size.  Tokenizers, fingerprints, models and codecs are beyond it; tests hold the others to brute force.
ORACLES: dict[str, str] = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
p AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) i FROM d)),
hit AS (SELECT r, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
covered AS (SELECT DISTINCT r, i + j pos FROM hit, (SELECT unnest(range(35)) j)),
word AS (SELECT r, unnest(w) x, unnest(range(1, len(w) + 1)) pos FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY pos) k, count(*) n FROM word ANTI JOIN covered USING (r, pos) GROUP BY r)
SELECT CAST(doc_id AS BIGINT) doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(k, '')) kept_sha256
FROM d LEFT JOIN kept USING (r)
""",
}
