"""The queries of this subpackage, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity of 0.85 or more."""
    from .minhash import MinHashConfig, near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), MinHashConfig(shingle=3, similarity_percent=85, bands=24, rows=6))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards under the law that doc_id and the number of shards decide."""
    from .sharding import digest, shard

    return digest(shard(_read(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 2048, 1024, 512 and 256 tokens, all full."""
    from .packing import digest, pack

    return digest(pack(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, and the verdict by distances from the languages' references."""
    from .quality import judge

    return judge(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the nearest labelled examples that aren't held out."""
    from .toxicity import decisions, score_toxicity

    return decisions(score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding by the 50k ranks, and back."""
    import public_tokenizers

    from .bytebpe import digest, encode_and_decode

    docs = _read(spark, sf_dir, "documents")
    return digest(encode_and_decode(docs, _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the 32k piece vocabulary."""
    from .fst import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak labels of all documents and the scorer learnt from them."""
    from .weaklabel import classify

    return classify(_read(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of 0.93 or more among equal labels."""
    from .embeddings import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, covered licence templates and their spans."""
    from .licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods and more in texts of which a tenth are made periodic."""
    from .periodic import digest, periodic_runs, planted

    docs = _read(spark, sf_dir, "documents")
    return digest(periodic_runs(docs.withColumn("text", planted(docs["doc_id"], docs["text"]))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts by codebooks of sixteen entries after six rounds."""
    from .vector_codes import compress, digest

    return digest(compress(_read(spark, sf_dir, "embeddings")))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, and host reputations where no rule fits."""
    from .urls import judge_urls

    return judge_urls(_read(spark, sf_dir, "pages")).drop("rate", "low")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_minhash_near_dedup,
        op2_shards,
        op3_packing,
        op4_quality_rules,
        op5_toxicity,
        op6_byte_bpe,
        op7_token_counts,
        op8_quality_classifier,
        op9_embedding_dedup,
        op10_license_scan,
        op11_periodic_runs,
        op12_vector_codes,
        op13_url_filters,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": sql.periodic_runs(),
    "op12_vector_codes": sql.vector_codes(),
    "op13_url_filters": sql.url_filters(),
}
