"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.llm import decontaminate, fill_middle, html_extract, line_dedup, order_minhash, packing, pii, prefix_join, quality, resample, simhash, token_store, url_filter
from terrashift.llm.storage import table



def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), capacity=2048)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.apply_rules(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


#: For the registered query only; production takes its key from a secret store.
EXAMPLE_KEY = b"an example key, not a secret"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), EXAMPLE_KEY)
    kinds = ("email", "phone", "card", "iban", "ip", "date", "ssn", "secret")
    counts = [F.coalesce(F.col("private").getItem(k), F.lit(0)).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", "text", *counts)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.to_hex(F.col("print")).alias("fingerprint"),
        order_minhash.to_hex(F.col("edited_print")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        order_minhash.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return kept.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), max_rows=6000)
    found = quality.scores(docs, model, threshold=0.7)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_store.read_checksums(spark, path)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1, rate=90, spm_rate=20)
    return found.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample.importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, seed=2024)
    return resample.with_ranks(scored, percent=10, min_words=20).select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit": op1_best_fit,
        "op2_url_filter": op2_url_filter,
        "op3_pii": op3_pii,
        "op4_order_minhash": op4_order_minhash,
        "op5_simhash": op5_simhash,
        "op6_line_dedup": op6_line_dedup,
        "op7_html_extract": op7_html_extract,
        "op8_quality": op8_quality,
        "op9_decontaminate": op9_decontaminate,
        "op10_token_store": op10_token_store,
        "op11_fill_middle": op11_fill_middle,
        "op12_resample": op12_resample,
        "op13_prefix_join": op13_prefix_join,
    }


def oracle_sql() -> dict[str, str]:
    from terrashift.llm import sql

    return {"op2_url_filter": sql.OP2, "op6_line_dedup": sql.OP6, "op11_fill_middle": sql.OP11, "op12_resample": sql.OP12}
