"""The operators' queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import centroids, collocations, common, exactdedup, media, mixing, neardup, packing, quality, secrets, sharding, tokencounts, toxicity, warc


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    net = toxicity.fit(documents, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity.score(documents, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.captured(common.table(spark, sf_dir, "pages"), common.shared_path(spark, "warc"), min_bytes=0)
    return warc.resolve_revisits(captures)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, max_length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(common.table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(common.table(spark, sf_dir, "documents"))
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    read = media.decode(stored)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.col("dhash").alias("feature"),
        "tile_npy",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    found = secrets.scan(documents, secrets.trained_pair(documents))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.take(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = neardup.group(common.table(spark, sf_dir, "documents"), percent=85, width=5)
    return grouped.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = tokencounts.prefix_table(common.table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), budget=512)
    return tables.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("within").alias("chars_within_limit"), "deltas")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(common.table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, seed="2")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.resolve(common.table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best(collocations.mine(common.table(spark, sf_dir, "documents"), least=30, percent=80), most=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc, op3_packing, op4_sharding, op5_media, op6_quality_rules, op7_secrets, op8_mixing, op9_near_dedup, op10_token_counts, op11_centroids, op12_exact_dedup, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express.  Tokenizers, trained models, checksums and the ring's
    hashes are beyond it; the other queries are tested against brute force."""
    return {
        "op2_warc": warc.decisions_sql(min_bytes=0),
        "op6_quality_rules": quality.judge_sql(),
        "op8_mixing": mixing.take_sql(),
        "op11_centroids": centroids.cluster_sql(k=40, rounds=5, dims=64, seed="2"),
        "op12_exact_dedup": exactdedup.resolve_sql(),
        "op13_collocations": collocations.best_sql(least=30, percent=80, most=2000),
        "op9_near_dedup": neardup.group_sql(percent=85, width=5),
    }
