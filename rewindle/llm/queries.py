"""The queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewindle.llm import chat, html, merkle, negatives, neighbours, packing, pieces, pii, quality, sharding, simhash, urls, warc
from rewindle.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    rows = warc.read(warc.write(table(spark, folder, "pages"), smallest=0))
    return rows.select(rows["id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    kinds = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], kinds.schema)
    return chat.read_back(chat.rendered(kinds.unionByName(more))).withColumnRenamed("conv", "conv_id")


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trips(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"), merges=True)


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return pii.digests(documents, pii.train(documents))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = html.extracted(table(spark, folder, "pages"), shared_words=True)
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op7_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.searched(table(spark, folder, "embeddings"), every=20, top=20)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"), shingle=3, radius=3)


def op9_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"), 16)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.withColumn("label", moved), F.col("id") % 100 == 0)


#: The rules of the query, by host and path.
URL_RULES = (
    urls.Rule("block", "net"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose title holds a run of marks are junk: their URLs are the list, whatever form they come in."""
    pages = table(spark, folder, "pages")
    junk = pages.where(F.regexp_extract("html", "<title>([^<]*)", 1).rlike("###|%%%|[*][*][*]"))
    rows = urls.judged(pages.select("page_id", "url"), junk, URL_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = documents.select("doc_id", "source", merkle.leaf(*fields, F.col("text")).alias("leaf"), merkle.leaf(*fields, tampered).alias("shown"))
    found = merkle.manifest(rows, "source", ["doc_id"])
    if found.root is None:
        return rows.select("doc_id", "leaf", *[F.col("leaf").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    proved = merkle.proofs(found).select(
        "own.doc_id", "leaf", "subroot", "root",
        merkle.digest(F.array_join(merkle.siblings(F.col("path")), "")).alias("proof_sha256"),
        merkle.folded(F.col("own.shown"), F.col("path")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc": op2_warc,
    "op3_chat_format": op3_chat_format,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_html_text": op6_html_text,
    "op7_nn_descent": op7_nn_descent,
    "op8_simhash": op8_simhash,
    "op9_minimax_shards": op9_minimax_shards,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filter": op12_url_filter,
    "op13_merkle_manifest": op13_merkle_manifest,
}
