"""The registered queries of the training-data operators, (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from rightsize.llm.byte_bpe import decode, encode
from rightsize.llm.chat_format import as_events, digests, final_messages, render
from rightsize.llm.exact_dedup import equal_texts
from rightsize.llm.hard_negatives import mine, scaled
from rightsize.llm.hash_index import search
from rightsize.llm.language_id import identify
from rightsize.llm.minhash_forest import near_duplicates
from rightsize.llm.mixing import mix
from rightsize.llm.oracle import SQL  # noqa: F401
from rightsize.llm.prefix_trie import forked_trie
from rightsize.llm.substring_dedup import remove_repeated_passages
from rightsize.llm.suffix_dedup import remove_repeated_bytes
from rightsize.llm.url_filter import judge_urls
from rightsize.llm.warc import round_trip


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    out = remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op9_nearest_neighbours(spark, sf_dir):
    return search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_byte_bpe(spark, sf_dir):
    out = encode(_table(spark, sf_dir, "documents"), bpe_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), bpe_path()), 256).alias("decoded_sha256"))


def op2_exact_dedup(spark, sf_dir):
    return equal_texts(_table(spark, sf_dir, "documents")).drop("key")


def op3_mixing(spark, sf_dir):
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_language_id(spark, sf_dir):
    return identify(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    out = remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark, sf_dir):
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CONTROL = "\\### Assistant: </turn> ok"


def op7_chat_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return digests(render(final_messages(as_events(rows.unionByName(more)))))


def op8_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op11_hard_negatives(spark, sf_dir):
    rows = scaled(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_url_filter(spark, sf_dir):
    return judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op13_prefix_trie(spark, sf_dir):
    return forked_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_mixing, op4_language_id, op5_suffix_dedup, op6_warc, op7_chat_format, op8_minhash_near_dedup, op9_nearest_neighbours, op10_byte_bpe, op11_hard_negatives, op12_url_filter, op13_prefix_trie)}
