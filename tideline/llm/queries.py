"""The registered query of each operator, over whole tables, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import attribution, bpe, chat, codes, decontaminate, gif, manifest, minhash, packing, quality, rules, suffixes, toxicity
from tideline.llm.common import documents

#: The tokenizers of the queries; every operator takes a path.
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), WORDS, digests=True)


def fold(n: int, rest: int) -> Column:
    """Whether a document is held out: crc32 of its id, as text, has this remainder; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == rest, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold(3, 1)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold(4, 2)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), 3, 85).drop("key")


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(documents(spark, sf_dir)).select("doc_id", *rules.MEASURES[:5], "base_failed", "kept")


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.read_texts(gif.store_texts(documents(spark, sf_dir)))


def op7_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(documents(spark, sf_dir), BYTES)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.format_calls(calls, results, chat.ASK).select("conv_id", "turn", "call_id", "level", "n_results", "result_turn", "valid", "json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORDS)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(documents(spark, sf_dir))


def gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_frames(gif.store_texts(documents(spark, sf_dir)), "doc_id", "media")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_minhash, op4_rules, op5_toxicity, op6_gif, op7_attribution, op8_chat, op9_packing, op10_suffixes, op11_codes, op12_manifest, op13_decontamination, rules_ablation, gif_frames, chat_turns)}


def oracle_sql() -> dict[str, str]:
    return {"op4_rules": rules.SQL, "op8_chat": chat.SQL, "rules_ablation": rules.ABLATION_SQL, "chat_turns": chat.TURNS_SQL, "op11_codes": codes.SQL, "op12_manifest": manifest.SQL, "op13_decontamination": decontaminate.SQL}
