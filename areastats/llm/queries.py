"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, mixing, ngram_join, pii, piece_bpe, quality, sharding, spelling, token_counts, toxicity, whitening
from .tables import read

#: The vocabulary that op5 counts with, a file of each machine's tokenizer package.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The model that op13 encodes with, from the same package.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf, "documents"), shards=16)


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all texts by a model of the labels outside the held-out third."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = read(spark, sf, "documents").select("doc_id", "text")
    labels = read(spark, sf, "labels").filter(~held_out).select("doc_id", F.col("toxic").cast("int"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(read(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_equal", "n_near", F.md5("text").alias("text_md5"))


def op4_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    repaired = chat.repair(read(spark, sf, "conversations"))
    return repaired.withColumn("rendered_md5", F.md5("rendered")).drop("rendered")


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all texts before and after an exchange, a deletion and an insertion in each."""
    ranks = Path(VOCABULARY).read_bytes()
    docs = read(spark, sf, "documents")
    size = F.greatest(F.length("text"), F.lit(1))
    at = F.pmod(F.xxhash64("doc_id"), size)
    edit = lambda seq, start, end, new: F.struct(
        F.lit(seq).alias("seq"), start.alias("start"), end.alias("end"), F.lit(new).alias("replacement")
    )
    edits = docs.select(
        "doc_id",
        F.inline(F.array(edit(1, at, at + 7, "new words"), edit(2, F.floor(size / 2), F.floor(size / 2) + 40, ""), edit(3, at * 0, at * 0, "Edited. "))),
    )
    counted = token_counts.apply_edits(token_counts.build_index(docs, ranks), edits, ranks)
    return counted.select(
        "doc_id", "n_tokens", "n_tokens_edited", "n_chars_encoded", F.md5("text").alias("text_md5")
    )


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf, "documents"))


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal(read(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["rank"] >= 0)
    counts = [
        F.expr(f"size(filter(spans, s -> s.rank >= 0 and s.kind = '{kind.name}'))").cast("long").alias(f"n_{kind.name}")
        for kind in pii.BASE
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["rank"] < 0)).alias("n_added"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.shingle_components(read(spark, sf, "documents"), length=3, percent=90)


def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of the words of all texts, one in 97 of which is given a slip of one letter."""
    runs = spelling.letter_runs(read(spark, sf, "documents"))
    written = runs.select(spelling.slipped(F.col("doc_id"), F.col("run"), 97).alias("word"))
    return spelling.group_variants(spelling.count_words(written, "word"))


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    whitened = whitening.whiten(vectors, whitening.fit(vectors))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_piece_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all texts and what they spell, as digests."""
    model = Path(PIECE_MODEL).read_bytes()
    spelled = piece_bpe.decode(piece_bpe.encode(read(spark, sf, "documents"), model), model)
    return spelled.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_piece_round_trip": op13_piece_round_trip,
}
