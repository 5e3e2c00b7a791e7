"""Registered queries of the training-data operators: name → (spark, sf_dir) → DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


@register("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.hostrules import STATS, quality_rules

    judged = quality_rules(read_table(spark, sf_dir, "documents"))
    rate = F.round("host_rate", 9).alias("host_rate")
    return judged.select("doc_id", *STATS, "base_failed", "kept", "source", rate, "host_verdict")


@register("op1_mix_sources")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.mixing import copies, n_words

    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = copies(rows)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "source", "n_copies"
    )


@register("op9_hilbert_shards")
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.hilbert import payload_size, shard_rows

    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", payload_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    placed = shard_rows(rows, ["lang", "source", "size"], 40, "rows", ("doc_id", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


@register("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.simhash import near_duplicates

    d = near_duplicates(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op10_warc")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    from evalspark.llm.common import shared_folder
    from evalspark.llm.warc import round_trip

    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid4().hex}"
    records = round_trip(read_table(spark, sf_dir, "pages"), path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


@register("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.decontam import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op5_quality_crf")
def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.quality_crf import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.langid import identify

    found = identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))
    return found.select("page_id", "host", "domain", "address", "declared", "lang", "confidence", "text_lang")


@register("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.linededup import dedup_lines

    d = dedup_lines(read_table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    return d.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", kept)


@register("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.substrdedup import dedup_substrings

    d = dedup_substrings(read_table(spark, sf_dir, "documents"), texts_out=False)
    return d.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@register("op13_merkle_manifest")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.merkle import with_tampering

    def text(c: str):
        return F.lower(F.hex(c))

    m = with_tampering(read_table(spark, sf_dir, "documents"))
    proof = F.sha2(F.concat(text("path"), text("sub_path")), 256).alias("proof_sha256")
    return m.select(
        "doc_id", *[text(c).alias(c) for c in ("leaf", "subroot", "root")], proof, text("folded_root").alias("folded_root"), "verified"
    )


@register("op11_align_tokenizers")
def op11_align_tokenizers(spark: SparkSession, sf_dir: str, tokenizers: str = "/opt/tokenizers") -> DataFrame:
    from evalspark.llm.alignment import Vocabulary, align

    # the rank file holds the vocabulary of byte_bpe_50k.json and gives the same ids, at four times the speed
    a, b = (Vocabulary.read(f"{tokenizers}/{f}") for f in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    documents, _ = align(read_table(spark, sf_dir, "documents"), a, b, groups_out=False)
    return documents.drop("groups")


@register("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.llm.toxicity import classify

    found = classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
