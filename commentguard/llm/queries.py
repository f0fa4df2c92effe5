"""The operators of this folder as registered queries, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from commentguard.llm.align import align_tokens, link_support
from commentguard.llm.decontaminate import benchmark_overlap
from commentguard.llm.languages import fit_languages, predict_languages
from commentguard.llm.line_dedup import KEYS, dedup_lines
from commentguard.llm.merkle import merkle_manifest
from commentguard.llm.mixing import mix_sources
from commentguard.llm.near_dedup import near_duplicates
from commentguard.llm.packing import pack_documents
from commentguard.llm.pages import extract_pages
from commentguard.llm.quality_rules import quality_cascade, with_figures
from commentguard.llm.secrets import joined, secret_spans
from commentguard.llm.token_counts import count_tokens, unigram_scores
from commentguard.llm.toxicity import fit_toxicity, predict_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def contamination(overlap: DataFrame) -> DataFrame:
    """The counts and the digest of item ids of ``benchmark_overlap``."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["word_end"] - r["word_start"])
    return overlap.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query
def op8_benchmark_decontamination(spark, sf_dir):
    return contamination(benchmark_overlap(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@query
def op9_line_dedup(spark, sf_dir):
    shortened = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1, keys=KEYS)
    return shortened.select("doc_id", "n_lines", "n_removed", "text")


@query
def op7_source_mixing(spark, sf_dir):
    mixed = mix_sources(read(spark, sf_dir, "documents"), 1 + (F.col("place") - 1) % 3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op1_quality_rules(spark, sf_dir):
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    figures = (*base, "n_lines", "n_capitals")
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = with_figures(texts, figures)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = quality_cascade(docs, given=figures, measured_on=texts)
    return judged.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


@query
def op4_secret_scan(spark, sf_dir):
    spans = secret_spans(read(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, "entropy")).alias("spans"),
    )


@query
def op5_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit_languages(docs.where(remainder != 0))
    found = predict_languages(docs, model)
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    judged = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = fit_toxicity(docs, judged, ["low_quality", "toxic"])
    found = predict_toxicity(docs, chain)
    return found.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


@query
def op2_html_extraction(spark, sf_dir):
    return extract_pages(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Place of the public vocabulary that tokens are counted by.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op3_token_counts(spark, sf_dir, vocabulary=VOCABULARY):
    return count_tokens(read(spark, sf_dir, "documents"), unigram_scores(vocabulary))


@query
def op11_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    later = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    manifest = merkle_manifest(read(spark, sf_dir, "documents"), {"n_chars": later})
    return manifest.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: Places of the public vocabularies that are aligned; documents are packed by the first.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@query
def op12_tokenizer_alignment(spark, sf_dir, a_path=BYTE_BPE, b_path=PIECE_BPE):
    aligned = align_tokens(read(spark, sf_dir, "documents"), a_path, b_path)
    sizes = {name: F.size(column).cast("long") for name, column in (("n_a", "a_ids"), ("n_b", "b_ids"), ("n_groups", "a_cuts"))}
    digest = F.when(F.size("a_ids") == 0, "").otherwise(F.sha2("groups", 256))
    supported = link_support(aligned, {"doc_id": F.col("doc_id"), **sizes, "groups_sha256": digest})
    return supported.select("doc_id", *sizes, "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op13_best_fit_packing(spark, sf_dir, vocabulary=BYTE_BPE):
    packed = pack_documents(read(spark, sf_dir, "documents"), vocabulary)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
