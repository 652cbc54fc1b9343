"""The opN_ queries: each reads its whole table, applies its operator and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, html_text, language_id, line_quality, mixing, packing, reply_trees, simhash, substring_dedup, tokens


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, with its url; see `html_text` for pages that are null, empty or broken."""
    return html_text.extracted(_table(spark, sf_dir, "pages", "page_id", "url", "html"), carry=["url"])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash of three-word shingles and its component at two differing bits or fewer."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), k=3, tau=2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those in 35-word passages found elsewhere, and the hash of what is left."""
    out = substring_dedup.duplicate_spans(_table(spark, sf_dir, "documents", "doc_id", "text"), size=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labelled ones that the crc32 rule does not hold out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = language_id.predicted(docs, language_id.training_text(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and sentencepiece tokens of every document."""
    return tokens.token_counts(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset; of the ids only their checksum."""
    out = packing.packed(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"), ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    out = mixing.fair_mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the line rules."""
    out = line_quality.cleaned(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one with control strings as texts, formatted and read back from the output."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    nodes = reply_trees.stored(reply_trees.thread(turns.unionByName(own)))
    back = reply_trees.read_back(reply_trees.formatted(nodes, reply_trees.paths(nodes)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup.exact_copies(_table(spark, sf_dir, "documents", "doc_id", "text"), extra={"text_sha256": digest})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_text, op2_simhash, op3_substring_dedup, op4_language_id, op5_fair_mix, op6_token_counts, op7_line_quality, op8_packing, op9_reply_trees, op10_exact_dedup)
}
