"""The registered queries of the training-data operators, op1 to op12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm._shared import table
from skeinwork.llm.oracles import ORACLES
from skeinwork.llm.chat import format_chats, loss_texts, read_turns
from skeinwork.llm import decontam, fmdedup, htmltext, langid, pieces, spelling, suffixdedup
from skeinwork.llm.packing import pack_documents
from skeinwork.llm.quality import judge
from skeinwork.llm.simhash import fp_hex, near_duplicates
from skeinwork.llm.urls import filter_urls


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text", "lang", (langid.fold(F.col("doc_id")) == 1).alias("held_out"))
    # a null id has no remainder: such a row is neither held out nor learned from
    model = langid.fit(docs.filter(~F.col("held_out")), "text", "lang")
    rows = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = format_chats(rows).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("mask")), "").alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents", spread=True), "doc_id", "text", n=3)
    return classes.select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), F.col("class_id").alias("component_id"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.annotate(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"]))).alias("item_ids"),
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages", spread=True)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents", spread=True))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdedup.remove_repeats(table(spark, sf_dir, "documents", spread=True))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents", spread=True), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents", spread=True))


def piece_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), piece_model(), decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), pieces.digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_chat_format, op4_simhash, op5_decontaminate, op6_html_text, op7_suffix_dedup, op8_substring_dedup, op9_packing, op10_quality_rules, op11_spelling_variants, op12_piece_encoding)}

__all__ = ["ORACLES", "QUERIES"]
