"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.llm import (
    chat, complement_packing, decontaminate, html_extract, line_dedup, lm_scoring, minhash, negatives, packing,
    quality_classifier, quality_rules, spelling, toxicity,
)
from glossaria.llm.common import table


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, fit_toxicity(spark, sf_dir))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "toxic_spans",
    )


def op2_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *names, "base_failed", "kept", "rule_failed", "level")


def op3_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op4_html_extraction(spark, sf_dir):
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col("main_text")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


def op5_packing(spark, sf_dir):
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    crc = F.crc32("tokens").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op6_lm_scoring(spark, sf_dir):
    scored = lm_scoring.score(table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score")
    )


def op7_minhash_dedup(spark, sf_dir):
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    return chat.digest(chat.render(chat.fold(chat.from_turns(turns.unionByName(planted)))))


def op9_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def op10_line_dedup(spark, sf_dir):
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "text", "n_lines", "n_dropped")


def op11_complement_packing(spark, sf_dir):
    import public_tokenizers

    pieces = complement_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")


def op12_spelling_variants(spark, sf_dir):
    found = spelling.variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_packing": op5_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_complement_packing": op11_complement_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op6_lm_scoring": lm_scoring.ORACLE_SQL,
    "op8_chat_formatting": chat.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
