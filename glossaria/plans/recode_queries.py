"""Filters, recoding, concatenation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions.text import clean_word as clean
from glossaria.functions.text import space_tokens, word_tokens
from glossaria.operators import batches, combine, ids, pairs, recode
from glossaria.operators.ngrams import count_terms
from glossaria.plans import fixtures as fx
from glossaria.plans.source_queries import _SCRIPTS_SQL
from glossaria.sources.corpora import language_scripts


def filter_language(spark, sf_dir):
    return recode.filter_language(fx.docs(spark, sf_dir), "fr").select("doc_id", "language", "n_chars")


def sql_filter(spark, sf_dir):
    data = fx.docs(spark, sf_dir).select("doc_id", "language", "corpus")
    return recode.sql_filter(data, "language = :language", {"language": "de"})


def rename_if_missing(spark, sf_dir):
    data = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return recode.rename_if_missing(data, [("lang", "language"), ("n_chars", "source")])


def add_column(spark, sf_dir):
    data = fx.text_docs(spark, sf_dir)
    return recode.add_column(data, "n_words", F.size(word_tokens("text")).cast("bigint")).select("doc_id", "n_words")


def add_script_column(spark, sf_dir):
    scripts = language_scripts(fx.all_varieties(spark, sf_dir).distinct())
    return recode.add_script_column(fx.docs(spark, sf_dir).select("doc_id", "language"), scripts)


def recode_language(spark, sf_dir):
    marked = fx.docs(spark, sf_dir).select("doc_id", F.concat("language", F.lit("-Cyrl")).alias("language"))
    return recode.recode_language(marked, {"en": "rus", "fr": "mon", "mon": "khk"}, drop_suffix="-Cyrl")


def language_code_table(spark, sf_dir):
    data = fx.docs(spark, sf_dir).select("doc_id", "language")
    return recode.language_code_table(recode.recode_language(data, {"en": "rus", "fr": "mon", "de": "srp"}))


def translation_prompt(spark, sf_dir):
    aligned = pairs.align_to_target(fx.whole(spark, sf_dir), "fr")
    return recode.translation_prompt(aligned).select("sentence_id", "source_language", F.md5("prompt").alias("prompt"))


def _labelled(spark, sf_dir):
    data = fx.docs(spark, sf_dir).select("doc_id", "corpus", F.concat_ws("_", "language", "source").alias("label"))
    split = [data.where(F.col("corpus") == c) for c in ("train", "test")]
    return data, recode.label_vocabulary(*split)


def encode_labels(spark, sf_dir):
    data, vocabulary = _labelled(spark, sf_dir)
    return recode.encode_labels(data, vocabulary)


def decode_labels(spark, sf_dir):
    data, vocabulary = _labelled(spark, sf_dir)
    encoded = recode.encode_labels(data, vocabulary).drop("label")
    return recode.decode_labels(encoded, vocabulary).groupBy("label_id", "label").agg(F.count(F.lit(1)).alias("n"))


def same_language_rows(spark, sf_dir):
    aligned = pairs.align_to_target(fx.whole(spark, sf_dir), "fr")
    return recode.same_language_rows(aligned).select("sentence_id", "source_language", "target_language")


def clean_word(spark, sf_dir):
    words = count_terms(fx.text_docs(spark, sf_dir), space_tokens("text"), out="raw")
    return words.groupBy(clean("raw").alias("word")).agg(F.sum("n").alias("n"))


def argmax_prediction(spark, sf_dir):
    scored = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("scores"))
    return recode.argmax_prediction(scored).select("vec_id", "prediction")


def add_sentence_id(spark, sf_dir):
    keys = fx.docs(spark, sf_dir).select("corpus", "language", "doc_id")
    return ids.add_sentence_id(keys, "doc_id", ("corpus", "language"))


def add_global_sentence_id(spark, sf_dir):
    keys = fx.docs(spark, sf_dir).select("language", "doc_id")
    return ids.add_global_sentence_id(ids.add_sentence_id(keys, "doc_id"))


def random_rows(spark, sf_dir):
    return recode.random_rows(fx.docs(spark, sf_dir).select("doc_id", "language"), 100, "rows", "doc_id")


def random_row_per_language(spark, sf_dir):
    return recode.random_row_per_language(fx.docs(spark, sf_dir).select("doc_id", "language", "n_chars"), "one", "doc_id")


def apply_pipeline(spark, sf_dir):
    data = fx.docs(spark, sf_dir).select("corpus", "language", "doc_id", "n_chars")
    parts = {c: data.where(F.col("corpus") == c) for c in ("train", "test")}
    steps = [
        lambda df: recode.recode_language(df, {"en": "eng"}),
        lambda df: recode.rename_if_missing(df, [("language", "label")]),
        lambda df: recode.add_column(df, "long", (F.col("n_chars") > 1000).cast("bigint")),
    ]
    return combine.concat_datasets(*recode.apply_pipeline(parts, steps).values())


def concat_datasets(spark, sf_dir):
    a = fx.docs(spark, sf_dir).select(F.lit("documents").alias("origin"), "doc_id", "text")
    b = fx.table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("doc_id"), "text")
    return combine.concat_datasets(a, b).select("origin", "doc_id", F.md5("text").alias("text"))


def common_languages(spark, sf_dir):
    return combine.common_languages(*fx.varieties(spark, sf_dir))


def missing_languages(spark, sf_dir):
    return combine.missing_languages(*fx.varieties(spark, sf_dir))


def language_coverage(spark, sf_dir):
    return combine.language_coverage(*fx.varieties(spark, sf_dir))


def restrict_to_common(spark, sf_dir):
    return combine.restrict_to_common(*fx.varieties(spark, sf_dir))


def select_train_test(spark, sf_dir):
    a, b = fx.varieties(spark, sf_dir)
    return combine.select_train_test(a, b, "common", None)


def split_by_label(spark, sf_dir):
    subsets = combine.split_by_label(fx.whole(spark, sf_dir))
    return subsets.select(
        "language", "part", F.size("texts").cast("bigint").alias("n"), F.md5(F.array_join("texts", "|")).alias("texts")
    )


def _variety_table(spark, sf_dir):
    return fx.name_table(spark, sf_dir).select(F.replace("language_code", F.lit("-"), F.lit("_")).alias("language"), "position")


def language_pairs_ordered(spark, sf_dir):
    return combine.language_pairs_ordered(_variety_table(spark, sf_dir))


def language_pairs_from_one(spark, sf_dir):
    return combine.language_pairs_ordered(_variety_table(spark, sf_dir), "fr_src0").orderBy("language_pair")


def language_pairs_unordered(spark, sf_dir):
    return combine.language_pairs_unordered(_variety_table(spark, sf_dir))


def language_pairs_grid(spark, sf_dir):
    return combine.language_pairs_grid(_variety_table(spark, sf_dir))


def _measured(columns):
    """A user function as the batches call it: lists in, lists out."""
    words = [[w for w in text.split(" ") if w] for text in columns["text"]]
    return {"n_words": [len(w) for w in words], "longest": [max(map(len, w), default=0) for w in words]}


def mapped_batches(spark, sf_dir):
    data = fx.docs(spark, sf_dir).select("doc_id", "language", "text")
    return batches.map_batches(data, _measured, "n_words long, longest long", 256, ["text"]).drop("text")


def _lines(columns):
    rows = [(k, i, len(x)) for k, text in zip(columns["doc_id"], columns["text"]) for i, x in enumerate(text.split("\n"))]
    return dict(zip(("doc_id", "line", "n_chars"), map(list, zip(*rows))))


def batched_lines(spark, sf_dir):
    data = fx.docs(spark, sf_dir).select("doc_id", "text")
    return batches.map_batches(data, _lines, "doc_id long, line long, n_chars long", 100, keep=False)


def filtered_batches(spark, sf_dir):
    data = fx.docs(spark, sf_dir).select("doc_id", "language", "text")
    more = lambda columns: [t.count("e") > t.count("n") for t in columns["text"]]
    return batches.filter_batches(data, more, 256, ["text"]).drop("text")


QUERIES = {
    f.__name__: f
    for f in (
        filter_language, sql_filter, rename_if_missing, add_column, add_script_column, recode_language,
        language_code_table, translation_prompt, encode_labels, decode_labels, same_language_rows, clean_word,
        argmax_prediction, add_sentence_id, add_global_sentence_id, random_rows, random_row_per_language,
        apply_pipeline, concat_datasets, common_languages, missing_languages, language_coverage,
        restrict_to_common, select_train_test, split_by_label, language_pairs_ordered, language_pairs_from_one,
        language_pairs_unordered, language_pairs_grid, mapped_batches, batched_lines, filtered_batches,
    )
}

VARIETIES_SQL = f"""{fx.LABELLED_SQL}, a AS (SELECT variety AS language, doc_id, n_chars FROM labelled),
b AS (SELECT variety AS language, doc_id, n_chars FROM labelled WHERE toxic = 1),
vt AS (SELECT lang || '_' || source AS language, min(doc_id) AS position FROM documents GROUP BY lang, source)"""
_VOCAB_SQL = f"""{fx.DOCS_SQL}, data AS (SELECT doc_id, corpus, language || '_' || source AS label FROM docs),
vocabulary AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM data))"""
_ALIGNED_SQL = f"""{fx.WHOLE_SQL},
aligned AS (SELECT s.sentence_id, s.text AS source, t.text AS target, s.language AS source_language, t.language AS target_language
  FROM whole s JOIN whole t ON s.sentence_id = t.sentence_id AND t.language = 'fr')"""
TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

ORACLES = {
    "filter_language": "SELECT doc_id, lang AS language, n_chars FROM documents WHERE lang = 'fr'",
    "mapped_batches": """SELECT doc_id, lang AS language, len(w) AS n_words, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest
      FROM (SELECT doc_id, lang, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)""",
    "batched_lines": """SELECT doc_id, i - 1 AS line, length(lines[i]) AS n_chars
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "filtered_batches": """SELECT doc_id, lang AS language FROM documents
      WHERE length(replace(text, 'e', '')) < length(replace(text, 'n', ''))""",
    "sql_filter": f"WITH {fx.DOCS_SQL} SELECT doc_id, language, corpus FROM docs WHERE language = 'de'",
    "rename_if_missing": "SELECT doc_id, lang AS language, source, n_chars FROM documents",
    "add_column": f"SELECT doc_id, len({TOKENS_SQL}) AS n_words FROM documents",
    "add_script_column": f"""WITH {_SCRIPTS_SQL} SELECT doc_id, lang AS language, coalesce(scripts[1], 'unknown') AS script
      FROM documents LEFT JOIN scripts ON language = lang""",
    "recode_language": """SELECT doc_id, CASE lang WHEN 'en' THEN 'rus' WHEN 'fr' THEN 'mon' WHEN 'mon' THEN 'khk' ELSE lang END AS language
      FROM documents""",
    "language_code_table": """SELECT doc_id, CASE lang WHEN 'en' THEN 'rus' WHEN 'fr' THEN 'mon' WHEN 'de' THEN 'srp' ELSE lang END AS language,
      CASE lang WHEN 'en' THEN 'Russian' WHEN 'fr' THEN 'Mongolian' WHEN 'de' THEN 'Serbian' END AS language_name,
      CASE lang WHEN 'en' THEN 'ru' WHEN 'fr' THEN 'mn' WHEN 'de' THEN 'sr' END AS romanization_code FROM documents""",
    "translation_prompt": f"""WITH {_ALIGNED_SQL} SELECT sentence_id, source_language,
      md5('Translate from ' || source_language || ' to ' || target_language || ': ' || source) AS prompt FROM aligned""",
    "encode_labels": f"WITH {_VOCAB_SQL} SELECT doc_id, corpus, label, label_id FROM data JOIN vocabulary USING (label)",
    "decode_labels": f"""WITH {_VOCAB_SQL} SELECT label_id, label, count(*) AS n FROM data JOIN vocabulary USING (label) GROUP BY ALL""",
    "same_language_rows": f"""WITH {_ALIGNED_SQL} SELECT sentence_id, source_language, target_language FROM aligned
      WHERE source_language = target_language""",
    "clean_word": r"""WITH raw AS (SELECT raw, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS raw FROM documents) GROUP BY 1)
      SELECT coalesce(nullif(lower(regexp_replace(trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')), ''), raw) AS word, CAST(sum(n) AS BIGINT) AS n FROM raw GROUP BY 1""",
    "argmax_prediction": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS prediction FROM embeddings",
    "add_sentence_id": f"WITH {fx.CORPUS_SQL} SELECT corpus, language, doc_id, sentence_id FROM corpus",
    "add_global_sentence_id": """SELECT lang AS language, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS sentence_id,
      row_number() OVER (ORDER BY lang, doc_id) - 1 AS global_sentence_id FROM documents""",
    "random_rows": "SELECT doc_id, lang AS language FROM documents ORDER BY md5('rows:' || doc_id), doc_id LIMIT 100",
    "random_row_per_language": """SELECT doc_id, lang AS language, n_chars FROM documents
      QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('one:' || doc_id), doc_id) = 1""",
    "apply_pipeline": f"""WITH {fx.DOCS_SQL} SELECT corpus, CASE language WHEN 'en' THEN 'eng' ELSE language END AS label, doc_id, n_chars,
      CAST(n_chars > 1000 AS BIGINT) AS long FROM docs""",
    "concat_datasets": """SELECT 'documents' AS origin, doc_id, md5(text) AS text FROM documents
      UNION ALL SELECT 'benchmark', item_id, md5(text) FROM benchmark""",
    "common_languages": f"WITH {VARIETIES_SQL} SELECT language FROM a INTERSECT SELECT language FROM b",
    "missing_languages": f"WITH {VARIETIES_SQL} SELECT language FROM a EXCEPT SELECT language FROM b",
    "language_coverage": f"""WITH {VARIETIES_SQL}, m AS (SELECT DISTINCT a.language, b.language AS hit FROM a LEFT JOIN b USING (language))
      SELECT count(*) AS n_languages, count(hit) AS n_shared, round(100.0 * count(hit) / count(*), 2) AS coverage_percent
      FROM (SELECT DISTINCT a.language, x.language AS hit FROM a LEFT JOIN (SELECT DISTINCT language FROM b) x ON a.language = x.language)""",
    "restrict_to_common": f"WITH {VARIETIES_SQL} SELECT * FROM a WHERE language IN (SELECT language FROM b)",
    "select_train_test": f"""WITH {VARIETIES_SQL} SELECT *, 'train' AS split FROM a WHERE language IN (SELECT language FROM b)
      UNION ALL SELECT *, 'test' FROM b""",
    "split_by_label": f"""WITH {fx.WHOLE_SQL} SELECT language, sentence_id // 256 AS part, count(*) AS n,
      md5(string_agg(text, '|' ORDER BY sentence_id)) AS texts FROM whole GROUP BY 1, 2""",
    "language_pairs_ordered": f"""WITH {VARIETIES_SQL} SELECT x.language AS language1, y.language AS language2,
      x.language || '-' || y.language AS language_pair FROM vt x, vt y WHERE x.language <> y.language""",
    "language_pairs_from_one": f"""WITH {VARIETIES_SQL} SELECT x.language AS language1, y.language AS language2,
      x.language || '-' || y.language AS language_pair FROM vt x, vt y WHERE x.language <> y.language AND x.language = 'fr_src0'""",
    "language_pairs_unordered": f"""WITH {VARIETIES_SQL} SELECT x.language AS language1, y.language AS language2,
      x.language || '-' || y.language AS language_pair FROM vt x JOIN vt y ON x.position < y.position""",
    "language_pairs_grid": f"""WITH {VARIETIES_SQL} SELECT x.language AS language1, y.language AS language2,
      x.language || '-' || y.language AS language_pair FROM vt x, vt y""",
}
