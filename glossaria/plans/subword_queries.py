"""Subword segmentation, word / token statistics and morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.operators import morphology as mo
from glossaria.operators import subwords as sw
from glossaria.operators.ngrams import count_terms
from glossaria.plans import fixtures as fx
from glossaria.sources.shared import materialize

KEYS = ["doc_id", "language"]
POSTING_RANGE = 1024


def _lexicon(spark, sf_dir):
    words = sw.word_counts(fx.text_docs(spark, sf_dir))
    return sw.lexicon(words, fx.segmenter(spark, sf_dir))


def train_vocabulary(spark, sf_dir):
    words = sw.word_counts(fx.text_docs(spark, sf_dir).where(F.col("corpus") == "train"))
    return sw.train_vocabulary(words, fx.VOCABULARY_SIZE, fx.MAX_PIECE)


def tokenize_corpus(spark, sf_dir):
    tokens = sw.tokenize_corpus(fx.text_docs(spark, sf_dir), fx.segmenter(spark, sf_dir), KEYS)
    return tokens.groupBy("language", "token").agg(
        F.count(F.lit(1)).alias("n"), F.count("word").alias("n_in_words"),
        F.sum("position").alias("positions"), F.coalesce(F.sum("word_id"), F.lit(0)).alias("word_ids"),
    )


def unk_fraction(spark, sf_dir):
    fractions = sw.unk_fraction(fx.text_docs(spark, sf_dir), fx.segmenter(spark, sf_dir), KEYS)
    return fractions.withColumn("unk_fraction", F.round("unk_fraction", 9))


def unk_by_language(spark, sf_dir):
    return sw.unk_by_language(sw.unk_fraction(fx.text_docs(spark, sf_dir), fx.segmenter(spark, sf_dir), KEYS))


def word_segmentations(spark, sf_dir):
    rows = sw.word_segmentations(fx.text_docs(spark, sf_dir), fx.segmenter(spark, sf_dir), KEYS)
    return rows.groupBy("language", F.concat_ws(" ", "pieces").alias("segmentation")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("word_id").alias("word_ids")
    )


def word_segmentations_merged(spark, sf_dir):
    rows = sw.word_segmentations(fx.text_docs(spark, sf_dir), fx.segmenter(spark, sf_dir), KEYS, merge_repeats=True)
    return rows.groupBy("language", F.size("pieces").cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def token_word_joint(spark, sf_dir):
    return sw.token_word_joint(_lexicon(spark, sf_dir)).drop("n_word")


def token_word_marginals(spark, sf_dir):
    return sw.token_word_marginals(token_word_joint(spark, sf_dir))


def conditional_probabilities(spark, sf_dir):
    return sw.conditional_probabilities(sw.token_word_joint(materialize(_lexicon(spark, sf_dir), "lexicon")))


def vocabulary_reduction(spark, sf_dir):
    return sw.vocabulary_reduction(_lexicon(spark, sf_dir), 30)


def word_length_in_tokens(spark, sf_dir):
    return sw.word_length_in_tokens(_lexicon(spark, sf_dir))


def word_length_in_tokens_total(spark, sf_dir):
    return sw.word_length_in_tokens(_lexicon(spark, sf_dir), by_language=False)


def token_length_in_chars(spark, sf_dir):
    return sw.token_length_in_chars(_lexicon(spark, sf_dir))


def segmentations_per_word(spark, sf_dir):
    return sw.segmentation_histogram(sw.segmentations_per_word(_lexicon(spark, sf_dir)))


def segmentation_histogram_wide(spark, sf_dir):
    histogram = segmentations_per_word(spark, sf_dir)
    return sw.segmentation_histogram_wide(histogram, ["de", "en", "es", "fr"])


def sentence_token_index(spark, sf_dir):
    return sw.sentence_token_index(fx.text_docs(spark, sf_dir), fx.segmenter(spark, sf_dir), ["doc_id"])


def word_sentence_index(spark, sf_dir):
    return sw.word_sentence_index(fx.docs(spark, sf_dir), "doc_id")


def posting_lists(spark, sf_dir):
    lists = sw.posting_lists(sw.word_sentence_index(fx.docs(spark, sf_dir), "doc_id", POSTING_RANGE), "doc_id", POSTING_RANGE)
    entries = F.transform("postings", lambda p: F.concat_ws(":", p["id"], p["n"]))
    return lists.select("language", "word", "part", F.md5(F.array_join(entries, ",")).alias("postings"))


def words_per_language(spark, sf_dir):
    words = sw.word_counts(fx.text_docs(spark, sf_dir))
    return words.groupBy("language").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("occurrences"))


def _segments(spark, sf_dir):
    words = fx.analyses(spark, sf_dir).groupBy(F.col("form").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return sw.lexicon(words, fx.segmenter(spark, sf_dir, "forms")).select("word", "pieces")


def _triples(spark, sf_dir):
    return mo.word_subword_features(_segments(spark, sf_dir), fx.analyses(spark, sf_dir))


def subword_feature_matrix(spark, sf_dir):
    return mo.subword_feature_matrix(_triples(spark, sf_dir))


def subword_feature_matrix_wide(spark, sf_dir):
    return mo.subword_feature_matrix_wide(subword_feature_matrix(spark, sf_dir), ["SMALL", "ECONOMY"])


def features_on(spark, sf_dir):
    return mo.features_on(subword_feature_matrix(spark, sf_dir)).orderBy(F.desc("num_features_on"), "subword")


def word_feature_matrix(spark, sf_dir):
    return mo.word_feature_matrix(_triples(spark, sf_dir))


def word_features(spark, sf_dir):
    return mo.word_features(_triples(spark, sf_dir))


def top_subwords_for_feature(spark, sf_dir):
    return mo.top_subwords_for_feature(subword_feature_matrix(spark, sf_dir), 5)


def top_words_for_feature(spark, sf_dir):
    return mo.top_words_for_feature(word_feature_matrix(spark, sf_dir), 3)


def top_features_for_subword(spark, sf_dir):
    return mo.top_features_for_subword(subword_feature_matrix(spark, sf_dir), 5)


def feature_report(spark, sf_dir):
    report = mo.feature_report(_triples(spark, sf_dir), _segments(spark, sf_dir))
    graph = F.transform("graph", lambda g: F.concat(g["subword"], F.lit("("), F.array_join(g["features"], ","), F.lit(")")))
    return report.select(
        "feature", "position", "word", F.array_join(graph, " ").alias("graph"),
        F.array_join("word_features", ",").alias("word_features"),
    )


def analyse_word_features(spark, sf_dir):
    return mo.analyse_word_features(fx.analyses(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        train_vocabulary, tokenize_corpus, unk_fraction, unk_by_language, word_segmentations,
        word_segmentations_merged, token_word_joint, token_word_marginals, conditional_probabilities,
        vocabulary_reduction, word_length_in_tokens, word_length_in_tokens_total, token_length_in_chars,
        segmentations_per_word, segmentation_histogram_wide, sentence_token_index, word_sentence_index,
        posting_lists, words_per_language, subword_feature_matrix, subword_feature_matrix_wide, features_on,
        word_feature_matrix, word_features, top_subwords_for_feature, top_words_for_feature,
        top_features_for_subword, feature_report, analyse_word_features,
    )
}

L = f"WITH RECURSIVE {fx.LEXICON_SQL}"
M = f"WITH RECURSIVE {fx.FORMS_SQL}"
W = fx.SEGMENT_WORDS_SQL
_SENTENCES = f"""{L}, occurrences AS (SELECT language, doc_id, unnest({W}) AS word, generate_subscripts({W}, 1) - 1 AS word_id FROM docs),
segmented AS (SELECT language, doc_id, word_id, word, pieces FROM occurrences JOIN lex USING (word)),
tokens AS (SELECT language, doc_id, word_id, word, unnest(pieces) AS token, generate_subscripts(pieces, 1) AS step FROM segmented),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY word_id, step) AS position FROM tokens),
all_tokens AS (SELECT language, doc_id, position, token, word_id, word FROM placed
  UNION ALL SELECT language, doc_id, 0, '[CLS]', NULL, NULL FROM docs
  UNION ALL SELECT d.language, d.doc_id, coalesce(m, 0) + 1, '[SEP]', NULL, NULL FROM docs d
    LEFT JOIN (SELECT doc_id, max(position) AS m FROM placed GROUP BY doc_id) USING (doc_id)),
fractions AS (SELECT language, doc_id, count(*) FILTER (WHERE token = '[UNK]') / count(*) AS f FROM all_tokens GROUP BY ALL)"""
_JOINT = f"""{L}, joint AS (SELECT language, token, word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT language, word, n, unnest(pieces) AS token FROM lw) GROUP BY ALL)"""
_INDEX = f"""WITH word_index AS (SELECT lang AS language, word, doc_id, count(*) AS n
  FROM (SELECT lang, doc_id, unnest({W}) AS word FROM documents) GROUP BY ALL)"""
_CLEAN_WORD = r"""coalesce(nullif(lower(regexp_replace(word, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')), ''), word)"""
_SEGMENTATIONS = f"""{L}, per_word AS (SELECT language, {_CLEAN_WORD} AS w, count(DISTINCT array_to_string(pieces, ' ')) AS n_segmentations
  FROM lw GROUP BY ALL), histogram AS (SELECT language, n_segmentations, count(*) AS n_words FROM per_word GROUP BY ALL)"""
_SUBWORD_MATRIX = "sm AS (SELECT subword, feature, count(*) AS n FROM triples GROUP BY ALL)"
_WORD_MATRIX = "wm AS (SELECT word, feature, count(*) AS n FROM triples GROUP BY ALL)"


def _top(table: str, key: str, item: str, top: int) -> str:
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {item}) AS position, {item}, n FROM {table}
      QUALIFY position <= {top}"""


ORACLES = {
    "train_vocabulary": f"{L} SELECT piece, CAST(n AS BIGINT) AS n FROM vocab",
    "tokenize_corpus": f"""{_SENTENCES} SELECT language, token, count(*) AS n, count(word) AS n_in_words,
      CAST(sum(position) AS BIGINT) AS positions, CAST(coalesce(sum(word_id), 0) AS BIGINT) AS word_ids FROM all_tokens GROUP BY ALL""",
    "unk_fraction": f"{_SENTENCES} SELECT language, doc_id, round(f, 9) AS unk_fraction FROM fractions",
    "unk_by_language": f"{_SENTENCES} SELECT language, round(avg(f), 6) AS mean_unk_fraction FROM fractions GROUP BY language",
    "word_segmentations": f"""{_SENTENCES} SELECT language, array_to_string(pieces, ' ') AS segmentation, count(*) AS n,
      CAST(sum(word_id) AS BIGINT) AS word_ids FROM segmented GROUP BY ALL""",
    "word_segmentations_merged": f"""{_SENTENCES}, merged AS (SELECT language, doc_id, word, CAST(sum(len(pieces)) AS BIGINT) AS length
      FROM segmented GROUP BY ALL) SELECT language, length, count(*) AS n FROM merged GROUP BY ALL""",
    "token_word_joint": f"{_JOINT} SELECT * FROM joint",
    "token_word_marginals": f"""{_JOINT} SELECT language, token, word, CAST(sum(n) AS BIGINT) AS n FROM joint
      GROUP BY GROUPING SETS ((language, token, word), (language, token), (language, word), (language))""",
    "conditional_probabilities": f"""{_JOINT} SELECT language, token, word, n,
      round(n / sum(n) OVER (PARTITION BY language, word), 9) AS token_given_word,
      round(n / sum(n) OVER (PARTITION BY language, token), 9) AS word_given_token FROM joint""",
    "vocabulary_reduction": f"""{_JOINT} SELECT language, count(DISTINCT word) AS n_words, count(DISTINCT token) AS n_subwords,
      round(count(DISTINCT token) / count(DISTINCT word), 2) AS vocab_reduction_ratio FROM joint GROUP BY language""",
    "word_length_in_tokens": f"""{L} SELECT language, len(pieces) AS length, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY language), 6) AS density FROM lw GROUP BY language, len(pieces)""",
    "word_length_in_tokens_total": f"""{L} SELECT len(pieces) AS length, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (), 6) AS density FROM lw GROUP BY len(pieces)""",
    "token_length_in_chars": f"""{_JOINT}, per_token AS (SELECT token, sum(n) AS n FROM joint GROUP BY token)
      SELECT length(token) AS token_length, count(*) AS n_tokens, CAST(sum(n) AS BIGINT) AS occurrences FROM per_token GROUP BY 1""",
    "segmentations_per_word": f"{_SEGMENTATIONS} SELECT * FROM histogram",
    "segmentation_histogram_wide": f"""{_SEGMENTATIONS} SELECT n_segmentations,
      {', '.join(f"CAST(coalesce(sum(n_words) FILTER (WHERE language = '{x}'), 0) AS BIGINT) AS {x}" for x in ('de', 'en', 'es', 'fr'))},
      CAST(sum(n_words) AS BIGINT) AS total FROM histogram GROUP BY n_segmentations""",
    "sentence_token_index": f"{_SENTENCES} SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL",
    "word_sentence_index": f"{_INDEX} SELECT * FROM word_index",
    "posting_lists": f"""{_INDEX} SELECT language, word, doc_id // 1024 AS part,
      md5(string_agg(doc_id || ':' || n, ',' ORDER BY doc_id)) AS postings FROM word_index GROUP BY ALL""",
    "words_per_language": f"""{_INDEX} SELECT language, count(DISTINCT word) AS n_words, CAST(sum(n) AS BIGINT) AS occurrences
      FROM word_index GROUP BY language""",
    "subword_feature_matrix": f"{M}, {_SUBWORD_MATRIX} SELECT * FROM sm",
    "subword_feature_matrix_wide": f"""{M}, {_SUBWORD_MATRIX} SELECT subword,
      CAST(coalesce(sum(n) FILTER (WHERE feature = 'SMALL'), 0) AS BIGINT) AS SMALL,
      CAST(coalesce(sum(n) FILTER (WHERE feature = 'ECONOMY'), 0) AS BIGINT) AS ECONOMY FROM sm GROUP BY subword""",
    "features_on": f"""{M}, {_SUBWORD_MATRIX} SELECT subword, CAST(sum(n) AS BIGINT) AS num_features_on,
      length(subword) AS token_length FROM sm GROUP BY subword""",
    "word_feature_matrix": f"{M}, {_WORD_MATRIX} SELECT * FROM wm",
    "word_features": f"{M} SELECT DISTINCT word, feature FROM triples",
    "top_subwords_for_feature": f"{M}, {_SUBWORD_MATRIX} {_top('sm', 'feature', 'subword', 5)}",
    "top_words_for_feature": f"{M}, {_WORD_MATRIX} {_top('wm', 'feature', 'word', 3)}",
    "top_features_for_subword": f"{M}, {_SUBWORD_MATRIX} {_top('sm', 'subword', 'feature', 5)}",
    "feature_report": f"""{M}, {_SUBWORD_MATRIX}, {_WORD_MATRIX}, tw AS ({_top('wm', 'feature', 'word', 3)}),
      tf AS ({_top('sm', 'subword', 'feature', 3)}),
      sf AS (SELECT subword, string_agg(feature, ',' ORDER BY position) AS features FROM tf GROUP BY subword),
      pc AS (SELECT word, unnest(pieces) AS subword, generate_subscripts(pieces, 1) AS step FROM lex),
      own AS (SELECT word, string_agg(feature, ',' ORDER BY feature) AS word_features
        FROM (SELECT DISTINCT word, feature FROM triples) GROUP BY word)
      SELECT tw.feature, tw.position, word, string_agg(subword || '(' || sf.features || ')', ' ' ORDER BY step) AS graph,
        any_value(own.word_features) AS word_features
      FROM tw JOIN pc USING (word) JOIN sf USING (subword) JOIN own USING (word) GROUP BY tw.feature, tw.position, word""",
    "analyse_word_features": f"""WITH {fx.ANALYSES_SQL} SELECT form, feature, count(*) AS n
      FROM (SELECT form, unnest(string_split(features, ';')) AS feature FROM analyses) GROUP BY ALL""",
}
