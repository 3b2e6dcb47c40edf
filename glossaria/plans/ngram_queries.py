"""Tokens, n-grams, vocabulary overlap and divergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions import text as tx
from glossaria.operators import ngrams as ng
from glossaria.operators.ids import co_locate, scalar
from glossaria.operators.morphology import top_per_key
from glossaria.plans import fixtures as fx
from glossaria.sources.shared import materialize


def _word_docs(spark, sf_dir):
    keep = ["corpus", "language", "doc_id"]
    return ng.with_tokens(fx.text_docs(spark, sf_dir), tx.word_tokens("text"), keep)


def _space_docs(spark, sf_dir):
    keep = ["corpus", "language", "doc_id"]
    return ng.with_tokens(fx.text_docs(spark, sf_dir), tx.space_tokens("text"), keep)


def word_tokens(spark, sf_dir):
    return _word_docs(spark, sf_dir).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.concat_ws(" ", "tokens")).alias("tokens")
    )


def space_tokens(spark, sf_dir):
    return _space_docs(spark, sf_dir).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.filter("tokens", lambda t: t == "")).cast("bigint").alias("n_empty"),
    )


def word_ngrams(spark, sf_dir):
    grams = _word_docs(spark, sf_dir).select("doc_id", tx.ngram_range("tokens", 2, 3).alias("g"))
    return grams.select(
        "doc_id", F.size("g").cast("bigint").alias("n"), F.md5(F.array_join("g", "|")).alias("ngrams")
    )


def char_ngrams(spark, sf_dir):
    return ng.count_terms(fx.text_docs(spark, sf_dir), tx.char_ngrams("text", 2), ["language"], "ngram")


def token_list_ngrams(spark, sf_dir):
    grams = _space_docs(spark, sf_dir)
    return ng.count_terms(grams, tx.ngrams("tokens", 2), ["language"], "ngram")


def ngram_counts(spark, sf_dir):
    tokens = ng.with_tokens(co_locate(fx.docs(spark, sf_dir), "doc_id"), tx.space_tokens("text"), ["language", "doc_id"])
    return ng.ngram_counts(tokens, 1, 3, ["language", "doc_id"])


def apply_vocabulary(spark, sf_dir):
    counts = ng.ngram_counts(_word_docs(spark, sf_dir), 1, 2, ["corpus", "language"])
    vocabulary = ng.fit_vocabulary(counts.where(F.col("corpus") == "train"))
    return ng.apply_vocabulary(counts.where(F.col("corpus") == "test"), vocabulary).select("language", "ngram", "n")


def fit_vocabulary(spark, sf_dir):
    counts = ng.ngram_counts(_word_docs(spark, sf_dir).where(F.col("corpus") == "train"), 1, 2, [])
    return ng.fit_vocabulary(counts)


def token_counts(spark, sf_dir):
    return ng.token_counts(_word_docs(spark, sf_dir), F.col("tokens"))


def unique_tokens(spark, sf_dir):
    return ng.unique_tokens(_word_docs(spark, sf_dir), F.col("tokens"), ["corpus"])


def bigram_counts(spark, sf_dir):
    return ng.bigram_counts(_word_docs(spark, sf_dir), ["corpus"], "language", "doc_id")


def bigram_counts_within(spark, sf_dir):
    return ng.bigram_counts(_word_docs(spark, sf_dir), ["corpus"], "language", "doc_id", cross_border=False)


def _token_overlap(spark, sf_dir):
    counts = ng.token_counts(_word_docs(spark, sf_dir), F.col("tokens"), ["corpus"])
    return ng.overlap_in_one_pass(counts, "token")


def _bigram_overlap(spark, sf_dir):
    return ng.overlap_in_one_pass(bigram_counts(spark, sf_dir), "bigram")


def vocabulary_overlap(spark, sf_dir):
    return _token_overlap(spark, sf_dir).orderBy(F.desc("n_train"), "token")


def vocabulary_overlap_bigrams(spark, sf_dir):
    return _bigram_overlap(spark, sf_dir)


def vocabulary_overlap_join(spark, sf_dir):
    counts = ng.token_counts(_space_docs(spark, sf_dir), F.col("tokens"), ["corpus"])
    train, test = (counts.where(F.col("corpus") == c) for c in ("train", "test"))
    return ng.vocabulary_overlap(train, test)


def overlap_difference(spark, sf_dir):
    differences = ng.overlap_difference(_bigram_overlap(spark, sf_dir))
    return differences.orderBy(F.desc("difference"), "bigram")


def overlap_probability_difference(spark, sf_dir):
    return ng.overlap_probability_difference(_token_overlap(spark, sf_dir))


def _cells(spark, sf_dir):
    placed = co_locate(fx.whole(spark, sf_dir).select("language", "sentence_id", "text"), "sentence_id")
    return ng.ngram_counts(ng.with_tokens(placed, tx.space_tokens("text"), ["language", "sentence_id"]), 1, 3)


def _divergence(spark, sf_dir):
    return ng.divergence_matrix(_cells(spark, sf_dir))


def divergence_matrix(spark, sf_dir):
    return _divergence(spark, sf_dir).orderBy("num_disagreements", "lang1", "lang2")


def normalized_divergence(spark, sf_dir):
    # the n-grams of all texts are read again; their cells would be many times the input on disk
    terms = ng.ngram_rows(_space_docs(spark, sf_dir), "tokens", 1, 3, [])
    n = scalar(fx.whole(spark, sf_dir).select("sentence_id"), F.max("sentence_id") + 1)
    return ng.normalized_divergence(_divergence(spark, sf_dir), terms, n)


def divergence_by_language(spark, sf_dir):
    return ng.divergence_by_language(_divergence(spark, sf_dir))


def closer_than(spark, sf_dir):
    return ng.closer_than(_divergence(spark, sf_dir))


def distinct_token_sketches(spark, sf_dir):
    """Distinct tokens per language, exact and by merging sketches of the two corpora; right within three standard errors."""
    docs = materialize(_word_docs(spark, sf_dir), "tokens")
    merged = ng.merged_sketches(ng.term_sketches(docs, F.col("tokens"), ["corpus", "language"]), ["language"])
    exact = ng.unique_tokens(docs, F.col("tokens"), ["language"]).groupBy("language").agg(F.count(F.lit(1)).alias("n_exact"))
    near = F.abs(F.col("estimate") / F.col("n_exact") - 1) <= 3 * 1.04 / 2 ** (ng.SKETCH_BITS / 2)
    return merged.join(exact, "language").select("language", "n_exact", near.alias("near"))


def top_tokens_per_language(spark, sf_dir):
    counts = ng.token_counts(_word_docs(spark, sf_dir), F.col("tokens"), ["language"])
    return top_per_key(counts, "language", "token", 20)


QUERIES = {
    f.__name__: f
    for f in (
        word_tokens, space_tokens, word_ngrams, char_ngrams, token_list_ngrams, ngram_counts, fit_vocabulary,
        apply_vocabulary, token_counts, unique_tokens, bigram_counts, bigram_counts_within, vocabulary_overlap,
        vocabulary_overlap_bigrams, vocabulary_overlap_join, overlap_difference, overlap_probability_difference,
        divergence_matrix, normalized_divergence, divergence_by_language, closer_than, top_tokens_per_language,
        distinct_token_sketches,
    )
}

W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
S = "string_split(text, ' ')"


def grams(n: int, tokens: str = "t") -> str:
    """List of the n-grams of a token list."""
    parts = " || ' ' || ".join(f"{tokens}[i + {k}]" if k else f"{tokens}[i]" for k in range(n))
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {parts})"


def tokens_cte(expr: str, source: str = "docs") -> str:
    return f"tk AS (SELECT *, {expr} AS t FROM {source})"


_WT = f"{fx.DOCS_SQL}, {tokens_cte(W)}"
_ST = f"{fx.DOCS_SQL}, {tokens_cte(S)}"
_BIGRAMS = f"""{_WT}, flat AS (SELECT corpus, language, doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS step FROM tk),
paired AS (SELECT corpus, token || ' ' || lead(token) OVER (PARTITION BY corpus ORDER BY language, doc_id, step) AS bigram FROM flat),
bigrams AS (SELECT corpus, bigram, count(*) AS n FROM paired WHERE bigram IS NOT NULL GROUP BY ALL),
overlap AS (SELECT bigram, max(n) FILTER (WHERE corpus = 'train') AS n_train, max(n) FILTER (WHERE corpus = 'test') AS n_test
  FROM bigrams GROUP BY bigram HAVING count(*) = 2)"""
_TOKENS = f"""{_WT}, counts AS (SELECT corpus, token, count(*) AS n FROM (SELECT corpus, unnest(t) AS token FROM tk) GROUP BY ALL),
overlap AS (SELECT token, max(n) FILTER (WHERE corpus = 'train') AS n_train, max(n) FILTER (WHERE corpus = 'test') AS n_test
  FROM counts GROUP BY token HAVING count(*) = 2)"""
_UP_TO_2 = f"list_concat(t, {grams(2)})"
_UP_TO_3 = f"list_concat(list_concat(t, {grams(2)}), {grams(3)})"
_VOCAB = f"""{_WT}, counts AS (SELECT corpus, language, ngram, count(*) AS n
  FROM (SELECT corpus, language, unnest({_UP_TO_2}) AS ngram FROM tk) GROUP BY ALL)"""
_DIVERGENCE = f"""{fx.WHOLE_SQL}, {tokens_cte(S, "whole")},
cells AS (SELECT language, sentence_id, ngram, count(*) AS n
  FROM (SELECT language, sentence_id, unnest({_UP_TO_3}) AS ngram FROM tk) GROUP BY ALL),
langs AS (SELECT DISTINCT language FROM cells),
compared AS (SELECT a.language AS lang1, b.language AS lang2, c.sentence_id, c.ngram,
    sum(CASE WHEN c.language = a.language THEN c.n ELSE 0 END) AS n1,
    sum(CASE WHEN c.language = b.language THEN c.n ELSE 0 END) AS n2
  FROM langs a JOIN langs b ON a.language < b.language JOIN cells c ON c.language IN (a.language, b.language) GROUP BY ALL),
half AS (SELECT lang1, lang2, count(*) FILTER (WHERE n1 <> n2) AS num_disagreements FROM compared GROUP BY ALL),
divergence AS (SELECT * FROM half UNION ALL SELECT lang2, lang1, num_disagreements FROM half)"""

ORACLES = {
    "word_tokens": f"WITH {_WT} SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM tk",
    "space_tokens": f"""WITH {_ST} SELECT doc_id, len(t) AS n_tokens, len(list_filter(t, lambda x: x = '')) AS n_empty FROM tk""",
    "word_ngrams": f"""WITH {_WT}, g AS (SELECT doc_id, list_concat({grams(2)}, {grams(3)}) AS g FROM tk)
      SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS ngrams FROM g""",
    "char_ngrams": rf"""WITH {fx.DOCS_SQL}, tk AS (SELECT language, string_split(regexp_replace(lower(text), '\s\s+', ' ', 'g'), '') AS t FROM docs)
      SELECT language, ngram, count(*) AS n FROM (SELECT language, unnest({grams(2).replace(" || ' '", '')}) AS ngram FROM tk) GROUP BY ALL""",
    "token_list_ngrams": f"""WITH {_ST} SELECT language, ngram, count(*) AS n
      FROM (SELECT language, unnest({grams(2)}) AS ngram FROM tk) GROUP BY ALL""",
    "ngram_counts": f"""WITH {_ST} SELECT language, doc_id, ngram, count(*) AS n
      FROM (SELECT language, doc_id, unnest({_UP_TO_3}) AS ngram FROM tk) GROUP BY ALL""",
    "fit_vocabulary": f"WITH {_VOCAB} SELECT DISTINCT ngram FROM counts WHERE corpus = 'train'",
    "apply_vocabulary": f"""WITH {_VOCAB} SELECT language, ngram, n
      FROM (SELECT *, bool_or(corpus = 'train') OVER (PARTITION BY ngram) AS known FROM counts) WHERE corpus = 'test' AND known""",
    "token_counts": f"WITH {_WT} SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM tk) GROUP BY 1",
    "distinct_token_sketches": f"""WITH {_WT} SELECT language, count(DISTINCT token) AS n_exact, true AS near
      FROM (SELECT language, unnest(t) AS token FROM tk) GROUP BY language""",
    "unique_tokens": f"WITH {_WT} SELECT DISTINCT corpus, token FROM (SELECT corpus, unnest(t) AS token FROM tk)",
    "bigram_counts": f"WITH {_BIGRAMS} SELECT * FROM bigrams",
    "bigram_counts_within": f"""WITH {_WT} SELECT corpus, bigram, count(*) AS n
      FROM (SELECT corpus, unnest({grams(2)}) AS bigram FROM tk) GROUP BY ALL""",
    "vocabulary_overlap": f"WITH {_TOKENS} SELECT * FROM overlap",
    "vocabulary_overlap_bigrams": f"WITH {_BIGRAMS} SELECT * FROM overlap",
    "vocabulary_overlap_join": f"WITH {_TOKENS.replace(W, S)} SELECT * FROM overlap",
    "overlap_difference": f"""WITH {_BIGRAMS} SELECT *, n_test - n_train AS difference FROM overlap
      ORDER BY difference DESC, bigram""",
    "overlap_probability_difference": f"""WITH {_TOKENS}, p AS (
      SELECT token, n_train / (SELECT sum(n_train) FROM overlap) AS a, n_test / (SELECT sum(n_test) FROM overlap) AS b FROM overlap)
      SELECT token, round(a, 9) AS p_train, round(b, 9) AS p_test, round(b - a, 9) AS difference FROM p""",
    "divergence_matrix": f"WITH {_DIVERGENCE} SELECT * FROM divergence",
    "normalized_divergence": f"""WITH {_DIVERGENCE}, size AS (SELECT (SELECT count(DISTINCT ngram) FROM cells) *
        (SELECT max(sentence_id) + 1 FROM whole) AS total)
      SELECT lang1, lang2, num_disagreements, total, round(num_disagreements / total, 9) AS normalized FROM divergence, size""",
    "divergence_by_language": f"""WITH {_DIVERGENCE} SELECT lang1, round_even(avg(num_disagreements), 0) AS mean_disagreements
      FROM divergence GROUP BY lang1""",
    "closer_than": f"""WITH {_DIVERGENCE} SELECT a.lang1, a.lang2, a.num_disagreements, b.lang2 AS closer,
      b.num_disagreements AS closer_disagreements FROM divergence a JOIN divergence b
      ON a.lang1 = b.lang1 AND b.num_disagreements <= a.num_disagreements""",
    "top_tokens_per_language": f"""WITH {_WT}, c AS (SELECT language, token, count(*) AS n
        FROM (SELECT language, unnest(t) AS token FROM tk) GROUP BY ALL)
      SELECT language, row_number() OVER (PARTITION BY language ORDER BY n DESC, token) AS position, token, n FROM c
      QUALIFY position <= 20""",
}
