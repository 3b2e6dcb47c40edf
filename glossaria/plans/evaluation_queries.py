"""Evaluation metrics and language-identification models."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.functions.text import char_ngrams
from glossaria.operators import evaluate as ev
from glossaria.operators import lid
from glossaria.operators import subwords as sw
from glossaria.operators.romanize import augment_romanized
from glossaria.plans import fixtures as fx

LABELS = ["de", "en", "es", "fr", "unknown"]


def language_balance(spark, sf_dir):
    return ev.language_balance(fx.docs(spark, sf_dir), ["corpus"])


def _counts(spark, sf_dir, groups=()):
    return ev.confusion_counts(fx.multiclass(spark, sf_dir), groups)


def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(_counts(spark, sf_dir))


def confusion_matrix_dropped(spark, sf_dir):
    return ev.confusion_matrix(_counts(spark, sf_dir, ["source"]), ["source"], drop_empty=True)


def confusion_display(spark, sf_dir):
    return ev.confusion_display(ev.confusion_matrix(_counts(spark, sf_dir)), LABELS)


def per_class_f1(spark, sf_dir):
    return ev.per_class_f1(_counts(spark, sf_dir))


def per_class_f1_by_source(spark, sf_dir):
    return ev.per_class_f1(_counts(spark, sf_dir, ["source"]), ["source"])


def macro_f1(spark, sf_dir):
    return ev.macro_f1(per_class_f1_by_source(spark, sf_dir), ["source"])


def micro_f1(spark, sf_dir):
    return ev.micro_f1(per_class_f1_by_source(spark, sf_dir), ["source"])


def f1_for_languages(spark, sf_dir):
    return ev.f1_for_languages(per_class_f1(spark, sf_dir), ["de", "es", "fi"])


def binary_outcomes(spark, sf_dir):
    return ev.binary_outcomes(fx.predictions(spark, sf_dir), ["language_pair", "phase"])


def outcomes_before_after(spark, sf_dir):
    return ev.outcomes_before_after(fx.predictions(spark, sf_dir))


def error_count(spark, sf_dir):
    return ev.error_count(fx.predictions(spark, sf_dir), ["language_pair", "phase"])


def error_ratio(spark, sf_dir):
    return ev.error_ratio(outcomes_before_after(spark, sf_dir)).orderBy("ratio")


def normalize_confusion(spark, sf_dir):
    return ev.normalize_confusion(_counts(spark, sf_dir), "label")


def normalize_confusion_columns(spark, sf_dir):
    return ev.normalize_confusion(_counts(spark, sf_dir), "prediction")


def misclassification_counts(spark, sf_dir):
    return ev.misclassification_counts(fx.multiclass(spark, sf_dir))


def expand_confusion(spark, sf_dir):
    wide = confusion_display(spark, sf_dir)
    return ev.expand_confusion(wide)


def bleu_statistics(spark, sf_dir):
    return ev.bleu_statistics(fx.hypotheses(spark, sf_dir), "pair_id")


def corpus_bleu(spark, sf_dir):
    return ev.corpus_bleu(bleu_statistics(spark, sf_dir))


def mean_generation_length(spark, sf_dir):
    return ev.mean_generation_length(fx.hypotheses(spark, sf_dir))


def _split(df):
    return (df.where(F.col("corpus") == c).drop("corpus") for c in ("train", "test"))


def _identified(model, test):
    return lid.identify_language(model, test).select(
        "doc_id", "language", "prediction", F.round("confidence", 3).alias("confidence")
    )


def _word_data(spark, sf_dir):
    return lid.with_word_tokens(fx.text_docs(spark, sf_dir)).select("corpus", "doc_id", "language", "tokens")


def _char_data(spark, sf_dir):
    return fx.text_docs(spark, sf_dir).select("corpus", "doc_id", "language", "text")


def _subword_data(spark, sf_dir):
    keys = ["corpus", "doc_id", "language"]
    pieces = sw.segmented_sentences(fx.text_docs(spark, sf_dir), fx.segmenter(spark, sf_dir), keys)
    return pieces.select(*keys, F.flatten("pieces").alias("tokens"))


def _embedding_data(spark, sf_dir):
    return fx.vectors(spark, sf_dir).where(F.col("model") == "full").select(
        F.when(F.col("sentence_id") % 2 == 0, "train").otherwise("test").alias("corpus"),
        F.col("sentence_id").alias("doc_id"), "language", "embedding",
    )


def _fitted(fit, data):
    train, test = _split(data)
    return fit(train), test


def lid_word_bigram_model(spark, sf_dir):
    return _identified(*_fitted(lid.lid_word_bigram_model, _word_data(spark, sf_dir)))


def lid_char_bigram_model(spark, sf_dir):
    return _identified(*_fitted(lid.lid_char_bigram_model, _char_data(spark, sf_dir)))


def lid_romanized_char_model(spark, sf_dir):
    return _identified(*_fitted(lid.lid_char_bigram_model, augment_romanized(fx.cyrillic(spark, sf_dir))))


def lid_subword_bigram_model(spark, sf_dir):
    return _identified(*_fitted(lid.lid_subword_bigram_model, _subword_data(spark, sf_dir)))


def lid_embedding_model(spark, sf_dir):
    return _identified(*_fitted(lid.lid_embedding_model, _embedding_data(spark, sf_dir)))


def predict_proba(spark, sf_dir):
    model, test = _fitted(lid.lid_char_bigram_model, _char_data(spark, sf_dir))
    scored = model.predict(test)
    return scored.select("doc_id", F.explode("probabilities").alias("candidate", "p")).withColumn("p", F.round("p", 3))


def lid_features(spark, sf_dir):
    """Character bigrams of the test documents as the model counts them."""
    train, test = _split(_char_data(spark, sf_dir))
    grams = char_ngrams("text", 2)
    return lid.feature_counts(test, grams, lid.vocabulary(train, grams), ["doc_id"])


def _proper():
    """Whether a row's probabilities sum to one."""
    return F.abs(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda s, p: s + p) - 1) < 1e-6


def _right():
    return F.avg((F.col("prediction") == F.col("language")).cast("int"))


def _outcomes(model, test):
    """Per language: rows, rows with proper probabilities, and whether four in five are right.

    The smallest tables have eight test rows of a language, so one error there is already 0.875.
    """
    return model.predict(test).groupBy("language").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(_proper()).alias("n_proper"), (_right() >= 0.8).alias("accurate")
    )


def lid_outcomes(spark, sf_dir):
    return _outcomes(*_fitted(lid.lid_char_bigram_model, _char_data(spark, sf_dir)))


def _overall(model, test):
    """Over all languages: rows, rows with proper probabilities, and whether the model beats the most frequent label.

    Short documents of rare languages share few word or subword bigrams in the smallest tables.
    """
    by_label = test.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    most = by_label.agg((F.max("n") / F.sum("n")).alias("share")).scalar()
    return model.predict(test).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(_proper()).alias("n_proper"), _right().alias("right")
    ).select("n_rows", "n_proper", (F.col("right") > most).alias("better"))


def lid_subword_outcomes(spark, sf_dir):
    return _overall(*_fitted(lid.lid_subword_bigram_model, _subword_data(spark, sf_dir)))


def lid_word_outcomes(spark, sf_dir):
    return _overall(*_fitted(lid.lid_word_bigram_model, _word_data(spark, sf_dir)))


def lid_embedding_outcomes(spark, sf_dir):
    """Rows alone: the labels of the given vectors have nothing to do with their directions."""
    model, test = _fitted(lid.lid_embedding_model, _embedding_data(spark, sf_dir))
    return model.predict(test).groupBy("language").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(_proper()).alias("n_proper"))


QUERIES = {
    f.__name__: f
    for f in (
        language_balance, confusion_matrix, confusion_matrix_dropped, confusion_display, per_class_f1,
        per_class_f1_by_source, macro_f1, micro_f1, f1_for_languages, binary_outcomes, outcomes_before_after,
        error_count, error_ratio, normalize_confusion, normalize_confusion_columns, misclassification_counts,
        expand_confusion, bleu_statistics, corpus_bleu, mean_generation_length, lid_word_bigram_model,
        lid_char_bigram_model, lid_romanized_char_model, lid_subword_bigram_model, lid_embedding_model, predict_proba,
        lid_features, lid_outcomes, lid_word_outcomes, lid_subword_outcomes, lid_embedding_outcomes,
    )
}

_MC = f"{fx.MULTICLASS_SQL}, counts AS (SELECT label, prediction, count(*) AS n FROM multiclass GROUP BY ALL)"
_SEEN = "seen AS (SELECT label AS l FROM counts UNION SELECT prediction FROM counts)"
_SQUARE = f"""{_MC}, {_SEEN}, square AS (SELECT a.l AS label, b.l AS prediction, coalesce(n, 0) AS n
  FROM seen a CROSS JOIN seen b LEFT JOIN counts c ON c.label = a.l AND c.prediction = b.l)"""


def _f1(group: str = "") -> str:
    g = f"{group}, " if group else ""
    on = f"AND m.{group} = s.{group}" if group else ""
    return f"""{fx.MULTICLASS_SQL}, seen AS (SELECT {g}label AS class FROM multiclass UNION SELECT {g}prediction FROM multiclass),
f1 AS (SELECT {f's.{group}, ' if group else ''}class, count(*) FILTER (WHERE label = class AND prediction = class) AS tp,
    count(*) FILTER (WHERE label <> class AND prediction = class) AS fp,
    count(*) FILTER (WHERE label = class AND prediction <> class) AS fn,
    round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1
  FROM seen s JOIN multiclass m ON true {on} GROUP BY ALL)"""


_CELL = "count(*) FILTER (WHERE label = '{0}' AND prediction = '{1}')"
_OUTCOMES = f"""{fx.PREDICTIONS_SQL}, o AS (SELECT language_pair, phase, {_CELL.format('no', 'yes')} AS false_positives,
  {_CELL.format('yes', 'no')} AS false_negatives, {_CELL.format('yes', 'yes')} AS true_positives, {_CELL.format('no', 'no')} AS true_negatives,
  true_positives + true_negatives AS total_correct, false_positives + false_negatives AS total_incorrect
  FROM predictions GROUP BY ALL)"""
_FIELDS = "false_positives false_negatives true_positives true_negatives total_correct total_incorrect".split()
_BEFORE_AFTER = f"""{_OUTCOMES}, ba AS (SELECT language_pair, {', '.join(f'a.{f} AS {f}_before, b.{f} AS {f}_after' for f in _FIELDS)}
  FROM o a JOIN o b USING (language_pair) WHERE a.phase = 'before' AND b.phase = 'after')"""


def _bleu_tokens(column: str) -> str:
    from glossaria.functions.text import BLEU_RULES

    out = f"' ' || trim({column}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || ' '"
    for pattern, replacement in BLEU_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return rf"regexp_extract_all({out}, '\S+')"


def _bleu_grams(tokens: str) -> str:
    from glossaria.plans.ngram_queries import grams

    return " UNION ALL ".join(
        f"SELECT pair_id, side, {n} AS \"order\", unnest({grams(n, tokens)}) AS gram FROM toks" for n in range(1, 5)
    )


_BLEU = f"""{fx.HYPOTHESES_SQL}, toks AS (SELECT pair_id, 'h' AS side, {_bleu_tokens('prediction')} AS t FROM hypotheses
  UNION ALL SELECT pair_id, 'r', {_bleu_tokens('reference')} FROM hypotheses),
grams AS ({_bleu_grams('t')}),
clipped AS (SELECT pair_id, "order", gram, count(*) FILTER (WHERE side = 'h') AS hyp, count(*) FILTER (WHERE side = 'r') AS ref
  FROM grams GROUP BY ALL),
stats AS (SELECT "order", CAST(sum(least(hyp, ref)) AS BIGINT) AS correct, CAST(sum(hyp) AS BIGINT) AS total,
  CAST(sum(ref) AS BIGINT) AS ref_total FROM clipped GROUP BY "order")"""

def _char_grams() -> str:
    from glossaria.plans.ngram_queries import grams

    return grams(2).replace(" || ' '", "")


ORACLES = {
    "lid_features": rf"""WITH {fx.DOCS_SQL}, tk AS (SELECT corpus, doc_id,
        string_split(regexp_replace(lower(text), '\s\s+', ' ', 'g'), '') AS t FROM docs),
      counts AS (SELECT corpus, doc_id, term, count(*) AS n FROM (SELECT corpus, doc_id, unnest({_char_grams()}) AS term FROM tk) GROUP BY ALL)
      SELECT doc_id, term, n FROM (SELECT *, bool_or(corpus = 'train') OVER (PARTITION BY term) AS known FROM counts)
      WHERE corpus = 'test' AND known""",
    "lid_outcomes": f"""WITH {fx.DOCS_SQL} SELECT language, count(*) AS n_rows, count(*) AS n_proper, true AS accurate
      FROM docs WHERE corpus = 'test' GROUP BY language""",
    **dict.fromkeys(
        ("lid_word_outcomes", "lid_subword_outcomes"),
        f"WITH {fx.DOCS_SQL} SELECT count(*) AS n_rows, count(*) AS n_proper, true AS better FROM docs WHERE corpus = 'test'",
    ),
    "lid_embedding_outcomes": f"""WITH {fx.VECTORS_SQL} SELECT language, count(*) AS n_rows, count(*) AS n_proper
      FROM vectors WHERE model = 'full' AND sentence_id % 2 = 1 GROUP BY language""",
    "language_balance": f"""WITH {fx.DOCS_SQL} SELECT corpus, language, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY corpus), 6) AS share FROM docs GROUP BY corpus, language""",
    "confusion_matrix": f"WITH {_SQUARE} SELECT * FROM square",
    "confusion_matrix_dropped": f"""WITH {fx.MULTICLASS_SQL}, rows_seen AS (SELECT DISTINCT source, label FROM multiclass),
      columns_seen AS (SELECT DISTINCT source, prediction FROM multiclass)
      SELECT r.source, r.label, c.prediction, count(m.doc_id) AS n FROM rows_seen r JOIN columns_seen c ON r.source = c.source
      LEFT JOIN multiclass m ON m.source = r.source AND m.label = r.label AND m.prediction = c.prediction GROUP BY ALL""",
    "confusion_display": f"""WITH {_SQUARE} SELECT label,
      {', '.join(f"CAST(sum(n) FILTER (WHERE prediction = '{x}') AS BIGINT) AS {x}" for x in LABELS)} FROM square GROUP BY label""",
    "per_class_f1": f"WITH {_f1()} SELECT * FROM f1",
    "per_class_f1_by_source": f"WITH {_f1('source')} SELECT * FROM f1",
    "macro_f1": f"WITH {_f1('source')} SELECT source, round(avg(f1), 6) AS macro_f1 FROM f1 GROUP BY source",
    "micro_f1": f"WITH {fx.MULTICLASS_SQL} SELECT source, round(avg(CAST(label = prediction AS INT)), 6) AS micro_f1 FROM multiclass GROUP BY source",
    "f1_for_languages": f"""WITH {_f1()} SELECT class, coalesce(f1, 0) AS f1 FROM (VALUES ('de'), ('es'), ('fi')) v(class) LEFT JOIN f1 USING (class)""",
    "binary_outcomes": f"WITH {_OUTCOMES} SELECT * FROM o",
    "outcomes_before_after": f"WITH {_BEFORE_AFTER} SELECT * FROM ba",
    "error_count": f"""WITH {fx.PREDICTIONS_SQL} SELECT language_pair, phase, count(*) FILTER (WHERE label <> prediction) AS errors
      FROM predictions GROUP BY ALL""",
    "error_ratio": f"""WITH {_BEFORE_AFTER} SELECT language_pair, total_incorrect_before, total_incorrect_after,
      round(total_incorrect_after / nullif(total_incorrect_before, 0), 6) AS ratio FROM ba""",
    "normalize_confusion": f"WITH {_MC} SELECT *, round(n / sum(n) OVER (PARTITION BY label), 2) AS share FROM counts",
    "normalize_confusion_columns": f"WITH {_MC} SELECT *, round(n / sum(n) OVER (PARTITION BY prediction), 2) AS share FROM counts",
    "misclassification_counts": f"WITH {_MC} SELECT * FROM counts WHERE label <> prediction",
    "expand_confusion": f"""WITH {fx.MULTICLASS_SQL} SELECT label, prediction,
      row_number() OVER (PARTITION BY label, prediction ORDER BY doc_id) AS observation FROM multiclass""",
    "bleu_statistics": f"WITH {_BLEU} SELECT * FROM stats",
    "corpus_bleu": f"""WITH {_BLEU} SELECT round(100 * CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END * exp(logs / 4), 4) AS bleu
      FROM (SELECT avg(ln(correct / total)) * 4 AS logs, max(CASE WHEN "order" = 1 THEN total END) AS h,
        max(CASE WHEN "order" = 1 THEN ref_total END) AS r FROM stats)""",
    "mean_generation_length": rf"WITH {fx.HYPOTHESES_SQL} SELECT round(avg(len(regexp_extract_all(prediction, '\S+'))), 4) AS gen_len FROM hypotheses",
}
