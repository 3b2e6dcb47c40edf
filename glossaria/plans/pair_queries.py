"""Aligned sentences, sentence pairs, language distances and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossaria.operators import clusters, combine, common_draws, distance, evaluate, pairs, retrieval
from glossaria.operators.ngrams import divergence_matrix
from glossaria.plans import fixtures as fx
from glossaria.plans.ngram_queries import _DIVERGENCE, _cells
from glossaria.plans.recode_queries import _ALIGNED_SQL
from glossaria.plans.source_queries import _SCRIPTS_SQL, LANGUAGE_NAMES_SQL
from glossaria.sources import names
from glossaria.sources.corpora import language_scripts, save_by_position
from glossaria.sources.shared import materialize

ANCHOR = "fr"
INDEX_PROBES = 8


def align_to_target(spark, sf_dir):
    aligned = pairs.align_to_target(fx.whole(spark, sf_dir), ANCHOR)
    return aligned.select(
        "sentence_id", "source_language", "target_language", F.md5("source").alias("source"), F.md5("target").alias("target")
    )


def aligned_by_bucket(spark, sf_dir):
    """The same alignment from a table that is stored by sentence position, without a shuffle."""
    name = f"corpus_{uuid.uuid4().hex}"
    save_by_position(fx.whole(spark, sf_dir), name, 8)
    aligned = pairs.align_to_target(spark.table(name), ANCHOR)
    return aligned.select(
        "sentence_id", "source_language", "target_language", F.md5("source").alias("source"), F.md5("target").alias("target")
    )


def equal_length_languages(spark, sf_dir):
    kept = fx.docs(spark, sf_dir).select(F.concat_ws("_", "corpus", "source").alias("language"))
    return combine.equal_length_languages(kept, "train_src0", drop_target=True)


def _pair_table(df):
    return combine.language_pairs_ordered(df.select("language").distinct())


def _hashed(df):
    return df.withColumn("sentence1", F.md5("sentence1")).withColumn("sentence2", F.md5("sentence2"))


def _narrow(spark, sf_dir):
    return materialize(fx.whole(spark, sf_dir).select("language", "sentence_id", "text"), "whole")


def positive_pairs(spark, sf_dir):
    data = _narrow(spark, sf_dir)
    return _hashed(pairs.positive_pairs(data, _pair_table(data), ANCHOR))


def positive_pairs_drawn(spark, sf_dir):
    data = _narrow(spark, sf_dir)
    return _hashed(pairs.positive_pairs(data, _pair_table(data), ANCHOR, pairs.draws_like(data, ANCHOR)))


def negative_pairs(spark, sf_dir):
    data = _narrow(spark, sf_dir)
    return _hashed(pairs.negative_pairs(data, _pair_table(data), ANCHOR, pairs.draws_like(data, ANCHOR)))


def _anchor_rows(data):
    return data.where(F.col("language") == ANCHOR).count()


def drawn_positive_pairs(spark, sf_dir):
    data = _narrow(spark, sf_dir)
    return _hashed(common_draws.drawn_positive_pairs(data, _pair_table(data), _anchor_rows(data)))


def drawn_negative_pairs(spark, sf_dir):
    data = _narrow(spark, sf_dir)
    return _hashed(common_draws.drawn_negative_pairs(data, _pair_table(data), _anchor_rows(data)))


def sentence_pairs_dataset(spark, sf_dir):
    base = materialize(fx.corpus(spark, sf_dir).select("corpus", "language", "sentence_id", "text"), "corpus")
    parts = []
    for corpus in ("train", "test"):
        data = base.where(F.col("corpus") == corpus).select("language", "sentence_id", "text")
        built = pairs.sentence_pairs_dataset(data, _pair_table(data), ANCHOR)
        parts.append(built.withColumn("split", F.lit(corpus)))
    return _hashed(combine.concat_datasets(*parts))


def pair_same_language_label(spark, sf_dir):
    a = fx.whole(spark, sf_dir).select("sentence_id", F.col("language").alias("language1"))
    b = fx.whole(spark, sf_dir).select("sentence_id", F.col("language").alias("language2"))
    return pairs.pair_same_language_label(a.join(b, "sentence_id"))


def pair_same_script_label(spark, sf_dir):
    scripts = language_scripts(fx.all_varieties(spark, sf_dir).distinct())
    labelled = pair_same_language_label(spark, sf_dir).drop("same_language")
    return pairs.pair_same_script_label(labelled, scripts)


def _edges(spark, sf_dir):
    return distance.classification_distance(distance.classification_paths(fx.paths(spark, sf_dir)))


def pair_related_label(spark, sf_dir):
    groups = fx.paths(spark, sf_dir).groupBy(F.col("iso").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    grid = combine.language_pairs_grid(groups).select("language1", "language2")
    return pairs.pair_related_label(grid, _edges(spark, sf_dir), 3)


def _outcomes(spark, sf_dir):
    data = fx.predictions(spark, sf_dir)
    return [evaluate.error_count(data.where(F.col("phase") == p), ["language_pair"]) for p in ("before", "after")]


def join_metrics_before_after(spark, sf_dir):
    return pairs.join_metrics_before_after(*_outcomes(spark, sf_dir))


def name_language_pairs(spark, sf_dir):
    table = names.language_names(fx.name_table(spark, sf_dir))
    counts = evaluate.error_count(fx.predictions(spark, sf_dir), ["language_pair", "phase"])
    return pairs.name_language_pairs(counts, table)


def classification_distance(spark, sf_dir):
    return _edges(spark, sf_dir)


def classification_distance_exact(spark, sf_dir):
    return distance.classification_distance(distance.classification_paths(fx.paths(spark, sf_dir)), exact=True)


def distance_matrix(spark, sf_dir):
    edges = divergence_matrix(_cells(spark, sf_dir)).where(F.col("lang1") < F.col("lang2"))
    edges = edges.withColumnRenamed("num_disagreements", "distance")
    return distance.distance_matrix(edges, ["de", "en", "es", "fr"])


def mean_distance(spark, sf_dir):
    return distance.mean_distance(_edges(spark, sf_dir))


def nearest_farthest_languages(spark, sf_dir):
    return distance.nearest_farthest_languages(_edges(spark, sf_dir), 5)


def cosine_distances(spark, sf_dir):
    return retrieval.cosine_distance_profile(fx.vectors(spark, sf_dir))


def retrieval_ranks(spark, sf_dir):
    return retrieval.retrieval_ranks(fx.vectors(spark, sf_dir))


def nearest_candidates(spark, sf_dir):
    return retrieval.nearest_candidates(fx.vectors(spark, sf_dir), 5)


def pruned_ranks(spark, sf_dir):
    return clusters.ranks(fx.vectors(spark, sf_dir)).drop("compared")


def _asked(vectors):
    return vectors.where(F.col("sentence_id") % 50 == 0).select("model", "language", "sentence_id")


def indexed_nearest(spark, sf_dir):
    """Every fiftieth vector against all, by inverted lists and the bounds of what they leave out."""
    vectors = fx.vectors(spark, sf_dir, numbered=False)
    return clusters.nearest(clusters.build(vectors), _asked(vectors), 5)


def index_recall(spark, sf_dir):
    """What the nearest lists alone find of the rows that comparing all vectors finds."""
    vectors = fx.vectors(spark, sf_dir, numbered=False)
    found = clusters.nearest(clusters.build(vectors), _asked(vectors), 5, INDEX_PROBES, exact=False)
    truth = retrieval.nearest_candidates(vectors, 5, asked=_asked(vectors))
    return clusters.recall(found, truth).select("model", "n_rows", (F.col("recall") >= 0.9).alias("enough"))


def similarity_search_summary(spark, sf_dir):
    return retrieval.similarity_search_summary(retrieval_ranks(spark, sf_dir))


def mrr_pairwise(spark, sf_dir):
    return retrieval.mrr_pairwise(retrieval_ranks(spark, sf_dir))


def retrieval_sweep(spark, sf_dir):
    return retrieval.similarity_search_summary(retrieval_ranks(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        align_to_target, aligned_by_bucket, equal_length_languages, positive_pairs, positive_pairs_drawn, negative_pairs,
        drawn_positive_pairs, drawn_negative_pairs, sentence_pairs_dataset, pair_same_language_label, pair_same_script_label, pair_related_label,
        join_metrics_before_after, name_language_pairs, classification_distance, classification_distance_exact,
        distance_matrix, mean_distance, nearest_farthest_languages, cosine_distances, retrieval_ranks, nearest_candidates,
        pruned_ranks, indexed_nearest, index_recall, similarity_search_summary, mrr_pairwise, retrieval_sweep,
    )
}


def draw_sql(seed: str, n: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT % ({n}))"


def _pairs_sql(rows: str, tag: str) -> str:
    """CTEs of positive, drawn positive and negative pairs of one corpus."""
    n = f"(SELECT count(*) FROM c{tag} WHERE language = '{ANCHOR}')"
    a, b = draw_sql("negative.a", n, "sentence_id"), draw_sql("negative.b", f"{n} - 1", "sentence_id")
    columns = """d.draw_id, x.language AS language1, y.language AS language2, d.index1, d.index2,
      md5(x.text) AS sentence1, md5(y.text) AS sentence2"""
    joined = f"""JOIN c{tag} x ON x.sentence_id = d.index1
      JOIN c{tag} y ON y.sentence_id = d.index2 AND y.language <> x.language"""
    return f"""c{tag} AS (SELECT language, sentence_id, text FROM {rows}),
anchor{tag} AS (SELECT sentence_id FROM c{tag} WHERE language = '{ANCHOR}'),
pos{tag} AS (SELECT {columns}, 'yes' AS label FROM (SELECT sentence_id AS draw_id, sentence_id AS index1, sentence_id AS index2
  FROM anchor{tag}) d {joined}),
drawn{tag} AS (SELECT {columns}, 'yes' AS label FROM (SELECT sentence_id AS draw_id,
    {draw_sql("positive", n, "sentence_id")} AS index1, {draw_sql("positive", n, "sentence_id")} AS index2 FROM anchor{tag}) d {joined}),
neg{tag} AS (SELECT {columns}, 'no' AS label FROM (SELECT draw_id, least(a, b) AS index1, greatest(a, b) AS index2 FROM (
    SELECT draw_id, a, b0 + CASE WHEN b0 >= a THEN 1 ELSE 0 END AS b FROM (
      SELECT sentence_id AS draw_id, {a} AS a, {b} AS b0 FROM anchor{tag})) WHERE a <> b) d {joined})"""


_PAIRS = f"{fx.CORPUS_SQL}, {_pairs_sql("corpus WHERE corpus = 'train'", '1')}, {_pairs_sql("corpus WHERE corpus = 'test'", '2')}"
_WHOLE_PAIRS = f"{fx.WHOLE_SQL}, {_pairs_sql('whole', '0')}"
_DRAW_KEY = "draw_id || ':' || language1 || ':' || language2"
_COMMON = f"""{fx.WHOLE_SQL}, common AS (
  SELECT x.language AS language1, y.language AS language2, x.sentence_id, md5(x.text) AS t1, md5(y.text) AS t2,
    row_number() OVER (PARTITION BY x.language, y.language ORDER BY x.sentence_id) - 1 AS rank
  FROM whole x JOIN whole y ON x.sentence_id = y.sentence_id AND x.language <> y.language),
draws AS (SELECT language1, language2, total, draw_id FROM (SELECT language1, language2, count(*) AS total FROM common GROUP BY ALL),
  (SELECT unnest(range((SELECT count(*) FROM whole WHERE language = '{ANCHOR}'))) AS draw_id)),
ranks AS (SELECT *, {draw_sql("positive", "total", _DRAW_KEY)} AS r, {draw_sql("negative.a", "total", _DRAW_KEY)} AS a,
  {draw_sql("negative.b", "(total - 1)", _DRAW_KEY)} AS b FROM draws)"""
_LANG_PAIRS = f"""{fx.WHOLE_SQL}, lp AS (SELECT a.sentence_id, a.language AS language1, b.language AS language2
  FROM whole a JOIN whole b USING (sentence_id))"""
_ERRORS = f"""{fx.PREDICTIONS_SQL}, errors AS (SELECT phase, language_pair, count(*) FILTER (WHERE label <> prediction) AS errors
  FROM predictions GROUP BY ALL)"""
_EDGES = f"{fx.PATHS_SQL}, both_ways AS (SELECT * FROM edges UNION ALL SELECT lang2, lang1, distance FROM edges)"

ORACLES = {
    "align_to_target": f"""WITH {_ALIGNED_SQL} SELECT sentence_id, source_language, target_language, md5(source) AS source,
      md5(target) AS target FROM aligned""",
    "aligned_by_bucket": f"""WITH {_ALIGNED_SQL} SELECT sentence_id, source_language, target_language, md5(source) AS source,
      md5(target) AS target FROM aligned""",
    "equal_length_languages": f"""WITH {fx.DOCS_SQL}, s AS (SELECT corpus || '_' || source AS language, count(*) AS n_rows FROM docs GROUP BY 1)
      SELECT * FROM s WHERE n_rows = (SELECT n_rows FROM s WHERE language = 'train_src0') AND language <> 'train_src0'""",
    "positive_pairs": f"WITH {_WHOLE_PAIRS} SELECT * FROM pos0",
    "positive_pairs_drawn": f"WITH {_WHOLE_PAIRS} SELECT * FROM drawn0",
    "drawn_positive_pairs": f"""WITH {_COMMON} SELECT draw_id, language1, language2, sentence_id AS index1, sentence_id AS index2,
        t1 AS sentence1, t2 AS sentence2, 'yes' AS label
      FROM ranks JOIN common c USING (language1, language2) WHERE c.rank = r""",
    "drawn_negative_pairs": f"""WITH {_COMMON}, chosen AS (
        SELECT draw_id, language1, language2, least(a, b + CASE WHEN b >= a THEN 1 ELSE 0 END) AS low,
          greatest(a, b + CASE WHEN b >= a THEN 1 ELSE 0 END) AS high FROM ranks)
      SELECT draw_id, language1, language2, x.sentence_id AS index1, y.sentence_id AS index2, x.t1 AS sentence1, y.t2 AS sentence2, 'no' AS label
      FROM chosen JOIN common x USING (language1, language2) JOIN common y USING (language1, language2) WHERE x.rank = low AND y.rank = high""",
    "negative_pairs": f"WITH {_WHOLE_PAIRS} SELECT * FROM neg0",
    "sentence_pairs_dataset": f"""WITH {_PAIRS} SELECT *, 'train' AS split FROM pos1 UNION ALL SELECT *, 'train' FROM neg1
      UNION ALL SELECT *, 'test' FROM pos2 UNION ALL SELECT *, 'test' FROM neg2""",
    "pair_same_language_label": f"""WITH {_LANG_PAIRS} SELECT *, CASE WHEN language1 = language2 THEN 'yes' ELSE 'no' END AS same_language FROM lp""",
    "pair_same_script_label": f"""WITH {_LANG_PAIRS}, {_SCRIPTS_SQL} SELECT lp.*, CASE WHEN coalesce(x.scripts[1], 'unknown')
      = coalesce(y.scripts[1], 'unknown') THEN 'yes' ELSE 'no' END AS same_script FROM lp
      LEFT JOIN scripts x ON x.language = language1 LEFT JOIN scripts y ON y.language = language2""",
    "pair_related_label": f"""WITH {_EDGES} SELECT a.iso AS language1, b.iso AS language2,
      CASE WHEN a.iso = b.iso OR e.distance <= 3 THEN 'yes' ELSE 'no' END AS related
      FROM paths a CROSS JOIN paths b LEFT JOIN both_ways e ON e.lang1 = a.iso AND e.lang2 = b.iso""",
    "join_metrics_before_after": f"""WITH {_ERRORS} SELECT a.language_pair, a.errors AS errors_before, b.errors AS errors_after
      FROM errors a JOIN errors b USING (language_pair) WHERE a.phase = 'before' AND b.phase = 'after'""",
    "name_language_pairs": f"""WITH {LANGUAGE_NAMES_SQL}, {_ERRORS} SELECT language_pair, phase, errors,
      coalesce(x.language, 'UNKNOWN') || ' - ' || coalesce(y.language, 'UNKNOWN') AS language_pair_name FROM errors
      LEFT JOIN named x ON x.language_code = split_part(language_pair, '-', 1)
      LEFT JOIN named y ON y.language_code = split_part(language_pair, '-', 2)""",
    "classification_distance": f"WITH {_EDGES} SELECT lang1, lang2, distance FROM edges",
    "classification_distance_exact": f"""WITH {fx.PATHS_SQL.replace("least(len(a.p), len(b.p)) - 1) AS", "least(len(a.p), len(b.p))) AS")}
      SELECT lang1, lang2, distance FROM edges""",
    "distance_matrix": f"""WITH {_DIVERGENCE}, full_matrix AS (SELECT * FROM divergence UNION ALL SELECT language, language, 0 FROM langs)
      SELECT lang1, {', '.join(f"max(CASE WHEN lang2 = '{x}' THEN num_disagreements END) AS {x}" for x in ('de', 'en', 'es', 'fr'))}
      FROM full_matrix GROUP BY lang1""",
    "mean_distance": f"""WITH {_EDGES} SELECT count(*) AS n_pairs,
      round(2 * sum(distance) / ((SELECT count(*) FROM paths) * (SELECT count(*) FROM paths)), 2) AS mean_distance FROM edges""",
    "nearest_farthest_languages": f"""WITH {_EDGES} SELECT lang1, lang2, distance, 'best' AS kind,
      row_number() OVER (PARTITION BY lang1 ORDER BY distance, lang2) AS position FROM both_ways QUALIFY position <= 5
      UNION ALL SELECT lang1, lang2, distance, 'worst', row_number() OVER (PARTITION BY lang1 ORDER BY distance DESC, lang2) AS position
      FROM both_ways QUALIFY position <= 5""",
    "cosine_distances": f"""WITH {fx.VECTORS_SQL} SELECT model, lang1, lang2, sentence_id, count(*) AS n_candidates, min(d) AS nearest,
      max(d) AS farthest, (CAST(sum(CAST(round(d * 1e9) AS BIGINT)) AS BIGINT) // count(*)) / 1e9 AS mean_distance FROM dists GROUP BY ALL""",
    "retrieval_ranks": f"WITH {fx.VECTORS_SQL} SELECT * FROM ranks",
    "nearest_candidates": f"""WITH {fx.VECTORS_SQL} SELECT model, lang1, lang2, sentence_id, candidate_id, d AS distance,
      row_number() OVER (PARTITION BY model, lang1, lang2, sentence_id ORDER BY d, candidate_id) AS position FROM dists
      QUALIFY position <= 5""",
    "pruned_ranks": f"WITH {fx.VECTORS_SQL} SELECT * FROM ranks",
    "indexed_nearest": f"""WITH {fx.VECTORS_BY_ID_SQL} SELECT model, lang1, lang2, sentence_id, candidate_id, d AS distance,
      row_number() OVER (PARTITION BY model, lang1, lang2, sentence_id ORDER BY d, candidate_id) AS position FROM dists
      WHERE sentence_id % 50 = 0 QUALIFY position <= 5""",
    "index_recall": f"""WITH {fx.VECTORS_BY_ID_SQL}, best AS (SELECT model, row_number() OVER (
        PARTITION BY model, lang1, lang2, sentence_id ORDER BY d, candidate_id) AS position FROM dists
      WHERE sentence_id % 50 = 0 QUALIFY position <= 5)
      SELECT model, count(*) AS n_rows, true AS enough FROM best GROUP BY model""",
    "similarity_search_summary": f"""WITH {fx.VECTORS_SQL} SELECT model, lang1, lang2, count(*) AS n_queries, round(avg(rank), 6) AS avg_rank,
      round(stddev_samp(rank), 6) AS std_rank, round(avg(1 / rank), 6) AS mrr FROM ranks GROUP BY ALL""",
    "mrr_pairwise": f"""WITH {fx.VECTORS_SQL} SELECT model, lang1, lang2, round(avg(1 / rank), 6) AS mrr FROM ranks GROUP BY ALL""",
    "retrieval_sweep": f"""WITH {fx.VECTORS_SQL} SELECT model, lang1, lang2, count(*) AS n_queries, round(avg(rank), 6) AS avg_rank,
      round(stddev_samp(rank), 6) AS std_rank, round(avg(1 / rank), 6) AS mrr FROM ranks GROUP BY ALL""",
}
