"""Morphological features of words and of their subwords.

Inputs: ``analyses(form, features)`` with semicolon-separated features, and
``segments(word, pieces)`` with one row per distinct word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.text import explode_terms, posexplode_terms


def feature_rows(analyses: DataFrame) -> DataFrame:
    """One row per feature of each analysis."""
    return analyses.select("form", F.explode(F.split("features", ";")).alias("feature"))


def analyse_word_features(analyses: DataFrame) -> DataFrame:
    """Feature counts over all analyses of each word; empty features are skipped."""
    rows = feature_rows(analyses).where(F.col("feature") != "")
    return rows.groupBy("form", "feature").agg(F.count(F.lit(1)).alias("n"))


def word_subword_features(segments: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every distinct feature of a word with every distinct subword of it.

    Both sides are distinct per word, so a word contributes at most (its
    features x its subwords) rows.
    """
    features = feature_rows(analyses).distinct()
    pieces = segments.select(F.col("word").alias("form"), explode_terms("pieces").alias("subword")).distinct()
    return pieces.join(features, "form").select(F.col("form").alias("word"), "subword", "feature")


def subword_feature_matrix(triples: DataFrame) -> DataFrame:
    """(subword, feature) -> number of words; long form of the matrix."""
    return triples.groupBy("subword", "feature").agg(F.count(F.lit(1)).alias("n"))


def subword_feature_matrix_wide(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Wide matrix, 0-filled, for a list of features."""
    return matrix.groupBy("subword").pivot("feature", features).agg(F.sum("n")).fillna(0)


def features_on(matrix: DataFrame) -> DataFrame:
    """Row sum of the matrix and token length per subword."""
    sums = matrix.groupBy("subword").agg(F.sum("n").alias("num_features_on"))
    return sums.withColumn("token_length", F.length("subword").cast("bigint"))


def word_feature_matrix(triples: DataFrame) -> DataFrame:
    """(word, feature) weighted by the number of distinct subwords of the word."""
    return triples.groupBy("word", "feature").agg(F.count(F.lit(1)).alias("n"))


def word_features(triples: DataFrame) -> DataFrame:
    """Unweighted features of each segmented word."""
    return triples.select("word", "feature").distinct()


def top_per_key(matrix: DataFrame, key: str, item: str, top: int) -> DataFrame:
    """The ``top`` items of each key by count, ties in item order.

    The filter on the row number lets each task cut its part of a large key to
    ``top`` rows before the shuffle.
    """
    window = Window.partitionBy(key).orderBy(F.desc("n"), item)
    ranked = matrix.withColumn("position", F.row_number().over(window).cast("bigint"))
    return ranked.where(F.col("position") <= top).select(key, "position", item, "n")


def top_subwords_for_feature(subword_matrix: DataFrame, top: int = 10) -> DataFrame:
    return top_per_key(subword_matrix, "feature", "subword", top)


def top_words_for_feature(word_matrix: DataFrame, top: int = 10) -> DataFrame:
    return top_per_key(word_matrix, "feature", "word", top)


def top_features_for_subword(subword_matrix: DataFrame, top: int = 10) -> DataFrame:
    return top_per_key(subword_matrix, "subword", "feature", top)


def feature_report(
    triples: DataFrame, segments: DataFrame, top_words: int = 3, top_features: int = 3
) -> DataFrame:
    """Feature -> top words -> their subwords -> each subword's top features.

    One row per (feature, word): ``graph`` is an array of (subword, features),
    ``word_features`` lists the word's own features. A word has few subwords and
    a subword contributes ``top_features`` features, so the arrays stay small.
    """
    best = top_words_for_feature(word_feature_matrix(triples), top_words)
    ranked = top_features_for_subword(subword_feature_matrix(triples), top_features)
    listed = F.array_sort(F.collect_list(F.struct("position", "feature")))
    per_subword = ranked.groupBy("subword").agg(listed.alias("l")).select(
        "subword", F.transform("l", lambda x: x["feature"]).alias("features")
    )
    pieces = segments.select("word", posexplode_terms("pieces").alias("at", "subword"))
    nodes = (
        best.select("feature", "position", "word")
        .join(pieces, "word")
        .join(per_subword, "subword")
        .groupBy("feature", "position", "word")
        .agg(F.array_sort(F.collect_list(F.struct("at", "subword", "features"))).alias("graph"))
    )
    own = word_features(triples).groupBy("word").agg(F.array_sort(F.collect_list("feature")).alias("word_features"))
    return nodes.join(own, "word")
