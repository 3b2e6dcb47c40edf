"""Aligned sentences and labelled sentence pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.functions.draws import draw
from glossaria.operators.ids import dimension, scalar


def align_to_target(df: DataFrame, target: str, keep_target: bool = True) -> DataFrame:
    """Pair every language with the target language by sentence position.

    A position holds at most one row per language, so the join key is never hot.
    """
    goal = df.where(F.col("language") == target).select(
        "sentence_id", F.col("text").alias("target"), F.col("language").alias("target_language")
    )
    sources = df if keep_target else df.where(F.col("language") != target)
    return sources.join(goal, "sentence_id").select(
        "sentence_id",
        F.col("text").alias("source"),
        "target",
        F.col("language").alias("source_language"),
        "target_language",
    )


PAIR_COLUMNS = ("draw_id", "language1", "language2", "index1", "index2", "sentence1", "sentence2", "label")


def _attach(df: DataFrame, pairs: DataFrame, indices: DataFrame, label: str) -> DataFrame:
    """Look up the sentences of every index pair, in all wanted language pairs.

    The texts of a position (one per language) are gathered in one row and looked
    up once per index, before language pairs exist; equal indices need one
    look-up. The pairs of both lists are then formed in place.
    """
    texts = df.groupBy("sentence_id").agg(F.collect_list(F.struct("language", "text")).alias("texts"))
    found = indices.join(texts.select(F.col("sentence_id").alias("index1"), F.col("texts").alias("texts1")), "index1")
    if "index2" in indices.columns:
        found = found.join(texts.select(F.col("sentence_id").alias("index2"), F.col("texts").alias("texts2")), "index2")
    else:
        found = found.withColumn("index2", F.col("index1")).withColumn("texts2", F.col("texts1"))
    keys = ("draw_id", "index1", "index2")
    return (
        found.select(*keys, "texts2", F.inline("texts1").alias("language1", "sentence1"))
        .select(*keys, "language1", "sentence1", F.inline("texts2").alias("language2", "sentence2"))
        .join(dimension(pairs.select("language1", "language2")), ["language1", "language2"])
        .withColumn("label", F.lit(label))
        .select(*PAIR_COLUMNS)
    )


def positions(df: DataFrame, language: str) -> DataFrame:
    """Sentence positions of the language that sets the corpus length."""
    return df.where(F.col("language") == language).select(F.col("sentence_id").alias("position"))


def positive_pairs(
    df: DataFrame,
    pairs: DataFrame,
    anchor: str,
    draws: DataFrame | None = None,
    seed: str = "positive",
) -> DataFrame:
    """The same sentence in two languages, label ``yes``.

    Without ``draws`` every position is used. ``draws`` is a table of
    ``draw_id``; each one picks a position of the anchor language with
    replacement, the same one for all language pairs.
    """
    base = positions(df, anchor)
    if draws is None:
        chosen = base.select(F.col("position").alias("draw_id"), F.col("position").alias("index1"))
    else:
        n = scalar(base, F.count(F.lit(1)))
        chosen = draws.select("draw_id", draw(seed, n, F.col("draw_id")).alias("index1"))
    return _attach(df, pairs, chosen, "yes")


def negative_pairs(
    df: DataFrame, pairs: DataFrame, anchor: str, draws: DataFrame, seed: str = "negative"
) -> DataFrame:
    """Different sentences in two languages, label ``no``, ``index1 < index2``.

    Two draws per row choose an unordered pair of positions uniformly, so the
    n * (n - 1) / 2 candidate pairs are never listed. Positions are those of the
    anchor; a draw gives no row for a language that lacks one of the positions.
    """
    n = scalar(positions(df, anchor), F.count(F.lit(1)))
    drawn = draws.select(
        "draw_id",
        draw(seed + ".a", n, F.col("draw_id")).alias("a"),
        draw(seed + ".b", n - 1, F.col("draw_id")).alias("b"),
    ).withColumn("b", F.col("b") + F.when(F.col("b") >= F.col("a"), 1).otherwise(0))
    indices = drawn.select(
        "draw_id", F.least("a", "b").alias("index1"), F.greatest("a", "b").alias("index2")
    ).where(F.col("index1") != F.col("index2"))
    return _attach(df, pairs, indices, "no")


def all_negative_pairs(df: DataFrame, pairs: DataFrame, anchor: str, run: int = 1024) -> DataFrame:
    """All C(n, 2) different sentence pairs, for small corpora.

    The index pairs are generated in runs of ``run`` positions, spread over the
    cluster before they are expanded; the result itself is quadratic.
    """
    base = positions(df, anchor).where(F.col("position") > 0)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("position") - 1, F.lit(run).cast("bigint"))
    runs = base.select("position", F.explode(starts).alias("start")).repartition("position", "start")
    stop = F.least(F.col("start") + run, F.col("position")) - 1
    indices = runs.select(
        F.explode(F.sequence("start", stop)).alias("index1"), F.col("position").alias("index2")
    )
    indices = indices.withColumn("draw_id", F.col("index2") * (F.col("index2") - 1) / 2 + F.col("index1"))
    return _attach(df, pairs, indices.withColumn("draw_id", F.col("draw_id").cast("bigint")), "no")


def draws_like(df: DataFrame, anchor: str) -> DataFrame:
    """As many draws as the anchor language has sentences."""
    return positions(df, anchor).select(F.col("position").alias("draw_id"))


def sentence_pairs_dataset(
    df: DataFrame, pairs: DataFrame, anchor: str, n_pos: int = -1, n_neg: int = -1
) -> DataFrame:
    """Positive and negative pairs of one corpus, all language pairs in one job.

    ``n_pos <= 0`` takes every position; ``n_neg < 0`` draws as many negatives as
    there are positives, ``n_neg == 0`` lists all of them.
    """
    session = df.sparkSession
    drawn = session.range(n_pos).withColumnRenamed("id", "draw_id") if n_pos > 0 else None
    positive = positive_pairs(df, pairs, anchor, drawn)
    if n_neg == 0:
        return positive.unionByName(all_negative_pairs(df, pairs, anchor))
    if n_neg > 0:
        negatives = session.range(n_neg).withColumnRenamed("id", "draw_id")
    else:
        negatives = drawn if drawn is not None else draws_like(df, anchor)
    return positive.unionByName(negative_pairs(df, pairs, anchor, negatives))


def pair_same_language_label(df: DataFrame, out: str = "same_language") -> DataFrame:
    """yes/no: both sentences are in one language."""
    return df.withColumn(out, _yes_no(F.col("language1") == F.col("language2")))


def pair_same_script_label(df: DataFrame, scripts: DataFrame, out: str = "same_script") -> DataFrame:
    """yes/no: both languages have the same first script."""
    from glossaria.operators.recode import add_script_column

    both = add_script_column(df, scripts, "language1", "__s1")
    both = add_script_column(both, scripts, "language2", "__s2")
    return both.withColumn(out, _yes_no(F.col("__s1") == F.col("__s2"))).drop("__s1", "__s2")


def pair_related_label(
    df: DataFrame, distances: DataFrame, max_distance: float, out: str = "related"
) -> DataFrame:
    """yes/no: tree distance of the two languages is at most ``max_distance``."""
    edges = distances.select(
        F.col("lang1").alias("language1"), F.col("lang2").alias("language2"), F.col("distance").alias("__d")
    )
    both_ways = edges.unionByName(
        edges.select(F.col("language2").alias("language1"), F.col("language1").alias("language2"), "__d")
    )
    joined = df.join(dimension(both_ways), ["language1", "language2"], "left")
    close = (F.col("language1") == F.col("language2")) | F.coalesce(F.col("__d") <= max_distance, F.lit(False))
    return joined.withColumn(out, _yes_no(close)).drop("__d")


def _yes_no(condition):
    return F.when(condition, "yes").otherwise("no")


def join_metrics_before_after(before: DataFrame, after: DataFrame, on: str = "language_pair") -> DataFrame:
    """Inner join of two result tables, other columns suffixed."""
    def suffixed(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({c: c + suffix for c in df.columns if c != on})

    return suffixed(before, "_before").join(suffixed(after, "_after"), on)


def name_language_pairs(df: DataFrame, names: DataFrame, out: str = "language_pair_name") -> DataFrame:
    """``a-b`` -> ``Name A - Name B``."""
    parts = F.split("language_pair", "-", 2)
    names = dimension(names)
    n1 = names.select(F.col("language_code").alias("__c1"), F.col("language").alias("__n1"))
    n2 = names.select(F.col("language_code").alias("__c2"), F.col("language").alias("__n2"))
    return (
        df.join(n1, F.get(parts, F.lit(0)) == F.col("__c1"), "left")
        .join(n2, F.get(parts, F.lit(1)) == F.col("__c2"), "left")
        .withColumn(
            out,
            F.concat_ws(
                " - ", F.coalesce("__n1", F.lit("UNKNOWN")), F.coalesce("__n2", F.lit("UNKNOWN"))
            ),
        )
        .drop("__c1", "__n1", "__c2", "__n2")
    )
