"""Concatenation, set operations on languages and label subsets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.operators.ids import dimension

def concat_datasets(*datasets: DataFrame) -> DataFrame:
    """Stack datasets by column name."""
    return reduce(DataFrame.unionByName, datasets)


def languages(df: DataFrame) -> DataFrame:
    """Distinct languages of a corpus (partially aggregated before the shuffle)."""
    return df.select("language").distinct()


def common_languages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Languages present in both corpora."""
    return languages(a).intersect(languages(b))


def missing_languages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Languages of ``a`` that ``b`` lacks."""
    return languages(a).join(languages(b), "language", "left_anti")


def language_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of the languages of ``a`` found in ``b``, percent with 2 digits."""
    marked = languages(a).join(languages(b).withColumn("hit", F.lit(1)), "language", "left")
    n, shared = F.count(F.lit(1)), F.count("hit")
    return marked.agg(
        n.alias("n_languages"),
        shared.alias("n_shared"),
        F.round(F.lit(100.0) * shared / F.nullif(n, F.lit(0)), 2).alias("coverage_percent"),
    )


def restrict_to_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose language also occurs in ``b``."""
    return a.join(dimension(languages(b)), "language", "left_semi")


def select_train_test(
    a: DataFrame,
    b: DataFrame,
    train_languages: Sequence[str] | str | None = None,
    test_languages: Sequence[str] | None = None,
) -> DataFrame:
    """Train languages of corpus ``a`` and test languages of corpus ``b``.

    Empty means all; ``"common"`` means those of ``a`` that ``b`` has too.
    """
    if train_languages == "common":
        train = restrict_to_common(a, b)
    else:
        train = a.where(F.col("language").isin(list(train_languages))) if train_languages else a
    test = b.where(F.col("language").isin(list(test_languages))) if test_languages else b
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def split_by_label(
    df: DataFrame, label: str = "language", key: str = "sentence_id", part_rows: int = 256
) -> DataFrame:
    """Texts of each label as ordered lists.

    A label may own most of the corpus, so its list comes in consecutive parts
    of ``part_rows`` positions; all parts together are the whole list.
    """
    part = F.floor(F.col(key) / F.lit(part_rows)).cast("bigint").alias("part")
    members = F.array_sort(F.collect_list(F.struct(F.col(key).alias("position"), "text")))
    grouped = df.groupBy(F.col(label), part).agg(members.alias("members"))
    return grouped.select(label, "part", F.col("members.text").alias("texts"))


def write_label_subsets(df: DataFrame, path: str, label: str = "language") -> None:
    """One folder per label; rows are not moved between tasks."""
    df.write.mode("error").partitionBy(label).parquet(path)


def language_pairs_ordered(language_table: DataFrame, first: str | None = None) -> DataFrame:
    """Ordered pairs ``a-b`` with a != b, optionally only those starting with ``first``."""
    pairs = _pair_up(language_table).where(F.col("language1") != F.col("language2"))
    if first:
        pairs = pairs.where(F.col("language_pair").startswith(f"{first}-"))
    return pairs


def language_pairs_unordered(language_table: DataFrame, position: str = "position") -> DataFrame:
    """Each pair once, oriented by first appearance."""
    everyone = language_table.agg(F.collect_list(F.struct(F.col(position).alias("p"), "language")).alias("value"))
    pairs = language_table.select(
        F.col("language").alias("language1"), F.col(position).alias("__p"), F.explode(everyone.scalar()).alias("other")
    ).where(F.col("other.p") > F.col("__p"))
    return pairs.select("language1", F.col("other.language").alias("language2")).withColumn(
        "language_pair", F.concat_ws("-", "language1", "language2")
    )


def language_pairs_grid(language_table: DataFrame) -> DataFrame:
    """All L x L pairs, self pairs included."""
    return _pair_up(language_table)


def _pair_up(language_table: DataFrame) -> DataFrame:
    """Grid over a table of languages: every language gets the list of all of them.

    The list is a scalar subquery over distinct languages; its length is the
    number of languages (hundreds), not the number of sentences.
    """
    names = languages(language_table)
    everyone = names.agg(F.array_sort(F.collect_set("language")).alias("value")).scalar()
    pairs = names.select(F.col("language").alias("language1"), F.explode(everyone).alias("language2"))
    return pairs.withColumn("language_pair", F.concat_ws("-", "language1", "language2"))


def equal_length_languages(
    df: DataFrame, target: str, drop_target: bool = False, drop_source: str | None = None
) -> DataFrame:
    """Languages with as many rows as the target language, with their row count."""
    sizes = df.groupBy("language").agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = sizes.where(F.col("language") == target).select("n_rows")
    kept = sizes.join(wanted, "n_rows", "left_semi").select("language", "n_rows")
    if drop_target:
        kept = kept.where(F.col("language") != target)
    return kept.where(F.col("language") != drop_source) if drop_source else kept
