"""Distances between languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classification_paths(df: DataFrame, position: str = "position") -> DataFrame:
    """One path per language: rows with a missing value dropped, last path wins.

    The position is that of the first row of the language.
    """
    clean = df.na.drop("any")
    return clean.groupBy("iso").agg(
        F.max_by("classification", position).alias("classification"), F.min(position).alias("position")
    )


def path_steps(path1, path2, exact: bool = False):
    """Steps between two nodes given as arrays of family names.

    By default the length of the common prefix is capped at one less than the
    shorter path, which is how the published distances were produced; ``exact``
    gives the plain tree distance.
    """
    shorter = F.least(F.size(path1), F.size(path2))
    levels = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    common = F.size(F.filter(levels, lambda k: F.slice(path1, 1, k) == F.slice(path2, 1, k)))
    depth = common if exact else F.least(common, shorter - 1)
    return (F.size(path1) + F.size(path2) - F.lit(2) * depth).cast("bigint")


def classification_distance(paths: DataFrame, exact: bool = False) -> DataFrame:
    """Distance of every unordered language pair, oriented by first position.

    Meant for a table of languages (thousands): the list of all languages is a
    scalar subquery and each language is paired with the later part of it.
    """
    nodes = F.struct("position", "iso", F.split("classification", "/").alias("path"))
    everyone = paths.agg(F.collect_list(nodes).alias("value")).scalar()
    pairs = paths.select(
        "iso", "position", F.split("classification", "/").alias("path"), F.explode(everyone).alias("o")
    ).where(F.col("o.position") > F.col("position"))
    return pairs.select(
        F.col("iso").alias("lang1"),
        F.col("o.iso").alias("lang2"),
        path_steps(F.col("path"), F.col("o.path"), exact).alias("distance"),
    )


def _entry(lang1: str, lang2: str, distance: Column) -> Column:
    return F.struct(F.col(lang1).alias("lang1"), F.col(lang2).alias("lang2"), distance.alias("distance"))


def mirrored(edges: DataFrame, diagonal: bool = False) -> DataFrame:
    """Both directions of an unordered edge list, from one pass over it.

    ``diagonal`` adds the zero distance of both ends (repeated per edge).
    """
    distance = F.col("distance")
    entries = [_entry("lang1", "lang2", distance), _entry("lang2", "lang1", distance)]
    if diagonal:
        zero = F.lit(0).cast(edges.schema["distance"].dataType)
        entries += [_entry("lang1", "lang1", zero), _entry("lang2", "lang2", zero)]
    return edges.select(F.inline(F.array(*entries)))


def distance_matrix(edges: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Square display form of an edge list, 0 on the diagonal."""
    grouped = mirrored(edges, diagonal=True).groupBy("lang1")
    pivoted = grouped.pivot("lang2", languages) if languages else grouped.pivot("lang2")
    return pivoted.agg(F.max("distance"))


def mean_distance(edges: DataFrame) -> DataFrame:
    """Mean over the full square matrix (diagonal included), 2 digits."""
    sums = mirrored(edges).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("distance").alias("total"), F.count_distinct("lang1").alias("n")
    )
    return sums.select(
        (F.col("n_cells") / 2).cast("bigint").alias("n_pairs"),
        F.round(F.col("total") / (F.col("n") * F.col("n")), 2).alias("mean_distance"),
    )


def nearest_farthest_languages(edges: DataFrame, n: int) -> DataFrame:
    """The n nearest and the n farthest languages of every language.

    Both rankings share one partitioning by language; a partition holds one row
    per other language.
    """
    per_language = Window.partitionBy("lang1")
    ranked = mirrored(edges).select(
        "lang1", "lang2", "distance",
        F.row_number().over(per_language.orderBy(F.asc("distance"), "lang2")).alias("__best"),
        F.row_number().over(per_language.orderBy(F.desc("distance"), "lang2")).alias("__worst"),
    )
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(f"__{kind}").cast("bigint").alias("position"))
            for kind in ("best", "worst")
        ]
    )
    return ranked.select("lang1", "lang2", "distance", F.inline(kinds)).where(F.col("position") <= n)
