"""Language names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.operators.ids import dimension

# Names that replace those of the table.
NAME_OVERRIDES = {"ckb": "Kurdish", "snd": "Sindhi", "tgk": "Tajik", "zho": "Chinese"}


def language_names(
    names: DataFrame, position: str = "position", overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """Code -> name, completed by codes without script.

    A code without script takes the name without parenthesis of the last
    variant, unless the code is in the table. Overrides win over everything.
    """
    base = names.select("language_code", "language")
    short = names.select(
        F.split_part("language_code", F.lit("-"), F.lit(1)).alias("language_code"),
        F.trim(F.regexp_replace("language", r"\(.*\)", "")).alias("language"),
        F.col(position).alias("__p"),
    )
    added = (
        short.join(base.select("language_code"), "language_code", "left_anti")
        .groupBy("language_code")
        .agg(F.max_by("language", "__p").alias("language"))
    )
    full = base.unionByName(added)
    if not overrides:
        return full
    fixed = names.sparkSession.createDataFrame(list(overrides.items()), "language_code string, language string")
    return full.join(fixed.select("language_code"), "language_code", "left_anti").unionByName(fixed)


def display_name(df: DataFrame, names: DataFrame, column: str = "language", out: str = "display") -> DataFrame:
    """``Name (code)``, ``UNKNOWN (code)`` without an entry."""
    lookup = names.select(F.col("language_code").alias("__c"), F.col("language").alias("__n"))
    label = F.concat(F.coalesce("__n", F.lit("UNKNOWN")), F.lit(" ("), F.col(column), F.lit(")"))
    return df.join(dimension(lookup), F.col(column) == F.col("__c"), "left").withColumn(out, label).drop("__c", "__n")


def name_by_prefix(codes: DataFrame, names: DataFrame, column: str = "language", position: str = "position") -> DataFrame:
    """First name of the table whose code starts with each given code.

    Every table code is expanded to its prefixes, which turns the prefix match
    into an equi-join.
    """
    prefixes = names.where(F.length("language_code") > 0).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("language_code")), lambda k: F.substring("language_code", F.lit(1), k)
            )
        ).alias("__prefix"),
        F.trim("language").alias("__name"),
        F.col(position).alias("__p"),
    )
    first = prefixes.groupBy("__prefix").agg(F.min_by("__name", "__p").alias("name"))
    return codes.join(first, F.col(column) == F.col("__prefix"), "left").drop("__prefix")
