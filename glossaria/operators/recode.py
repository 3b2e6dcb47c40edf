"""Filters, renames and row-wise recoding."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.draws import hash_key
from glossaria.operators.ids import dimension

# Languages with a Cyrillic spelling, their codes in two corpora
# and in the romanization tables.
CYRILLIC_LANGUAGES = (
    ("Bulgarian", "bul", "bul", "bg"),
    ("Macedonian", "mkd", "mkd", "mk"),
    ("Mongolian", "khk", "mon", "mn"),
    ("Russian", "rus", "rus", "ru"),
    ("Serbian", "srp", "srp", "sr"),
    ("Tajik", "tgk", "tgk", "tj"),
    ("Ukrainian", "ukr", "ukr", "ua"),
)


def strip_script(df: DataFrame, separator: str = "_", position: str = "sentence_id") -> DataFrame:
    """``fin_Latn`` -> ``fin``; of several scripts the last by name is kept.

    Adds ``script`` so that the choice stays visible. The aggregate keeps one
    row per sentence on the map side, so only winners are shuffled.
    """
    parts = df.withColumn("script", F.coalesce(F.get(F.split("language", separator), F.lit(1)), F.lit("")))
    parts = parts.withColumn("language", F.split_part(F.col("language"), F.lit(separator), F.lit(1)))
    keys = [c for c in ("corpus", "split") if c in df.columns] + ["language", position]
    rest = [c for c in parts.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col("script")).alias("best")
    return parts.groupBy(*keys).agg(best).select(*keys, "best.*")


def filter_language(df: DataFrame, language: str, column: str = "language") -> DataFrame:
    """Rows of one language; ``all`` means no filter."""
    return df if language == "all" else df.where(F.col(column) == language)


def sql_filter(df: DataFrame, condition: str, args: Mapping[str, object]) -> DataFrame:
    """Ad-hoc SQL filter over a dataset with named parameters."""
    query = "SELECT * FROM {data} WHERE " + condition
    return df.sparkSession.sql(query, args=dict(args), data=df)


def rename_if_missing(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rename ``source`` to ``target`` unless ``target`` exists already."""
    return reduce(
        lambda acc, pair: acc if pair[1] in acc.columns else acc.withColumnRenamed(*pair), pairs, df
    )


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append a computed column."""
    return df.withColumn(name, value)


def add_script_column(
    df: DataFrame, scripts: DataFrame, language: str = "language", out: str = "script"
) -> DataFrame:
    """First script of each row's language, ``unknown`` where there is none.

    ``scripts`` has one row per language: ``(language, scripts array)``.
    """
    first = scripts.select(
        F.col("language").alias("__language"), F.get("scripts", F.lit(0)).alias("__script")
    )
    return (
        df.join(dimension(first), F.col(language) == F.col("__language"), "left")
        .withColumn(out, F.coalesce("__script", F.lit("unknown")))
        .drop("__language", "__script")
    )


def recode_language(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    drop_suffix: str | None = None,
    column: str = "language",
) -> DataFrame:
    """Rewrite language codes: drop a script suffix, then map single codes."""
    code = F.col(column)
    if drop_suffix:
        code = F.replace(code, F.lit(drop_suffix), F.lit(""))
    if mapping:
        code = F.coalesce(_lookup(mapping, code), code)
    return df.withColumn(column, code)


def language_code_table(df: DataFrame, column: str = "language") -> DataFrame:
    """Add name and romanization code of Cyrillic-script languages."""
    names = {code: name for name, first, second, _ in CYRILLIC_LANGUAGES for code in (first, second)}
    codes = {name: code for name, _, _, code in CYRILLIC_LANGUAGES}
    named = df.withColumn("language_name", _lookup(names, F.col(column)))
    return named.withColumn("romanization_code", _lookup(codes, F.col("language_name")))


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def translation_prompt(df: DataFrame, add_prefix: bool = True, out: str = "prompt") -> DataFrame:
    """``Translate from {source} to {target}: {text}``."""
    if not add_prefix:
        return df.withColumn(out, F.col("source"))
    return df.withColumn(
        out,
        F.concat(
            F.lit("Translate from "), "source_language", F.lit(" to "), "target_language", F.lit(": "), "source"
        ),
    )


def label_vocabulary(*datasets: DataFrame, column: str = "label") -> DataFrame:
    """Sorted distinct labels of all datasets with ids 0..k-1.

    The unpartitioned window runs over distinct labels only.
    """
    labels = reduce(DataFrame.unionByName, [d.select(column) for d in datasets]).distinct()
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column))
    return labels.where(F.col(column).isNotNull()).withColumn("label_id", (rank - 1).cast("bigint"))


def encode_labels(df: DataFrame, vocabulary: DataFrame, column: str = "label") -> DataFrame:
    """Label -> id."""
    return df.join(dimension(vocabulary), column, "left")


def decode_labels(df: DataFrame, vocabulary: DataFrame, column: str = "label_id") -> DataFrame:
    """Id -> label."""
    return df.join(dimension(vocabulary), column, "left")


def same_language_rows(df: DataFrame) -> DataFrame:
    """Redundant translation rows: source and target language agree."""
    return df.where(F.col("source_language") == F.col("target_language"))


def argmax_prediction(df: DataFrame, scores: str = "scores", out: str = "prediction") -> DataFrame:
    """Index of the best score, the first one on ties."""
    position = F.array_position(F.col(scores), F.array_max(scores))
    return df.withColumn(out, (position - 1).cast("bigint"))


def random_rows(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """``n`` random rows without replacement, a per-partition top-n plus merge."""
    order = hash_key(seed, F.col(key))
    return df.orderBy(order, key).limit(n)


def random_row_per_language(df: DataFrame, seed: str, key: str, language: str = "language") -> DataFrame:
    """One random sentence of every language."""
    rest = [c for c in df.columns if c != language]
    best = F.min_by(F.struct(*rest), F.struct(hash_key(seed, F.col(key)), F.col(key))).alias("best")
    return df.groupBy(language).agg(best).select(language, "best.*")


def apply_pipeline(
    datasets: Mapping[str, DataFrame], steps: Sequence[Callable[[DataFrame], DataFrame]]
) -> dict[str, DataFrame]:
    """Run the same dataset-to-dataset steps on every dataset, e.g. train and test."""
    return {name: reduce(DataFrame.transform, steps, df) for name, df in datasets.items()}
