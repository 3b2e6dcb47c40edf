"""Corpora: line-aligned text files, split tables, wide tables, saved datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.functions.text import strip_whitespace
from glossaria.operators.ids import dimension
from glossaria.sources.shared import materialize, shared_path

# File layouts as (glob, pattern of the language in the path).
LAYOUTS = {
    "dev": ("*.dev", r"([^/]+)\.dev$"),
    "newstest": ("newstest*2019*.txt", r"/[^/.]*\.([^/.]+)[^/]*$"),
    "folders": ("*", r"/language=([^/]+)/"),
}

SPLIT_TABLE_SCHEMA = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]
)


def read_parallel_corpus(
    spark: SparkSession, path: str, layout: str = "dev", corpus: str | None = None
) -> DataFrame:
    """Rows ``(language, sentence_id, text)``; the line number in a language is the sentence id.

    Lines are stripped, blank ones kept. A language may have several files, which
    follow each other by part number and name, and a file many splits. The text
    is read once and written to the shared folder with its row numbers; within a
    split rows are consecutive, so a line number is the offset in the split plus
    the number of lines in earlier splits of the language. Only the table of
    splits is aggregated and sorted.
    """
    glob, pattern = LAYOUTS[layout]
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    lines = materialize(
        reader.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
            "value",
        ),
        "lines",
    )
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    part = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
    before = Window.partitionBy("language").orderBy(part, "file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("language", F.regexp_extract(F.url_decode("file"), pattern, 1)).select(
        "file", "start", "language", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    numbered = lines.join(dimension(offsets), ["file", "start"]).select(
        "language", (F.col("row") + F.col("shift")).alias("sentence_id"), strip_whitespace("value").alias("text")
    )
    return numbered.withColumn("corpus", F.lit(corpus)) if corpus else numbered


def write_parallel_corpus(df: DataFrame, path: str, order: str = "sentence_id") -> None:
    """One folder of text files per language, lines in the order of ``order`` over the files of a folder."""
    ranged = df.select("language", order, "text").repartitionByRange("language", order)
    lines = ranged.sortWithinPartitions("language", order).select("language", "text")
    lines.write.mode("error").partitionBy("language").text(path)


def read_split_tables(
    spark: SparkSession,
    path: str,
    pattern: str = r"/([^/]+)/([^/]+)\.csv$",
    schema: T.StructType = SPLIT_TABLE_SCHEMA,
) -> DataFrame:
    """Folder per language, CSV per split -> one table with ``language`` and ``split``."""
    table = (
        spark.read.schema(schema)
        .option("header", "true").option("multiLine", "true").option("escape", '"')
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
        .csv(path)
    )
    file = F.url_decode(F.col("_metadata.file_path"))
    return table.select(
        "*", F.regexp_extract(file, pattern, 1).alias("language"), F.regexp_extract(file, pattern, 2).alias("split")
    )


def unpivot_parallel_table(
    df: DataFrame, id_column: str = "sentence_id", drop: tuple[str, ...] = (), shuffle_seed: int | None = None
) -> DataFrame:
    """Wide parallel table -> ``(sentence_id, language, text)`` without nulls."""
    wide = df.drop(*drop)
    columns = [c for c in wide.columns if c != id_column]
    long = wide.unpivot(id_column, columns, "language", "text").where(F.col("text").isNotNull())
    return long if shuffle_seed is None else long.orderBy(F.rand(shuffle_seed))


def save_dataset(df: DataFrame, path: str) -> None:
    """Parquet, one folder per language so that readers prune by language."""
    df.write.mode("error").partitionBy("language").parquet(path)


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def save_by_position(df: DataFrame, table: str, buckets: int, position: str = "sentence_id") -> None:
    """A table in ``buckets`` files by sentence position, sorted by it.

    Joins and groupings of such tables by position need no shuffle: the translations
    of a sentence are in the files of one bucket. Its files are below the shared
    folder; the table's name is the session catalog's.
    """
    path = shared_path(df.sparkSession, "corpus")
    spread = df.repartition(buckets, position)  # one file per bucket
    spread.write.option("path", path).bucketBy(buckets, position).sortBy(position).saveAsTable(table, format="parquet")


def language_scripts(codes: DataFrame, separator: str = "_") -> DataFrame:
    """``fin_Latn``-style codes -> language with its sorted scripts."""
    parts = codes.select(
        F.split_part("language", F.lit(separator), F.lit(1)).alias("language"),
        F.get(F.split("language", separator), F.lit(1)).alias("script"),
    )
    return parts.groupBy("language").agg(F.array_sort(F.collect_set("script")).alias("scripts"))
