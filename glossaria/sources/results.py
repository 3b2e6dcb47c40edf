"""Result tables: delimited lines, JSON, stacking of result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def two_fields(line: Column, key1: str, key2: str, separator: str = "\t") -> Column:
    """Delimited line -> JSON object; any other number of fields is an error."""
    from glossaria.functions.text import strip_whitespace

    fields = F.split(strip_whitespace(line), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")), -1)
    record = F.to_json(F.struct(F.get(fields, F.lit(0)).alias(key1), F.get(fields, F.lit(1)).alias(key2)))
    message = F.concat(F.lit("expected 2 fields: "), line)
    return F.when(F.size(fields) == 2, record).otherwise(F.raise_error(message).cast("string"))


def tsv_to_jsonl(
    spark: SparkSession, path: str, out: str, key1: str, key2: str, separator: str = "\t"
) -> None:
    """Two-field delimited text files -> JSON lines."""
    lines = spark.read.text(path)
    lines.select(two_fields(F.col("value"), key1, key2, separator).alias("value")).write.mode("error").text(out)


def write_results(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    """Write a result table as tsv, csv, json or parquet."""
    writer = df.write.mode("error")
    if fmt in ("tsv", "csv"):
        separator = "\t" if fmt == "tsv" else ","
        writer.option("sep", separator).option("header", "true").option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def concat_result_files(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, separator: str = ","
) -> DataFrame:
    """Stack the rows of all result files called ``name`` (a glob) below ``folder``."""
    return (
        spark.read.schema(schema)
        .option("header", "true").option("sep", separator).option("escape", '"')
        .option("recursiveFileLookup", "true").option("pathGlobFilter", name)
        .csv(folder)
    )
