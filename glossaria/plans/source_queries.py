"""Sources and sinks: the tables are written out and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.plans import fixtures as fx
from glossaria.sources import corpora, names, results
from glossaria.sources.shared import shared_path

CLEAN_LINE = r"trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def read_parallel_corpus(spark, sf_dir):
    path = shared_path(spark, "corpus")
    corpora.write_parallel_corpus(fx.docs(spark, sf_dir), path, "doc_id")
    lines = corpora.read_parallel_corpus(spark, path, "folders")
    return lines.select("language", "sentence_id", F.md5("text").alias("digest"))


def read_split_tables(spark, sf_dir):
    path = shared_path(spark, "splits")
    marks = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    label = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("neutral")
    rows = fx.docs(spark, sf_dir).join(marks, "doc_id", "left")
    rows.select("language", F.col("corpus").alias("split"), "text", label.alias("label")).write.partitionBy(
        "language", "split"
    ).option("header", "true").option("escape", '"').csv(path)
    table = corpora.read_split_tables(spark, path, r"/language=([^/]+)/split=([^/]+)/")
    return table.groupBy("language", "split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


def strip_script(spark, sf_dir):
    from glossaria.operators.recode import strip_script as op

    script = F.when(F.col("corpus") == "train", "Latn").otherwise("Cyrl")
    coded = fx.corpus(spark, sf_dir).select(
        F.concat_ws("_", "language", script).alias("language"), "sentence_id", "doc_id", "n_chars"
    )
    return op(coded)


def unpivot_parallel_table(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").withColumn("sentence_id", F.col("conv_id") * 100 + F.col("turn"))
    wide = turns.groupBy("sentence_id").pivot("role", ["system", "user", "assistant"]).agg(F.first("text"))
    wide = wide.withColumn("index", F.col("sentence_id"))
    return corpora.unpivot_parallel_table(wide, drop=("index",))


def tsv_to_jsonl(spark, sf_dir):
    path, out = shared_path(spark, "tsv"), shared_path(spark, "jsonl")
    part = fx.table(spark, sf_dir, "part")
    part.select(F.concat_ws("\t", F.concat_ws(" ", "p_name", "p_partkey"), "p_type")).write.text(path)
    results.tsv_to_jsonl(spark, path, out, "name", "type")
    return spark.read.text(out).withColumnRenamed("value", "json")


def _counts(spark, sf_dir):
    return fx.docs(spark, sf_dir).groupBy("corpus", "language", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars")
    )


COUNTS_SCHEMA = "corpus string, language string, source string, n bigint, n_chars bigint"


def concat_result_files(spark, sf_dir):
    path = shared_path(spark, "results")
    counts = _counts(spark, sf_dir)
    for corpus in ("train", "test"):
        results.write_results(counts.where(F.col("corpus") == corpus), f"{path}/{corpus}", "csv")
    return results.concat_result_files(spark, path, "*.csv", counts.schema)


def write_results(spark, sf_dir):
    path = shared_path(spark, "results")
    counts = _counts(spark, sf_dir)
    parts = []
    for fmt in ("tsv", "csv", "json", "parquet"):
        results.write_results(counts, f"{path}/{fmt}", fmt)
        reader = spark.read.schema(counts.schema)
        if fmt in ("tsv", "csv"):
            back = reader.option("header", "true").option("sep", "\t" if fmt == "tsv" else ",").csv(f"{path}/{fmt}")
        else:
            back = reader.format(fmt).load(f"{path}/{fmt}")
        parts.append(back.groupBy("language").agg(F.sum("n").alias("n")).withColumn("format", F.lit(fmt)))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def save_load_dataset(spark, sf_dir):
    path = shared_path(spark, "dataset")
    corpora.save_dataset(fx.docs(spark, sf_dir), path)
    loaded = corpora.load_dataset(spark, path)
    return loaded.groupBy("language", "corpus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


def language_names(spark, sf_dir):
    return names.language_names(fx.name_table(spark, sf_dir), overrides=names.NAME_OVERRIDES)


def language_display_names(spark, sf_dir):
    table = names.language_names(fx.name_table(spark, sf_dir))
    codes = fx.docs(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    marked = codes.unionByName(codes.select(F.concat("language", F.lit("x")).alias("language"), "n"))
    return names.display_name(marked, table)


def language_name_prefix_lookup(spark, sf_dir):
    codes = fx.docs(spark, sf_dir).select("language").distinct()
    return names.name_by_prefix(codes, fx.name_table(spark, sf_dir))


def language_scripts(spark, sf_dir):
    codes = fx.all_varieties(spark, sf_dir).distinct()
    return corpora.language_scripts(codes).select("language", F.array_join("scripts", ",").alias("scripts"))


QUERIES = {
    f.__name__: f
    for f in (
        read_parallel_corpus, strip_script, read_split_tables, unpivot_parallel_table, tsv_to_jsonl,
        concat_result_files, write_results, save_load_dataset, language_names, language_display_names,
        language_name_prefix_lookup, language_scripts,
    )
}

LANGUAGE_NAMES_SQL = f"""{fx.NAME_SQL}, named AS (
  SELECT language_code, language FROM name_table
  UNION ALL SELECT code, arg_max(name, position) FROM (
    SELECT split_part(language_code, '-', 1) AS code, trim(regexp_replace(language, '\\(.*\\)', '')) AS name, position
    FROM name_table) WHERE code NOT IN (SELECT language_code FROM name_table) GROUP BY code)"""
_SCRIPTS_SQL = """scripts AS (SELECT lang AS language, list_sort(list(DISTINCT source)) AS scripts
  FROM documents GROUP BY lang)"""

ORACLES = {
    "read_parallel_corpus": f"""SELECT lang AS language, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS sentence_id,
      md5({CLEAN_LINE}) AS digest FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "strip_script": f"""WITH {fx.CORPUS_SQL}, coded AS (
      SELECT language, CASE corpus WHEN 'train' THEN 'Latn' ELSE 'Cyrl' END AS script, sentence_id, doc_id, n_chars FROM corpus)
      SELECT language, sentence_id, script, doc_id, n_chars FROM coded
      QUALIFY row_number() OVER (PARTITION BY language, sentence_id ORDER BY script DESC) = 1""",
    "read_split_tables": """SELECT lang AS language, CASE WHEN length(source) = 4 THEN 'train' ELSE 'test' END AS split,
      CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'neutral' END AS label, count(*) AS n,
      CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
    "unpivot_parallel_table": "SELECT conv_id * 100 + turn AS sentence_id, role AS language, text FROM conversations",
    "tsv_to_jsonl": """SELECT CAST(json_object('name', p_name || ' ' || p_partkey, 'type', p_type) AS VARCHAR) AS json FROM part""",
    "concat_result_files": f"""WITH {fx.DOCS_SQL} SELECT corpus, language, source, count(*) AS n,
      CAST(sum(n_chars) AS BIGINT) AS n_chars FROM docs GROUP BY ALL""",
    "write_results": """SELECT lang AS language, count(*) AS n, format FROM documents,
      (VALUES ('tsv'), ('csv'), ('json'), ('parquet')) f(format) GROUP BY ALL""",
    "save_load_dataset": f"""WITH {fx.DOCS_SQL} SELECT language, corpus, count(*) AS n,
      CAST(sum(length(text)) AS BIGINT) AS n_chars FROM docs GROUP BY ALL""",
    "language_names": f"""WITH {LANGUAGE_NAMES_SQL} SELECT * FROM named
      WHERE language_code NOT IN ('ckb', 'snd', 'tgk', 'zho')
      UNION ALL SELECT * FROM (VALUES ('ckb', 'Kurdish'), ('snd', 'Sindhi'), ('tgk', 'Tajik'), ('zho', 'Chinese')) v(a, b)""",
    "language_display_names": f"""WITH {LANGUAGE_NAMES_SQL}, codes AS (SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1),
      marked AS (SELECT * FROM codes UNION ALL SELECT language || 'x', n FROM codes)
      SELECT m.language, m.n, coalesce(t.language, 'UNKNOWN') || ' (' || m.language || ')' AS display
      FROM marked m LEFT JOIN named t ON t.language_code = m.language""",
    "language_name_prefix_lookup": f"""WITH {fx.NAME_SQL}, codes AS (SELECT DISTINCT lang AS language FROM documents)
      SELECT c.language, arg_min(trim(t.language), t.position) AS name
      FROM codes c JOIN name_table t ON starts_with(t.language_code, c.language) GROUP BY c.language""",
    "language_scripts": f"WITH {_SCRIPTS_SQL} SELECT language, array_to_string(scripts, ',') AS scripts FROM scripts",
}
