"""Inputs of the operators, derived from the given tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.operators.ids import add_sentence_id, dense_positions

# Latin letters with a Cyrillic counterpart, and the codes under
# which the re-spelled texts run.
LATIN_LETTERS = "abvgdezijklmnoprstufhcABVGDEZIJKLMNOPRSTUFHC"
CYRILLIC_LETTERS = "абвгдезийклмнопрстуфхцАБВГДЕЗИЙКЛМНОПРСТУФХЦ"
CYRILLIC_CODES = (("en", "rus"), ("fr", "ukr"), ("de", "bul"), ("es", "srp"))

DOCS_SQL = """docs AS (
  SELECT CASE WHEN length(source) = 4 THEN 'train' ELSE 'test' END AS corpus,
         lang AS language, source, doc_id, text, n_chars
  FROM documents)"""
CORPUS_SQL = DOCS_SQL + """, corpus AS (
  SELECT *, row_number() OVER (PARTITION BY corpus, language ORDER BY doc_id) - 1 AS sentence_id FROM docs)"""
WHOLE_SQL = DOCS_SQL + """, whole AS (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY doc_id) - 1 AS sentence_id FROM docs)"""
LABELLED_SQL = """labelled AS (
  SELECT lang AS language, lang || '_' || source AS variety, source, doc_id, text, n_chars, quality, toxic
  FROM documents JOIN labels USING (doc_id))"""


# Documents are long, so few of them make a numbering task.
DOCUMENT_BUCKET = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a two-corpus collection: sources with one digit train, others test."""
    corpus = F.when(F.length("source") == 4, "train").otherwise("test").alias("corpus")
    return table(spark, sf_dir, "documents").select(
        corpus, F.col("lang").alias("language"), "source", "doc_id", "text", "n_chars"
    )


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for text-heavy work; a table of fewer splits than cores is dealt over the cores."""
    rows, cores = docs(spark, sf_dir), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the position within (corpus, language)."""
    return add_sentence_id(docs(spark, sf_dir), "doc_id", ("corpus", "language"), DOCUMENT_BUCKET)


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one corpus, with the position within the language."""
    return add_sentence_id(docs(spark, sf_dir), "doc_id", ("language",), DOCUMENT_BUCKET)


def varieties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Corpora of labelled and of clean labelled documents; language = language_source."""
    base = table(spark, sf_dir, "documents").select(
        F.concat_ws("_", "lang", "source").alias("language"), "doc_id", "n_chars"
    )
    marks = table(spark, sf_dir, "labels")
    first = base.join(marks.select("doc_id"), "doc_id", "left_semi")
    second = base.join(marks.where(F.col("toxic") == 1).select("doc_id"), "doc_id", "left_semi")
    return first, second


def all_varieties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language = language_source of every document."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("_", "lang", "source").alias("language"))


def name_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of language varieties ``lang-source`` in order of appearance."""
    return (
        table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("position"))
        .select(
            F.concat_ws("-", "lang", "source").alias("language_code"),
            F.concat(F.lit("Language "), F.upper("lang"), F.lit(" of "), "source", F.lit(" (x)")).alias("language"),
            "position",
        )
    )


NAME_SQL = """name_table AS (
  SELECT lang || '-' || source AS language_code, 'Language ' || upper(lang) || ' of ' || source || ' (x)' AS language,
         min(doc_id) AS position FROM documents GROUP BY lang, source)"""


def vectors(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Embeddings as sentences: label = language; the second model is the first half.

    Sentences are numbered within their language, or keep the table's id.
    """
    base = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("language"), "vec_id", "embedding"
    )
    placed = dense_positions(base, ["language"], "vec_id") if numbered else base.withColumn("sentence_id", F.col("vec_id"))
    models = F.explode(
        F.array(
            F.struct(F.lit("full").alias("model"), F.col("embedding").alias("embedding")),
            F.struct(F.lit("half").alias("model"), F.slice("embedding", 1, 32).alias("embedding")),
        )
    ).alias("m")
    return placed.select("language", "sentence_id", models).select("m.model", "language", "sentence_id", "m.embedding")


VECTORS_SQL = """base AS (
  SELECT CAST(label AS VARCHAR) AS language, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sentence_id,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
vectors AS (SELECT 'full' AS model, language, sentence_id, v FROM base
  UNION ALL SELECT 'half', language, sentence_id, v[1:32] FROM base),
units AS (SELECT model, language, sentence_id, list_transform(v, lambda x: x / n) AS u
  FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vectors)),
dists AS (SELECT a.model, a.language AS lang1, b.language AS lang2, a.sentence_id, b.sentence_id AS candidate_id,
    round(least(greatest(1 - list_dot_product(a.u, b.u), 0), 2), 9) AS d
  FROM units a JOIN units b ON a.model = b.model),
ranks AS (SELECT q.model, q.lang1, q.lang2, q.sentence_id, q.d AS distance,
    count(*) FILTER (WHERE c.d < q.d) + (count(*) FILTER (WHERE c.d = q.d) + 1) / 2.0 AS rank
  FROM dists q JOIN dists c USING (model, lang1, lang2, sentence_id)
  WHERE q.candidate_id = q.sentence_id GROUP BY ALL)"""

VECTORS_BY_ID_SQL = VECTORS_SQL.replace("row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1", "vec_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary predictions per language: quality against two guesses."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    guess = F.explode(
        F.array(
            F.struct(F.lit("before").alias("phase"), (F.col("toxic") == 1).alias("hit")),
            F.struct(F.lit("after").alias("phase"), (F.col("n_chars") > 1000).alias("hit")),
        )
    ).alias("g")
    return rows.select("doc_id", "lang", "quality", guess).select(
        "doc_id", F.concat_ws("-", F.lit("en"), "lang").alias("language_pair"), "g.phase",
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"),
        F.when(F.col("g.hit"), "yes").otherwise("no").alias("prediction"),
    )


PREDICTIONS_SQL = """predictions AS (
  SELECT doc_id, 'en-' || lang AS language_pair, phase, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label,
         CASE WHEN hit THEN 'yes' ELSE 'no' END AS prediction
  FROM (SELECT *, 'before' AS phase, toxic = 1 AS hit FROM documents JOIN labels USING (doc_id)
        UNION ALL SELECT *, 'after', n_chars > 1000 FROM documents JOIN labels USING (doc_id)))"""


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True language against a guess from accented letters."""
    guess = (
        F.when(F.col("text").rlike("[ñíóÑÍÓ]"), "es")
        .when(F.col("text").rlike("[çèêÇÈÊ]"), "fr")
        .when(F.col("text").rlike("[äößÄÖ]"), "de")
        .when(F.length("text") < 200, "unknown")
        .otherwise("en")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("lang").alias("label"), guess.alias("prediction")
    )


MULTICLASS_SQL = """multiclass AS (
  SELECT doc_id, source, lang AS label,
    CASE WHEN regexp_matches(text, '[ñíóÑÍÓ]') THEN 'es' WHEN regexp_matches(text, '[çèêÇÈÊ]') THEN 'fr'
         WHEN regexp_matches(text, '[äößÄÖ]') THEN 'de' WHEN length(text) < 200 THEN 'unknown' ELSE 'en' END AS prediction
  FROM documents)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification paths region/nation[/segment] of customer groups."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    segment = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise(F.col("c_mktsegment"))
    path = F.concat_ws("/", "r_name", "n_name", segment)
    return joined.select(
        F.concat_ws(".", "n_name", "c_mktsegment").alias("iso"), path.alias("classification"), F.col("c_custkey").alias("position")
    )


PATHS_SQL = """raw_paths AS (
  SELECT n_name || '.' || c_mktsegment AS iso, c_custkey AS position,
    r_name || '/' || n_name || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '/' || c_mktsegment END AS classification
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
paths AS (SELECT iso, arg_max(classification, position) AS classification, min(position) AS position
  FROM raw_paths GROUP BY iso),
nodes AS (SELECT iso, position, string_split(classification, '/') AS p FROM paths),
edges AS (SELECT a.iso AS lang1, b.iso AS lang2, CAST(len(a.p) + len(b.p) - 2 * least(
    len(list_filter(range(1, least(len(a.p), len(b.p)) + 1), lambda k: a.p[1:k] = b.p[1:k])),
    least(len(a.p), len(b.p)) - 1) AS BIGINT) AS distance
  FROM nodes a JOIN nodes b ON a.position < b.position)"""


def cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents re-spelled with Cyrillic letters under Slavic language codes."""
    code = F.create_map(*[F.lit(x) for pair in CYRILLIC_CODES for x in pair])
    base = text_docs(spark, sf_dir)
    return base.select(
        "corpus", F.try_element_at(code, F.col("language")).alias("language"), "doc_id",
        F.translate("text", LATIN_LETTERS, CYRILLIC_LETTERS).alias("text"),
    )


CYRILLIC_SQL = DOCS_SQL + f""", cyrillic AS (
  SELECT corpus, CASE language {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in CYRILLIC_CODES)} END AS language,
         doc_id, translate(text, '{LATIN_LETTERS}', '{CYRILLIC_LETTERS}') AS text FROM docs)"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound part names as word forms with type, brand and size as features."""
    return table(spark, sf_dir, "part").select(
        F.replace("p_name", F.lit(" "), F.lit("")).alias("form"),
        F.concat_ws(";", "p_type", "p_brand", F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("features"),
    )


ANALYSES_SQL = """analyses AS (
  SELECT replace(p_name, ' ', '') AS form, p_type || ';' || p_brand || ';size' || p_size AS features FROM part)"""


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as predictions, the following assistant turns as references."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prediction"))
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference")
    )
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws(".", "conv_id", "turn").alias("pair_id"), "prediction", "reference"
    )


HYPOTHESES_SQL = """hypotheses AS (
  SELECT u.conv_id || '.' || u.turn AS pair_id, u.text AS prediction, a.text AS reference
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


@lru_cache(maxsize=8)
def _segmenter(spark: SparkSession, sf_dir: str, kind: str):
    from glossaria.operators.subwords import Segmenter, train_vocabulary, word_counts

    if kind == "corpus":
        words = word_counts(text_docs(spark, sf_dir).where(F.col("corpus") == "train"))
        vocabulary = train_vocabulary(words, VOCABULARY_SIZE, MAX_PIECE)
    else:
        words = analyses(spark, sf_dir).groupBy(F.col("form").alias("word")).agg(F.count(F.lit(1)).alias("n"))
        vocabulary = train_vocabulary(words, FORM_VOCABULARY_SIZE, MAX_PIECE)
    return Segmenter.from_table(vocabulary)


VOCABULARY_SIZE, FORM_VOCABULARY_SIZE, MAX_PIECE = 400, 60, 6


def segmenter(spark: SparkSession, sf_dir: str, kind: str = "corpus"):
    """Tokenizer trained on the train corpus (or on the word forms), fitted once per input."""
    return _segmenter(spark, sf_dir, kind)


def segment_sql(words: str, train_words: str, size: int) -> str:
    """CTEs ``vocab`` and ``lex(word, pieces)`` for a table of words and training counts."""
    return f"""pieces AS (
  SELECT CASE WHEN s = 1 THEN '' ELSE '##' END || substr(word, s, k) AS piece, sum(n) AS n
  FROM (SELECT word, sum(n) AS n FROM {train_words} GROUP BY word),
       unnest(range(1, length(word) + 1)) AS t(s), unnest(range(1, {MAX_PIECE + 1})) AS u(k)
  WHERE s + k - 1 <= length(word) GROUP BY 1),
vocab AS (SELECT piece, n FROM pieces ORDER BY n DESC, piece LIMIT {size}),
dw AS (SELECT DISTINCT word FROM {words}),
best AS (SELECT word, s, max(k) AS k
  FROM (SELECT word, s, k, CASE WHEN s = 1 THEN '' ELSE '##' END || substr(word, s, k) AS piece
        FROM dw, unnest(range(1, length(word) + 1)) AS t(s), unnest(range(1, {MAX_PIECE + 1})) AS u(k)
        WHERE s + k - 1 <= length(word)) JOIN vocab USING (piece) GROUP BY word, s),
chain AS (SELECT word, s, k, 0 AS step FROM best WHERE s = 1
  UNION ALL SELECT b.word, b.s, b.k, c.step + 1 FROM chain c JOIN best b ON b.word = c.word AND b.s = c.s + c.k),
full_chain AS (SELECT word, sum(k) AS covered,
    list(CASE WHEN s = 1 THEN '' ELSE '##' END || substr(word, s, k) ORDER BY step) AS pieces FROM chain GROUP BY word),
lex AS (SELECT dw.word, CASE WHEN f.covered = length(dw.word) THEN f.pieces ELSE ['[UNK]'] END AS pieces
  FROM dw LEFT JOIN full_chain f USING (word))"""


SEGMENT_WORDS_SQL = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')"
LEXICON_SQL = (
    DOCS_SQL
    + f""", wc AS (
  SELECT corpus, language, word, count(*) AS n
  FROM (SELECT corpus, language, unnest({SEGMENT_WORDS_SQL}) AS word FROM docs) GROUP BY ALL),
wc_train AS (SELECT word, n FROM wc WHERE corpus = 'train'), """
    + segment_sql("wc", "wc_train", VOCABULARY_SIZE)
    + """, lw AS (SELECT language, word, n, pieces
  FROM (SELECT language, word, sum(n) AS n FROM wc GROUP BY 1, 2) JOIN lex USING (word))"""
)
FORMS_SQL = (
    ANALYSES_SQL
    + ", forms AS (SELECT form AS word, count(*) AS n FROM analyses GROUP BY form), "
    + segment_sql("forms", "forms", FORM_VOCABULARY_SIZE)
    + """, triples AS (
  SELECT word, subword, feature FROM (SELECT DISTINCT word, unnest(pieces) AS subword FROM lex)
  JOIN (SELECT DISTINCT form AS word, unnest(string_split(features, ';')) AS feature FROM analyses) USING (word))"""
)
