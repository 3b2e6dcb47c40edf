"""Document quality with the evidence of its site, by hierarchical empirical Bayes.

1. A logistic regression on counts of the text gives each document a
   probability ``evidence`` of being good. It is fitted to at most ``max_rows``
   labelled rows, drawn by a hash of their id.
2. The global prior is the mean evidence of all documents. Host means spread
   around it, and path means around their host's; from the spread (method of
   moments, less the sampling variance) follow the weights ``m`` of the priors,
   in documents. A site's posterior is ``(sum + m * prior) / (n + m)``: sparse
   sites are shrunk to the level above, large ones speak for themselves. A
   document's own evidence is left out of its site.
3. Posterior odds are the document's likelihood ratio (evidence odds against
   the odds of the training labels) times the odds of its path.

Only numbers are shuffled, and sums per site are formed before the shuffle, so
a host with a third of all rows is one row per task.

Null and empty texts have zero counts. Null hosts and paths are sites. With
labels of one kind only, the evidence is their share (half without labels).
Repeated rows count each. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import fit_logistic, let
from glossaria.llm.quality_rules import lacking, words
from glossaria.sources.shared import materialize

EPSILON = 1e-6
INPUTS = (
    "one", "log_words", "log_words_2", "symbols", "exclaims", "upper", "distinct", "distinct_2", "bars", "digits", "word_length",
    "word_length_2", "line_words", "dup_lines",
)


def text_inputs(text: str = "text") -> Column:
    """Struct of the regression inputs of a text."""
    body = F.coalesce(F.col(text), F.lit(""))

    def inputs(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        lines = F.size(F.split(body, "\n"))
        log = F.log1p(F.size(w))
        distinct = F.size(F.array_distinct(w)) / F.sqrt(n)
        length = (F.length(body) - F.size(w)) / n
        values = (
            F.lit(1.0), log, log * log / 10, F.least(lacking(body, "#*$%&") / n, F.lit(3.0)), F.least(lacking(body, "!") / n, F.lit(3.0)),
            (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))) / n, F.size(F.array_distinct(w)) / n, distinct / 10,
            F.least(lacking(body, "|<>") / n, F.lit(3.0)), lacking(body, "0123456789") / n, length / 5, length * length / 50,
            F.log1p(n / lines), 1 - F.size(F.array_distinct(F.split(body, "\n"))) / lines,
        )
        return F.struct(*[v.cast("double").alias(k) for k, v in zip(INPUTS, values)])

    return let(words(body), inputs)


def fit(rows: DataFrame, labels: DataFrame, max_rows: int = 10_000, id_column: str = "doc_id", label: str = "quality") -> tuple[list[float], float]:
    """Coefficients by ``INPUTS`` and the share of good labels; ``rows`` has the column ``inputs``."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(id_column, label).distinct()
    drawn = known.orderBy(F.xxhash64(F.lit("quality"), id_column), id_column, label).limit(max_rows).collect()
    chosen = rows.sparkSession.createDataFrame(drawn, known.schema)
    sample = rows.join(F.broadcast(chosen), id_column).select(label, "inputs.*").collect()
    y = np.array([r[0] for r in sample], float)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, EPSILON), 1 - EPSILON)
        return [float(np.log(share / (1 - share)))] + [0.0] * (len(INPUTS) - 1), share
    x = np.array([[r[1 + i] for i in range(len(INPUTS))] for r in sample], float)
    order = np.lexsort(np.c_[x, y].T)
    return fit_logistic(x[order], y[order], np.ones(len(y))).tolist(), share


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.log(p / (1 - p))


def prior_weight(groups: DataFrame) -> Column:
    """Documents that the prior of a level weighs, from (n, total, squares, prior) per group."""
    mean, sampled = F.col("total") / F.col("n"), F.col("squares") - F.col("total") * F.col("total") / F.col("n")
    n, h = F.sum("n"), F.count(F.lit(1))
    within = F.sum(sampled) / F.greatest(n - h, F.lit(1))
    between = F.sum(F.col("n") * (mean - F.col("prior")) ** 2)
    effective = F.greatest(n - F.sum(F.col("n") * F.col("n")) / n, F.lit(1.0))
    variance = F.greatest((between - (h - 1) * within) / effective, F.lit(EPSILON))
    middle = F.sum("total") / n
    weight = F.greatest(middle * (1 - middle) / variance - 1, F.lit(1.0))
    return F.coalesce(groups.agg(weight.alias("m")).scalar(), F.lit(1.0))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    max_rows: int = 10_000,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = 0.5,
) -> DataFrame:
    """Per row: id, host, path, ``evidence``, the posteriors of its sites, ``score`` and ``kept``."""
    rows = docs.select(id_column, host.alias("host"), path.alias("path"), text_inputs(text).alias("inputs"))
    rows = materialize(rows, "quality-inputs")
    weights, share = fit(rows, labels, max_rows, id_column, label)
    linear = sum((F.col(f"inputs.{k}") * F.lit(w) for k, w in zip(INPUTS, weights)), F.lit(0.0))
    scored = rows.select(id_column, "host", "path", (1 / (1 + F.exp(-linear))).alias("evidence"))
    # decimals add up to the same sum in any order
    exact = F.col("evidence").cast("decimal(12,10)")
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(exact).cast("double").alias("total"), F.sum((exact * exact).cast("decimal(12,10)")).cast("double").alias("squares")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    overall = F.coalesce(paths.agg((F.sum("total") / F.sum("n")).alias("mean")).scalar(), F.lit(0.5))
    hosts = hosts.withColumn("prior", overall)
    m_host = prior_weight(hosts)
    host_mean = (F.col("total") + m_host * F.col("prior")) / (F.col("n") + m_host)
    hosts = hosts.select(
        F.col("host").alias("__h"), F.col("n").alias("host_n"), F.col("total").alias("host_total"), F.col("prior").alias("global_prior"),
        host_mean.alias("host_mean"),
    )
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("__h"))).drop("__h")
    m_path = prior_weight(sites.withColumn("prior", F.col("host_mean")))
    sites = materialize(sites.withColumns({"m_host": m_host, "m_path": m_path}), "quality-sites")
    sites = sites.withColumnsRenamed({"host": "__h", "path": "__p"})
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")))
    own = F.col("evidence")
    at_host = (F.col("host_total") - own + F.col("m_host") * F.col("global_prior")) / (F.col("host_n") - 1 + F.col("m_host"))
    at_path = (F.col("total") - own + F.col("m_path") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("m_path"))
    joined = joined.withColumn("host_posterior", at_host).withColumn("path_posterior", at_path)
    odds = logit(own) - logit(F.lit(share)) + logit(F.col("path_posterior"))
    joined = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    return joined.select(
        id_column, "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept")
    )
