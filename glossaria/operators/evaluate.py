"""Classification and generation metrics from prediction tables.

Metrics start from the confusion counts ``(groups, label, prediction, n)``: one
aggregation with partial sums over the predictions, after which only
(number of labels)**2 rows per group are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.text import bleu_tokens, ngrams, strip_whitespace
from glossaria.operators.ids import dimension, co_locate

RUN = 1 << 12


def language_balance(df: DataFrame, groups: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Rows and share of rows per language."""
    counts = df.groupBy(*groups, "language").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(groups or [F.lit(0)])))
    return counts.withColumn("share", F.round(F.col("n") / total, digits))


def confusion_counts(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Long confusion matrix without empty cells."""
    return df.groupBy(*groups, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, groups: Sequence[str] = (), drop_empty: bool = False) -> DataFrame:
    """Square confusion matrix in long form over the union of seen labels.

    ``drop_empty`` removes rows and columns that are zero throughout.
    """
    counts = dimension(counts)
    seen = counts.select(*groups, F.explode(F.array("label", "prediction")).alias("label"))
    by_group = seen.groupBy(*groups).agg(F.collect_set("label").alias("labels"))
    rows = by_group.select(*groups, "labels", F.explode("labels").alias("label"))
    grid = rows.select(*groups, "label", F.explode("labels").alias("prediction"))
    full = grid.join(counts, [*groups, "label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not drop_empty:
        return full
    row_sum = F.sum("n").over(Window.partitionBy(*groups, "label"))
    column_sum = F.sum("n").over(Window.partitionBy(*groups, "prediction"))
    kept = full.withColumn("__row", row_sum).withColumn("__column", column_sum)
    return kept.where((F.col("__row") > 0) & (F.col("__column") > 0)).drop("__row", "__column")


def confusion_display(matrix: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Wide confusion matrix for known labels."""
    return matrix.groupBy("label").pivot("prediction", list(labels)).agg(F.first("n")).fillna(0)


def per_class_f1(counts: DataFrame, groups: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """F1 of every label that occurs as label or prediction; 0 when undefined."""
    right, n, none = F.col("label") == F.col("prediction"), F.col("n"), F.lit(0).cast("bigint")
    as_label = F.struct(
        F.col("label").alias("class"), F.when(right, n).otherwise(none).alias("tp"), none.alias("fp"),
        F.when(right, none).otherwise(n).alias("fn"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("class"), none.alias("tp"), F.when(right, none).otherwise(n).alias("fp"),
        none.alias("fn"),
    )
    sums = counts.select(*groups, F.inline(F.array(as_label, as_prediction))).groupBy(*groups, "class").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    denominator = F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.coalesce(F.lit(2.0) * F.col("tp") / F.nullif(denominator, F.lit(0)), F.lit(0.0))
    return sums.withColumn("f1", F.round(f1, digits))


def macro_f1(class_f1: DataFrame, groups: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Unweighted mean of the class F1 values."""
    return class_f1.groupBy(*groups).agg(F.round(F.avg("f1"), digits).alias("macro_f1"))


def micro_f1(class_f1: DataFrame, groups: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """tp / (tp + (fp + fn) / 2) over all classes, equal to the accuracy."""
    tp, wrong = F.sum("tp"), F.sum("fp") + F.sum("fn")
    value = tp / F.nullif(tp + wrong / F.lit(2), F.lit(0.0))
    return class_f1.groupBy(*groups).agg(F.round(value, digits).alias("micro_f1"))


def f1_for_languages(class_f1: DataFrame, languages: Sequence[str]) -> DataFrame:
    """F1 of the requested languages, 0 if a language was never seen."""
    wanted = class_f1.sparkSession.createDataFrame([(x,) for x in languages], "class string")
    return wanted.join(class_f1.select("class", "f1"), "class", "left").fillna(0.0, ["f1"])


def binary_outcomes(
    df: DataFrame, groups: Sequence[str], positive: str = "yes", negative: str = "no"
) -> DataFrame:
    """fp, fn, tp, tn and totals per group in one conditional aggregation."""
    def cell(label: str, prediction: str):
        return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))

    outcomes = df.groupBy(*groups).agg(
        cell(negative, positive).alias("false_positives"),
        cell(positive, negative).alias("false_negatives"),
        cell(positive, positive).alias("true_positives"),
        cell(negative, negative).alias("true_negatives"),
    )
    return outcomes.withColumn(
        "total_correct", F.col("true_positives") + F.col("true_negatives")
    ).withColumn("total_incorrect", F.col("false_positives") + F.col("false_negatives"))


def outcomes_before_after(df: DataFrame) -> DataFrame:
    """Outcomes per language pair, before and after training side by side.

    Same result as ``pairs.join_metrics_before_after`` on the two phases, from one
    pass over the predictions; pairs that lack a phase are dropped.
    """
    outcomes = binary_outcomes(df, ["language_pair", "phase"])
    fields = [c for c in outcomes.columns if c not in ("language_pair", "phase")]
    wide = outcomes.groupBy("language_pair").agg(
        *[
            F.max(F.when(F.col("phase") == phase, F.col(c))).alias(f"{c}_{phase}")
            for phase in ("before", "after") for c in fields
        ]
    )
    return wide.where(F.col("total_correct_before").isNotNull() & F.col("total_correct_after").isNotNull())


def error_count(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Total minus trace of the confusion matrix."""
    return df.groupBy(*groups).agg(F.count_if(F.col("label") != F.col("prediction")).alias("errors"))


def error_ratio(before_after: DataFrame, digits: int = 6) -> DataFrame:
    """Errors after / errors before; null where there were none before."""
    ratio = F.col("total_incorrect_after") / F.nullif(F.col("total_incorrect_before"), F.lit(0))
    return before_after.select(
        "language_pair", "total_incorrect_before", "total_incorrect_after", F.round(ratio, digits).alias("ratio")
    )


def normalize_confusion(
    counts: DataFrame, by: str = "label", groups: Sequence[str] = (), digits: int = 2
) -> DataFrame:
    """Divide by the sums of each true label (``label``) or ``prediction``."""
    total = F.sum("n").over(Window.partitionBy(*groups, by))
    share = F.coalesce(F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0))
    return counts.withColumn("share", F.round(share, digits))


def misclassification_counts(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Wrong predictions counted per true label."""
    return confusion_counts(df.where(F.col("label") != F.col("prediction")), groups)


def expand_confusion(wide: DataFrame, label: str = "label") -> DataFrame:
    """Wide confusion matrix -> one row per observation; long cells go through runs of bounded length."""
    columns = [c for c in wide.columns if c != label]
    cells = wide.unpivot(label, columns, "prediction", "n").where(F.col("n") > 0)
    # each element of the first array stands for RUN * RUN observations, then for RUN, then for one
    rows = cells.withColumn("first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(RUN * RUN).cast("bigint"))))
    for width in (RUN, 1):
        last = F.least(F.col("n"), F.col("first") + F.lit(width * RUN - 1))
        rows = rows.withColumn("first", F.explode(F.sequence(F.col("first"), last, F.lit(width).cast("bigint"))))
    return rows.select(label, "prediction", F.col("first").alias("observation"))


def bleu_statistics(df: DataFrame, key: str, groups: Sequence[str] = (), max_n: int = 4) -> DataFrame:
    """Clipped n-gram matches and n-gram totals per order, summed over the corpus.

    Hypothesis and reference n-grams come out of one explode and are counted
    under one key, so the clipping needs no join. The pairs are hashed by their
    key before that: the shuffle carries texts, not n-grams.
    """
    tokens = co_locate(df.select(*groups, key, "prediction", "reference"), key).select(
        *groups, key, bleu_tokens("prediction").alias("hyp_tokens"), bleu_tokens("reference").alias("ref_tokens")
    )

    def tagged(column: str, n: int, is_hyp: int):
        return F.transform(
            ngrams(column, n),
            lambda g: F.struct(F.lit(n).alias("order"), g.alias("gram"), F.lit(is_hyp).alias("is_hyp")),
        )

    orders = range(1, max_n + 1)
    entries = [tagged("hyp_tokens", n, 1) for n in orders] + [tagged("ref_tokens", n, 0) for n in orders]
    rows = tokens.select(*groups, key, F.inline(F.concat(*entries)))
    clipped = rows.groupBy(*groups, key, "order", "gram").agg(
        F.sum("is_hyp").alias("hyp"), F.sum(F.lit(1) - F.col("is_hyp")).alias("ref")
    )
    return clipped.groupBy(*groups, "order").agg(
        F.sum(F.least("hyp", "ref")).alias("correct"), F.sum("hyp").alias("total"), F.sum("ref").alias("ref_total")
    )


def corpus_bleu(statistics: DataFrame, groups: Sequence[str] = (), max_n: int = 4, digits: int = 4) -> DataFrame:
    """Corpus BLEU in percent with exponential smoothing of empty orders.

    The k-th order without a match counts as 1 / (2**k * total).
    """
    def of(n: int, column: str):
        return F.coalesce(F.sum(F.when(F.col("order") == n, F.col(column))), F.lit(0))

    names = [(n, c) for n in range(1, max_n + 1) for c in ("correct", "total")]
    wide = statistics.groupBy(*groups).agg(
        *[of(n, c).alias(f"{c}{n}") for n, c in names], of(1, "ref_total").alias("ref_len")
    )
    misses, logs = F.lit(0), F.lit(0.0)
    for n in range(1, max_n + 1):
        correct, total = F.col(f"correct{n}"), F.col(f"total{n}")
        misses = misses + F.when(correct == 0, 1).otherwise(0)
        precision = F.when(correct > 0, correct.cast("double")).otherwise(F.lit(1.0) / F.pow(F.lit(2.0), misses)) / F.nullif(total, F.lit(0))
        logs = logs + F.ln(precision)
    length, ref = F.col("total1"), F.col("ref_len")
    penalty = F.when(length >= ref, 1.0).otherwise(F.exp(F.lit(1.0) - ref / F.nullif(length, F.lit(0))))
    score = F.coalesce(F.lit(100.0) * penalty * F.exp(logs / max_n), F.lit(0.0))
    score = F.when(F.col("correct1") == 0, 0.0).otherwise(score)
    return wide.select(*groups, F.round(score, digits).alias("bleu"))


def mean_generation_length(df: DataFrame, groups: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Mean number of predicted tokens (white-space tokens of the prediction)."""
    tokens = F.regexp_extract_all(strip_whitespace("prediction"), F.lit(r"\S+"), F.lit(0))
    return df.groupBy(*groups).agg(F.round(F.avg(F.size(tokens)), digits).alias("gen_len"))
