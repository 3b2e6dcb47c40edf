"""Quality rules whose cutoffs carry a bound on false rejections.

Each rule rejects a text whose signal is above a cutoff. Labelled documents are
halved by a hash of their id. On the first half, per stratum, the good texts'
quantiles at ``LEVELS`` give one vector of cutoffs per level. On the second
half (the holdout) a level is tested: of ``n`` good texts ``k`` are rejected by
any rule, and the level is certified if ``P(Binomial(n, alpha) <= k)``, the
exact (Clopper-Pearson) bound, is at most ``delta`` divided by the number of
tests, strata times levels (Bonferroni). Each stratum takes its strictest
certified level, so with probability ``1 - delta`` every stratum loses at most
the share ``alpha`` of its good texts to the rules. Without a certified level
a stratum has no cutoffs and only the base rules reject.

Everything is DataFrame expressions. Texts are read once: the signals, a few
numbers per row, go to the shared folder, and all later joins move those only.

Null text has no words and fails the base rules, as do empty texts. A null
stratum has no cutoffs of its own unless it has labels. A document with
several labels counts with each; repeated rows are judged alike. Other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import let
from glossaria.sources.shared import materialize

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ALPHA, DELTA = 0.02, 0.05
LEVELS = (0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.995, 0.999)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")
RULES = ("symbols", "dup_lines", "repeats", "upper", "exclaims", "long_words", "short_words")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def lacking(text: Column, characters: str) -> Column:
    """How many of ``characters`` a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Window hashes are sorted with their places; a window repeats if a neighbour
    has its hash. Places then go back into order, and each one adds the words
    that the window before has not covered.
    """
    places = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))))
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    def repeats(s: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, repeats))

    return F.when(F.size(w) < 4, 0).otherwise(let(hashes, count))


def signals(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` and the counts of each whole text, as longs."""
    body = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(body, "\n"), lambda x: F.length(x) > lacking(x, SPACE_CHARS))
    repeats = let(words(body), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    dup = let(full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    rows = docs.select(*keep, body.alias("__text"), repeats.alias("__words"), dup.alias("__lines"))
    own = F.col("__text")
    values = {
        "n_words": F.col("__words.n"),
        "word_chars": F.length(own) - lacking(own, SPACE_CHARS),
        "n_symbols": lacking(own, SYMBOLS),
        "n_dup_lines": F.col("__lines.d"),
        "n_repeat_words": F.col("__words.r"),
        "n_lines": F.col("__lines.n"),
        "n_upper": F.length(own) - F.length(F.regexp_replace(own, r"\p{Lu}+", "")),
        "n_exclaims": lacking(own, "!"),
    }
    return rows.select(*keep, *[values[c].cast("bigint").alias(c) for c in COUNTS])


def with_rules(counts: DataFrame) -> DataFrame:
    """The base rules and one signal per rule, higher is worse."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    values = {
        "symbols": per_word("n_symbols"),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": per_word("n_repeat_words"),
        "upper": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "exclaims": per_word("n_exclaims"),
        "long_words": per_word("word_chars"),
        "short_words": -per_word("word_chars"),
    }
    return counts.withColumn("base_failed", base).withColumns(values)


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """``P(Binomial(n, p) <= k)``, summed term by term; 1 where k is at least the mean."""
    odds, zero = math.log(p) - math.log1p(-p), n * F.lit(math.log1p(-p))
    start = F.struct(zero.alias("log"), F.exp(zero).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.aggregate(steps, start, add)["sum"])


def cutoffs(
    rules: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    id_column: str = "doc_id",
    label: str = "quality",
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """Per stratum and level: its cutoffs, holdout counts, bound, and whether it is certified."""
    good = labels.where(F.col(label) == 1).select(F.col(id_column).alias("__id"))
    known = rules.where(~F.col("base_failed")).join(good, F.col(id_column) == F.col("__id"))
    known = known.withColumn("__half", F.pmod(F.xxhash64(F.lit("halves"), "__id"), F.lit(2)))
    tuned = known.where("__half = 0").groupBy(F.col(stratum).alias("__stratum")).agg(
        *[F.percentile_approx(r, F.array(*map(F.lit, LEVELS)), F.lit(10_000)).alias(r) for r in RULES]
    )
    held = known.where("__half = 1").join(tuned.withColumnsRenamed({r: f"__{r}" for r in RULES}), F.col(stratum).eqNullSafe(F.col("__stratum")))
    rejected = [
        F.sum(F.greatest(*[(F.col(r) > F.get(f"__{r}", F.lit(j))).cast("int") for r in RULES])).cast("bigint")
        for j in range(len(LEVELS))
    ]
    tested = held.groupBy("__stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*rejected).alias("k"))
    tests = tested.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata")).scalar() * F.lit(len(LEVELS))
    levels = tested.select("__stratum", "n", F.posexplode("k").alias("level", "k"))
    levels = levels.withColumn("chance", binomial_at_most(F.col("k"), F.col("n"), alpha))
    levels = levels.withColumn("certified", F.col("chance") <= F.lit(delta) / tests)
    per_level = tuned.select(
        F.col("__stratum").alias("__s"),
        F.posexplode(F.arrays_zip(*RULES)).alias("__level", "cutoff"),
    )
    joined = levels.join(per_level, F.col("__stratum").eqNullSafe(F.col("__s")) & (F.col("level") == F.col("__level")))
    return joined.select(F.col("__stratum").alias("stratum"), "level", "n", "k", "chance", "certified", "cutoff")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    text: str = "text",
    id_column: str = "doc_id",
    label: str = "quality",
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """Per row: id, stratum, counts, ``base_failed``, ``rule_failed``, ``kept`` and the ``level`` in force."""
    rules = with_rules(materialize(signals(docs, text, (id_column, stratum)), "signals"))
    table = cutoffs(rules, labels, stratum, id_column, label, alpha, delta).where("certified")
    best = table.groupBy(F.col("stratum").alias("__s")).agg(F.min_by(F.struct("level", "cutoff"), "level").alias("__best"))
    best = materialize(best, "cutoffs")
    joined = rules.join(best, F.col(stratum).eqNullSafe(F.col("__s")), "left")
    failed = F.lit(False)
    for r in RULES:
        failed = failed | F.coalesce(F.col(r) > F.col(f"__best.cutoff.{r}"), F.lit(False))
    return joined.select(
        id_column, stratum, *COUNTS, "base_failed", failed.alias("rule_failed"),
        (~(F.col("base_failed") | failed)).alias("kept"), F.col("__best.level").alias("level"),
    )
