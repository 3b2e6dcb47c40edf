"""Tokens, n-gram counts, vocabularies and their overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.text import explode_terms
from glossaria.operators.ids import BUCKET_ROWS, RUN_RANGES, dealt, scalar


def with_tokens(df: DataFrame, tokens: Column, keep: Sequence[str]) -> DataFrame:
    """Reduce to the key columns and a ``tokens`` array."""
    return df.select(*keep, tokens.alias("tokens"))


def term_rows(df: DataFrame, terms: Column, keep: Sequence[str], out: str = "term") -> DataFrame:
    """One row per term occurrence."""
    return df.select(*keep, explode_terms(terms).alias(out))


def ngram_rows(
    df: DataFrame, tokens: str, low: int, high: int, keep: Sequence[str], out: str = "ngram"
) -> DataFrame:
    """One row per occurrence of an n-gram with ``low <= n <= high``: the rows that exploding ``ngram_range`` gives.

    Tokens are laid beside those that follow them and joined once they are rows. No array of
    n-grams is built and no lambda is called, so Spark compiles the steps up to the count into one loop.
    """
    # never null: a condition on it would be pushed down and tokenize once more
    shifted = [F.slice(tokens, k + 1, F.size(tokens)).alias(f"t{k}") for k in range(high)]
    size = F.coalesce(F.size(tokens), F.lit(0)).alias("__size")
    sized = df.select(*keep, tokens, size)  # in two steps, else every row would carry all tokens
    rows = sized.select(*keep, "__size", F.posexplode(F.arrays_zip(*shifted)).alias("__at", "__t"))
    grams = {n: F.concat_ws(" ", *[F.col(f"__t.t{k}") for k in range(n)]) if n > 1 else F.col("__t.t0") for n in range(low, high + 1)}
    each = [x for n, gram in grams.items() for x in (F.lit(n), gram)]
    if low < high:
        rows = rows.select(*keep, "__size", "__at", F.stack(F.lit(len(grams)), *each).alias("__n", out))
    else:
        rows = rows.select(*keep, "__size", "__at", F.lit(low).alias("__n"), grams[low].alias(out))
    return rows.where(F.col("__at") + F.col("__n") <= F.col("__size")).select(*keep, out)


def count_terms(df: DataFrame, terms: Column, groups: Sequence[str] = (), out: str = "term") -> DataFrame:
    """Occurrences of each term per group; partial counts precede the shuffle."""
    return term_rows(df, terms, groups, out).groupBy(*groups, out).agg(F.count(F.lit(1)).alias("n"))


def token_counts(df: DataFrame, tokens: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Corpus-wide count per token."""
    return count_terms(df, tokens, groups, "token")


def unique_tokens(df: DataFrame, tokens: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Set of tokens."""
    return term_rows(df, tokens, groups, "token").distinct()


SKETCH_BITS = 12  # a sketch has 2**12 registers


def term_sketches(df: DataFrame, terms: Column, groups: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """``(groups, sketch)``: what is needed to estimate the number of distinct terms, a few KB per group.

    Sketches of parts of a corpus can be kept and merged, unlike distinct counts.
    """
    return term_rows(df, terms, groups).groupBy(*groups).agg(F.hll_sketch_agg("term", bits).alias("sketch"))


def merged_sketches(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``(groups, sketch, estimate)``: sketches of a group united, with the number of distinct terms.

    The relative standard error is about 1.04 / sqrt(2**bits): 1.6 % for 12 bits.
    """
    united = sketches.groupBy(*groups).agg(F.hll_union_agg("sketch").alias("sketch"))
    return united.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def ngram_counts(
    df: DataFrame, low: int, high: int, keys: Sequence[str] = ("language", "sentence_id"), tokens: str = "tokens"
) -> DataFrame:
    """Term-document counts in long form: ``(keys, ngram, n)``.

    When the keys identify a sentence, hash the sentences by it beforehand
    (``ids.co_locate(df, "sentence_id")``): the shuffle then carries the texts
    instead of their many n-grams, and this and every later grouping by that
    key and other columns finds its rows in place.
    """
    return ngram_rows(df, tokens, low, high, keys).groupBy(*keys, "ngram").agg(F.count(F.lit(1)).alias("n"))


def fit_vocabulary(counts: DataFrame, term: str = "ngram") -> DataFrame:
    """Distinct n-grams of the training counts."""
    return counts.select(term).distinct()


def apply_vocabulary(counts: DataFrame, vocabulary: DataFrame, term: str = "ngram") -> DataFrame:
    """Keep counts of known n-grams; unknown ones are dropped."""
    return counts.join(vocabulary, term, "left_semi")


def bigram_counts(
    df: DataFrame,
    groups: Sequence[str],
    order_in: str,
    key: str,
    tokens: str = "tokens",
    cross_border: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Adjacent token pairs per group over the concatenated token stream.

    Sentences follow each other by ``order_in`` (language), then by the integer
    ``key``. Pairs inside a sentence never leave its row; large tables are dealt out
    before them (``ids.dealt``), so that a task's counts stay in memory. For pairs across a
    border only the first and last token of each non-empty sentence are moved:
    they are sorted within key ranges, and the ends of consecutive ranges are
    paired in the small table of ranges, in runs of ``RUN_RANGES`` ranges. Both
    steps read the same shuffle.
    """
    inside = ngram_rows(dealt(df.select(*groups, tokens)), tokens, 2, 2, groups, "bigram")
    if not cross_border:
        return inside.groupBy(*groups, "bigram").agg(F.count(F.lit(1)).alias("n"))
    key_range = F.floor(F.col(key) / F.lit(bucket_rows)).cast("bigint").alias("range")
    # a generator, not a filter: a filter would be pushed down and tokenize once more
    both_ends = F.struct(F.get(tokens, F.lit(0)).alias("first"), F.get(tokens, F.size(tokens) - 1).alias("last"))
    slot = F.struct(*groups, F.col(order_in).alias("__order"), key_range).alias("slot")
    slotted = df.select(slot, F.col(key).alias("key"), F.col(tokens))
    edges = slotted.select(
        "slot", "key", F.inline(F.when(F.size(tokens) > 0, F.array(both_ends)))
    ).repartition("slot")
    in_group = [F.col(f"slot.{g}").alias(g) for g in groups]
    following = F.lead("first").over(Window.partitionBy("slot").orderBy("key"))
    within = edges.select("slot", "last", following.alias("next"))
    ends = edges.groupBy("slot").agg(F.min_by("first", "key").alias("first"), F.max_by("last", "key").alias("last"))
    # ranges meet in runs, then the ends of runs meet, so no task sorts all ranges of a group
    run = F.struct(*in_group, F.col("slot.__order").alias("__order"), F.floor(F.col("slot.range") / RUN_RANGES).alias("run"))
    ends = ends.withColumn("run", run)
    next_slot = Window.partitionBy("run").orderBy("slot.range")
    between = ends.select("slot", "last", F.lead("first").over(next_slot).alias("next"))
    run_ends = ends.groupBy("run").agg(
        F.max("slot").alias("slot"), F.min_by("first", "slot.range").alias("first"), F.max_by("last", "slot.range").alias("last")
    )
    next_run = Window.partitionBy(*[F.col(f"run.{g}") for g in groups]).orderBy("run.__order", "run.run")
    between_runs = run_ends.select("slot", "last", F.lead("first").over(next_run).alias("next"))
    border = within.unionByName(between).unionByName(between_runs).where(F.col("next").isNotNull())
    border = border.select(*in_group, F.concat_ws(" ", "last", "next").alias("bigram"))
    return inside.unionByName(border).groupBy(*groups, "bigram").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_overlap(train: DataFrame, test: DataFrame, term: str = "token") -> DataFrame:
    """Terms of both corpora with both counts."""
    a = train.select(term, F.col("n").alias("n_train"))
    b = test.select(term, F.col("n").alias("n_test"))
    return a.join(b, term)


def overlap_difference(overlap: DataFrame) -> DataFrame:
    """Add the count difference test - train."""
    return overlap.withColumn("difference", F.col("n_test") - F.col("n_train"))


def overlap_probability_difference(overlap: DataFrame, digits: int = 9) -> DataFrame:
    """Relative frequencies over the shared terms and their difference."""
    p_train = F.col("n_train") / scalar(overlap, F.sum("n_train"))
    p_test = F.col("n_test") / scalar(overlap, F.sum("n_test"))
    return overlap.select(
        *[c for c in overlap.columns if c not in ("n_train", "n_test")],
        F.round(p_train, digits).alias("p_train"),
        F.round(p_test, digits).alias("p_test"),
        F.round(p_test - p_train, digits).alias("difference"),
    )


def overlap_in_one_pass(counts: DataFrame, term: str, corpus: str = "corpus") -> DataFrame:
    """Overlap of corpora ``train`` and ``test`` from one count table.

    ``counts`` holds ``(corpus, term, n)``; pivoting it by a second aggregation
    on the term saves the self-join and the second scan.
    """
    def side(name: str) -> Column:
        return F.sum(F.when(F.col(corpus) == name, F.col("n")))

    both = counts.groupBy(term).agg(side("train").alias("n_train"), side("test").alias("n_test"))
    return both.where(F.col("n_train").isNotNull() & F.col("n_test").isNotNull())


def divergence_matrix(cells: DataFrame) -> DataFrame:
    """Number of (sentence, n-gram) cells whose counts differ, per language pair.

    ``cells`` holds ``(language, sentence_id, ngram, n)``. With nnz(l) the cells of
    language l, the number is nnz(a) + nnz(b) - both(a, b) - equal(a, b).

    Cells are grouped by their (language, count) signature first and languages
    are paired per distinct signature, which is at most as long as the number of
    languages. A language paired with itself gives nnz, so one pass over the
    cells yields everything; the rest works on (languages)**2 rows.
    """
    signature = F.array_sort(F.collect_list(F.struct("language", "n"))).alias("signature")
    shared = (
        cells.groupBy("sentence_id", "ngram").agg(signature)
        .groupBy("signature").agg(F.count(F.lit(1)).alias("weight"))
    )
    pairs = shared.select("signature", "weight", F.explode("signature").alias("a")).select(
        "weight", "a", F.explode("signature").alias("b")
    )
    met = pairs.groupBy(F.col("a.language").alias("lang1"), F.col("b.language").alias("lang2")).agg(
        F.sum("weight").alias("both"),
        F.sum(F.when(F.col("a.n") == F.col("b.n"), F.col("weight")).otherwise(0)).alias("equal"),
    )
    rows = met.groupBy("lang1").agg(
        F.collect_list(F.struct("lang2", (F.col("both") + F.col("equal")).alias("overlap"))).alias("partners"),
        F.sum(F.when(F.col("lang1") == F.col("lang2"), F.col("both"))).alias("nnz1"),
    )
    everyone = F.collect_list(F.struct(F.col("lang1").alias("lang2"), F.col("nnz1").alias("nnz2"))).over(
        Window.partitionBy(F.lit(0))
    )
    grid = rows.withColumn("everyone", everyone).select("lang1", "nnz1", "partners", F.inline("everyone"))
    found = F.filter("partners", lambda p: p["lang2"] == F.col("lang2"))
    overlap = F.coalesce(F.get(found, F.lit(0))["overlap"], F.lit(0))
    return grid.where(F.col("lang1") != F.col("lang2")).select(
        "lang1", "lang2", (F.col("nnz1") + F.col("nnz2") - overlap).alias("num_disagreements")
    )


def normalized_divergence(divergence: DataFrame, cells: DataFrame, n_sentences: Column) -> DataFrame:
    """Add the matrix size (sentences x vocabulary) and the share of differing cells.

    Of ``cells`` only the distinct values of ``ngram`` count, so it may be their occurrences.
    """
    n_terms = scalar(cells.select("ngram").distinct(), F.count(F.lit(1)))
    total = n_terms * n_sentences
    return divergence.withColumn("total", total).withColumn(
        "normalized", F.round(F.col("num_disagreements") / F.col("total"), 9)
    )


def divergence_by_language(divergence: DataFrame) -> DataFrame:
    """Mean disagreement of each language, half rounded to even."""
    return divergence.groupBy("lang1").agg(F.bround(F.avg("num_disagreements"), 0).alias("mean_disagreements"))


def closer_than(divergence: DataFrame) -> DataFrame:
    """For every (lang1, lang2): the partners of lang1 at most as far as lang2.

    Each language has as many partners as there are languages, so they are
    listed next to each row instead of joined.
    """
    partners = F.collect_list(
        F.struct(F.col("lang2").alias("closer"), F.col("num_disagreements").alias("closer_disagreements"))
    ).over(Window.partitionBy("lang1"))
    listed = divergence.withColumn("__partners", partners)
    return listed.select("lang1", "lang2", "num_disagreements", F.inline("__partners")).where(
        F.col("closer_disagreements") <= F.col("num_disagreements")
    )
