"""Subword vocabulary, segmentation and token statistics.

Statistics over a whole corpus first count words per language (partial counts
on the map side) and then segment each distinct word once, weighted by its
count. Only per-sentence outputs segment sentence by sentence, which needs no
shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from glossaria.functions.text import clean_word, explode_terms, posexplode_terms, segment_words
from glossaria.operators.ids import co_locate, dimension

# Marks of the usual word-piece convention.
UNK, CLS, SEP, CONTINUATION = "[UNK]", "[CLS]", "[SEP]", "##"
MAX_VOCABULARY = 1 << 18
KNOWN_WORDS = 1 << 16  # segmented words that a worker keeps between batches
SENTENCE_WORDS = 1 << 18  # words that a worker segments at a time


def word_counts(df: DataFrame, groups: Sequence[str] = ("language",), text: str = "text") -> DataFrame:
    """Occurrences of each word per group."""
    words = df.select(*groups, explode_terms(segment_words(text)).alias("word"))
    return words.groupBy(*groups, "word").agg(F.count(F.lit(1)).alias("n"))


def piece_counts(words: DataFrame, max_length: int) -> DataFrame:
    """Weighted count of word-initial and continuing character n-grams.

    A word of m letters has at most m * max_length pieces.
    """
    letters = words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("m", F.length("word"))
    starts = letters.select("word", "n", "m", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("start"))
    longest = F.least(F.lit(max_length), F.col("m") - F.col("start") + 1)
    cut = starts.select("word", "n", "start", F.explode(F.sequence(F.lit(1), longest)).alias("k"))
    prefix = F.when(F.col("start") == 1, "").otherwise(CONTINUATION)
    piece = F.concat(prefix, F.substring("word", F.col("start"), F.col("k"))).alias("piece")
    return cut.groupBy(piece).agg(F.sum("n").alias("n"))


def train_vocabulary(words: DataFrame, size: int = 4096, max_length: int = 6) -> DataFrame:
    """The ``size`` most frequent pieces with ids; ties in piece order."""
    if size > MAX_VOCABULARY:
        raise ValueError(f"vocabulary size is limited to {MAX_VOCABULARY}")
    return piece_counts(words, max_length).orderBy(F.desc("n"), "piece").limit(size)


@dataclass(frozen=True)
class Segmenter:
    """Greedy longest-match segmentation with a broadcast vocabulary."""

    vocabulary: Broadcast
    max_length: int

    @classmethod
    def from_table(cls, vocabulary: DataFrame) -> Segmenter:
        """Broadcast a trained vocabulary; at most ``MAX_VOCABULARY`` pieces are read."""
        rows = vocabulary.select("piece").limit(MAX_VOCABULARY + 1).collect()
        if len(rows) > MAX_VOCABULARY:
            raise ValueError(f"vocabulary has more than {MAX_VOCABULARY} pieces")
        pieces = frozenset(r.piece for r in rows)
        longest = max((len(p.removeprefix(CONTINUATION)) for p in pieces), default=1)
        return cls(vocabulary.sparkSession.sparkContext.broadcast(pieces), longest)

    def word_pieces(self, words: Column) -> Column:
        """``string -> array<string>``; a word with an unmatched rest is unknown."""
        segmented = self._segmented()

        @arrow_udf("array<string>")
        def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = {}
            for batch in batches:
                yield segmented(batch, known)

        return segment(words)

    def sentence_pieces(self, words: Column) -> Column:
        """``array<string> -> array<array<string>>``; null stays null.

        Each distinct word of some sentences is segmented once and its pieces are taken
        from there for all occurrences, ``SENTENCE_WORDS`` words at a time, so a worker
        holds no object per word of a batch.
        """
        segmented = self._segmented()

        @arrow_udf("array<array<string>>")
        def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = {}
            for batch in batches:
                for some in word_slices(batch, SENTENCE_WORDS):
                    # null sentences have no words, so offsets follow from the lengths
                    lengths = pc.fill_null(pc.list_value_length(some), 0).to_numpy()
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                    yield pa.ListArray.from_arrays(offsets, segmented(some.flatten(), known), mask=some.is_null())

        return segment(words)

    def _segmented(self):
        """A function of an array of words and a dictionary of words segmented before, which it adds to."""
        vocabulary, longest = self.vocabulary, self.max_length

        def segmented(words: pa.Array, known: dict[str, list[str]]) -> pa.Array:
            pieces, coded = vocabulary.value, words.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) + len(distinct) > KNOWN_WORDS:
                known.clear()
            known.update((w, longest_match(w, pieces, longest)) for w in distinct if w not in known)
            return pa.array([known[w] for w in distinct], pa.list_(pa.string())).take(coded.indices)

        return segmented


def word_slices(sentences: pa.Array, words: int) -> Iterator[pa.Array]:
    """The sentences in order, in slices of at most ``words`` words; a longer sentence is a slice of its own."""
    ends, start = np.cumsum(pc.fill_null(pc.list_value_length(sentences), 0).to_numpy().astype(np.int64)), 0
    while start < len(sentences):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + words, side="right")))
        yield sentences.slice(start, stop - start)
        start = stop


def longest_match(word: str, pieces: frozenset[str], longest: int) -> list[str]:
    out, start, mark = [], 0, ""
    while start < len(word):
        ends = range(min(len(word), start + longest), start, -1)
        end = next((e for e in ends if mark + word[start:e] in pieces), None)
        if end is None:
            return [UNK]
        out.append(mark + word[start:end])
        start, mark = end, CONTINUATION
    return out


def lexicon(words: DataFrame, segmenter: Segmenter) -> DataFrame:
    """Add ``pieces`` to a table of distinct words."""
    return words.withColumn("pieces", segmenter.word_pieces(F.col("word")))


def segmented_sentences(df: DataFrame, segmenter: Segmenter, keys: Sequence[str]) -> DataFrame:
    """Per sentence: ``words`` and their ``pieces``; row-wise, no shuffle. A null text has none."""
    words = df.select(*keys, F.coalesce(segment_words("text"), F.array().cast("array<string>")).alias("words"))
    return words.withColumn("pieces", segmenter.sentence_pieces(F.col("words")))


def tokenize_corpus(df: DataFrame, segmenter: Segmenter, keys: Sequence[str]) -> DataFrame:
    """Rows ``(keys, position, token, word_id, word)``; special tokens have no word."""
    sentences = segmented_sentences(df, segmenter, keys)
    none = F.lit(None)

    def entry(token: Column, word_id: Column, word: Column) -> Column:
        return F.struct(
            token.alias("token"), word_id.cast("bigint").alias("word_id"), word.cast("string").alias("word")
        )

    tokens = F.flatten(
        F.transform("pieces", lambda p, i: F.transform(p, lambda t: entry(t, i, F.get("words", i))))
    )
    special = [F.array(entry(F.lit(name), none, none)) for name in (CLS, SEP)]
    rows = F.concat(special[0], tokens, special[1])
    exploded = sentences.select(*keys, F.posexplode(rows).alias("position", "t"))
    return exploded.select(*keys, F.col("position").cast("bigint").alias("position"), "t.*")


def add_token_ids(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vocabulary id of each token; special tokens get negative ids."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "piece")
    ids = vocabulary.select(F.col("piece").alias("token"), (F.row_number().over(order) - 1).cast("bigint").alias("token_id"))
    special = F.when(F.col("token") == UNK, -1).when(F.col("token") == CLS, -2).when(F.col("token") == SEP, -3)
    return tokens.join(ids, "token", "left").withColumn("token_id", F.coalesce("token_id", special))


def unk_fraction(df: DataFrame, segmenter: Segmenter, keys: Sequence[str]) -> DataFrame:
    """Share of unknown tokens per sentence, special tokens counted in."""
    tokens = segmented_sentences(df, segmenter, keys).select(*keys, F.flatten("pieces").alias("tokens"))
    unknown = F.size(F.filter("tokens", lambda t: t == UNK))
    return tokens.select(*keys, (unknown / (F.size("tokens") + F.lit(2))).alias("unk_fraction"))


def unk_by_language(fractions: DataFrame, top: int | None = None, digits: int = 6) -> DataFrame:
    """Mean of the sentence shares per language, highest first."""
    means = fractions.groupBy("language").agg(F.round(F.avg("unk_fraction"), digits).alias("mean_unk_fraction"))
    ordered = means.orderBy(F.desc("mean_unk_fraction"), "language")
    return ordered.limit(top) if top else ordered


def word_segmentations(
    df: DataFrame, segmenter: Segmenter, keys: Sequence[str], merge_repeats: bool = False
) -> DataFrame:
    """Tokens of each word of a sentence.

    One row per occurrence; ``merge_repeats`` concatenates the tokens of a word
    that occurs several times in a sentence.
    """
    if merge_repeats:
        # the pieces of a word are the same at each place, so they are repeated instead of collected
        words = co_locate(df.select(*keys, "text"), *keys).select(*keys, explode_terms(segment_words("text")).alias("word"))
        counted = lexicon(words.groupBy(*keys, "word").agg(F.count(F.lit(1)).cast("int").alias("n")), segmenter)
        return counted.select(*keys, "word", F.flatten(F.array_repeat("pieces", F.col("n"))).alias("pieces"))
    sentences = segmented_sentences(df, segmenter, keys)
    zipped = F.posexplode(F.arrays_zip("words", "pieces")).alias("word_id", "w")
    return sentences.select(*keys, zipped).select(
        *keys, F.col("word_id").cast("bigint").alias("word_id"), F.col("w.words").alias("word"), F.col("w.pieces").alias("pieces")
    )


def token_word_joint(lex: DataFrame) -> DataFrame:
    """Counts of (language, token, word) from a lexicon ``(language, word, n, pieces)``.

    All tokens of a word sit in its row, so nothing is shuffled. ``n_word`` is
    the marginal of the word: its occurrences times its tokens.
    """
    counted = F.transform(
        F.array_distinct("pieces"),
        lambda t: F.struct(t.alias("token"), F.size(F.filter("pieces", lambda p: p == t)).alias("k")),
    )
    rows = lex.select("language", "word", "n", (F.col("n") * F.size("pieces")).alias("n_word"), F.inline(counted))
    return rows.select("language", "token", "word", (F.col("n") * F.col("k")).alias("n"), "n_word")


def token_word_marginals(joint: DataFrame) -> DataFrame:
    """Joint counts, both marginals and the total per language in one pass."""
    sets = [
        [F.col("language"), F.col("token"), F.col("word")],
        [F.col("language"), F.col("token")],
        [F.col("language"), F.col("word")],
        [F.col("language")],
    ]
    grouped = joint.groupingSets(sets, "language", "token", "word")
    return grouped.agg(F.sum("n").alias("n"))


def conditional_probabilities(joint: DataFrame, digits: int = 9) -> DataFrame:
    """p(token | word) and p(word | token) per language.

    The word marginal is known from the word's own row. The token marginal has
    at most (languages x vocabulary) rows and is joined back instead of computed
    in a window, so a frequent token does not gather all its words in one task.
    """
    by_token = dimension(joint.groupBy("language", "token").agg(F.sum("n").alias("n_token")))
    return joint.join(by_token, ["language", "token"]).select(
        "language", "token", "word", "n",
        F.round(F.col("n") / F.col("n_word"), digits).alias("token_given_word"),
        F.round(F.col("n") / F.col("n_token"), digits).alias("word_given_token"),
    )


def vocabulary_reduction(lex: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct words, distinct subwords and their ratio per language, worst last."""
    tokens = lex.select("language", posexplode_terms("pieces").alias("at", "token"))
    per_token = tokens.groupBy("language", "token").agg(F.count_if(F.col("at") == 0).alias("n_first"))
    out = per_token.groupBy("language").agg(
        F.sum("n_first").alias("n_words"), F.count(F.lit(1)).alias("n_subwords")
    ).withColumn(
        "vocab_reduction_ratio", F.round(F.col("n_subwords") / F.col("n_words"), 2)
    )
    return out.orderBy(F.desc("vocab_reduction_ratio"), "language").limit(top) if top else out


def word_length_in_tokens(lex: DataFrame, by_language: bool = True, digits: int = 6) -> DataFrame:
    """Histogram of word length in tokens over distinct words, count and density."""
    groups = ["language"] if by_language else []
    lengths = lex.groupBy(*groups, F.size("pieces").cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    if not groups:
        total = F.sum("n").alias("total")
        return lengths.withColumn("density", F.round(F.col("n") / lengths.agg(total).scalar(), digits))
    totals = lengths.groupBy(*groups).agg(F.sum("n").alias("total"))
    return lengths.join(totals, groups).withColumn("density", F.round(F.col("n") / F.col("total"), digits)).drop("total")


def token_length_in_chars(lex: DataFrame) -> DataFrame:
    """Histogram of token length over distinct tokens, with their occurrences."""
    tokens = lex.select("n", explode_terms("pieces").alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
    return tokens.groupBy(F.length("token").cast("bigint").alias("token_length")).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum("n").alias("occurrences")
    )


def segmentations_per_word(lex: DataFrame) -> DataFrame:
    """Number of distinct segmentations of each cleaned word per language."""
    cleaned = lex.select("language", clean_word("word").alias("word"), F.concat_ws(" ", "pieces").alias("s"))
    return cleaned.distinct().groupBy("language", "word").agg(F.count(F.lit(1)).alias("n_segmentations"))


def segmentation_histogram(per_word: DataFrame) -> DataFrame:
    """Words per (language, number of segmentations)."""
    return per_word.groupBy("language", "n_segmentations").agg(F.count(F.lit(1)).alias("n_words"))


def segmentation_histogram_wide(histogram: DataFrame, languages: Sequence[str]) -> DataFrame:
    """One column per language, 0-filled, plus the sum over languages."""
    wide = histogram.groupBy("n_segmentations").pivot("language", list(languages)).agg(F.sum("n_words")).fillna(0)
    total = sum((F.col(c) for c in languages), F.lit(0).cast("bigint"))
    return wide.withColumn("total", total)


def sentence_token_index(df: DataFrame, segmenter: Segmenter, keys: Sequence[str]) -> DataFrame:
    """sentence -> token counts."""
    tokens = segmented_sentences(df, segmenter, keys).select(*keys, F.flatten("pieces").alias("tokens"))
    rows = tokens.select(*keys, explode_terms("tokens").alias("token"))
    return rows.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def word_sentence_index(df: DataFrame, key: str, range_size: int | None = None) -> DataFrame:
    """word -> sentence counts per language, long form.

    Sentences are hashed by their key before they are cut into words, so texts are
    shuffled, not their words. With ``range_size`` they are hashed by ranges of as many
    keys, and the rows have the range's number as ``part``: :func:`posting_lists` then
    finds the rows of its lists in place.
    """
    parts = [] if range_size is None else [_part(key, range_size)]
    place = "part" if parts else key
    placed = co_locate(df.select("language", key, "text", *parts), place)
    keys = ["language", "word", *(["part"] if parts else []), key]
    words = placed.select(*[c for c in keys if c != "word"], explode_terms(segment_words("text")).alias("word"))
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _part(key: str, range_size: int) -> Column:
    return F.floor(F.col(key) / F.lit(range_size)).cast("bigint").alias("part")


def posting_lists(index: DataFrame, key: str, range_size: int = 1024) -> DataFrame:
    """Posting lists of a word -> sentence index.

    A word may occur in most sentences, so its list comes in parts covering
    ``range_size`` consecutive keys each; an index made with that ``range_size`` is not
    shuffled again.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), "n"))).alias("postings")
    return index.groupBy("language", "word", "part" if "part" in index.columns else _part(key, range_size)).agg(entries)
