"""Text expressions: cleaning, tokens and n-grams, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose meaning has to be the same in the SQL checks.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}+"
SEGMENT_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
EDGE_PATTERN = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
STRIP_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_whitespace(text: Column | str) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(_col(text), STRIP_PATTERN, "")


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_PATTERN), F.lit(0))


def space_tokens(text: Column | str) -> Column:
    """Split on single spaces; case and empty tokens are kept."""
    return F.split(_col(text), " ", -1)


def segment_words(text: Column | str) -> Column:
    """Words as a subword tokenizer sees them: letter runs, single symbols."""
    return F.regexp_extract_all(_col(text), F.lit(SEGMENT_PATTERN), F.lit(0))


def clean_word(word: Column | str) -> Column:
    """Drop non-word characters at both ends and lower; all-symbol words stay."""
    word = _col(word)
    cleaned = F.lower(F.regexp_replace(strip_whitespace(word), EDGE_PATTERN, ""))
    return F.coalesce(F.nullif(cleaned, F.lit("")), word)


def ngrams(tokens: Column | str, n: int) -> Column:
    """n-grams of a token array, joined by one space.

    Each position is read by index, so a text of m tokens costs O(n * m).
    ``tokens`` should be a column, not an expensive expression: it is
    referenced several times.
    """
    tokens = _col(tokens)
    if n == 1:
        return tokens
    last = F.size(tokens) - F.lit(n)
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<string>"))


def ngram_range(tokens: Column | str, low: int, high: int) -> Column:
    """All n-grams with ``low <= n <= high``."""
    parts = [ngrams(tokens, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def char_ngrams(text: Column | str, n: int) -> Column:
    """Character n-grams over the lower-cased text, across word borders.

    Runs of white space count as one space. The look-ahead consumes one code
    point per match, so a long text is scanned once.
    """
    squeezed = F.regexp_replace(F.lower(_col(text)), r"(?U)\s\s+", " ")
    return F.regexp_extract_all(squeezed, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def explode_terms(terms: Column | str) -> Column:
    """``explode`` of a computed array.

    For a bare column the optimizer infers ``size(col) > 0`` and pushes it below
    the projection that computes the array, which would run the regular
    expression several times per row; a non-column input prevents that.
    """
    return F.explode(F.coalesce(_col(terms), F.array().cast("array<string>")))


def posexplode_terms(terms: Column | str) -> Column:
    """``posexplode`` counterpart of :func:`explode_terms`."""
    return F.posexplode(F.coalesce(_col(terms), F.array().cast("array<string>")))


# Tokenizer rules of the BLEU metric (public "13a" scheme), in order.
BLEU_RULES = (
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"([{-~\[-` -&(-+:-@/])", r" \1 "),
    (r"([^0-9])([.,])", r"\1 \2 "),
    (r"([.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)


def bleu_tokens(text: Column | str) -> Column:
    """Tokens for corpus BLEU: punctuation split off, then white-space split."""
    out = F.concat(F.lit(" "), strip_whitespace(text), F.lit(" "))
    for pattern, replacement in BLEU_RULES:
        out = F.regexp_replace(out, pattern, replacement.replace("\\", "$"))
    return F.regexp_extract_all(out, F.lit(r"\S+"), F.lit(0))
