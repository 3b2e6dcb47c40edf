"""Unicode block and script profiles of texts.

The character tables are those of the JVM: a code point is mapped by the
``Character.UnicodeBlock`` / ``Character.UnicodeScript`` classes through the SQL
function ``java_method``, after characters have been counted per text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.functions.text import strip_whitespace
from glossaria.operators.ids import co_locate

BLOCK, SCRIPT = "block", "script"
_CLASSES = {BLOCK: "java.lang.Character$UnicodeBlock", SCRIPT: "java.lang.Character$UnicodeScript"}


def prepare_text(
    text: Column, strip: bool = False, ignore_punctuation: bool = False, ignore_numbers: bool = False
) -> Column:
    """Remove what the profile should not count: edges, P* and S*, N*."""
    out = strip_whitespace(text) if strip else text
    if ignore_punctuation:
        out = F.regexp_replace(out, r"[\p{P}\p{S}]+", "")
    return F.regexp_replace(out, r"\p{N}+", "") if ignore_numbers else out


def code_point_name(code_point: Column, kind: str = BLOCK) -> Column:
    """``BASIC_LATIN`` style for blocks, ``Latin`` style for scripts; null outside of any block."""
    raw = F.nullif(F.java_method(F.lit(_CLASSES[kind]), F.lit("of"), code_point), F.lit("null"))
    if kind == BLOCK:
        return raw
    return F.replace(F.initcap(F.replace(F.lower(raw), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))


# ASCII character classes that share one block or script, with a
# member that stands for the class.
_ASCII_CLASSES = {
    BLOCK: ((r"\x00-\x7f", "a"),),
    SCRIPT: (("A-Za-z", "a"), (r"\x00-@\[-`{-\x7f", " ")),
}
# Widespread blocks and scripts; a run of characters of one of them
# is counted at once, any other character on its own.
_BLOCK_RUNS = (
    "LATIN_1_SUPPLEMENT LATIN_EXTENDED_A LATIN_EXTENDED_ADDITIONAL GREEK CYRILLIC ARMENIAN HEBREW ARABIC DEVANAGARI "
    "BENGALI TAMIL THAI GEORGIAN ETHIOPIC HIRAGANA KATAKANA CJK_UNIFIED_IDEOGRAPHS HANGUL_SYLLABLES GENERAL_PUNCTUATION"
).split()
_SCRIPT_RUNS = (
    "LATIN GREEK CYRILLIC ARMENIAN HEBREW ARABIC DEVANAGARI BENGALI TAMIL THAI GEORGIAN ETHIOPIC HIRAGANA KATAKANA "
    "HAN HANGUL COMMON"
).split()
_RUNS = {
    BLOCK: "|".join(rf"\p{{In{name}}}+" for name in _BLOCK_RUNS) + r"|[^\x00-\x7f]",
    SCRIPT: "|".join(rf"[\p{{Is{name}}}&&[^\x00-\x7f]]+" for name in _SCRIPT_RUNS) + r"|[^\x00-\x7f]",
}


def char_profile(
    df: DataFrame, keys: Sequence[str], kind: str = BLOCK, text: str = "text", keep_empty: bool = False, **options: bool
) -> DataFrame:
    """Rows ``(keys, name, n, first_pos)``: characters per block or script.

    ASCII characters fall into one block and two scripts, so they are counted by
    length; other text is cut into runs of one block or script. Only runs are
    exploded, after the texts are hashed by their keys, so these counts and later
    groupings by the keys find their rows in place. ``first_pos`` orders
    the names of a text by first appearance: (number of earlier runs, ASCII
    first, offset). With ``keep_empty`` a text without characters keeps a row
    without name.
    """
    placed = co_locate(df.select(*keys, text), *keys)
    prepared = placed.select(*keys, prepare_text(F.col(text), **options).alias("__text"))
    body, runs = F.col("__text"), F.lit(_RUNS[kind])
    entries = [_ascii_entry(body, chars, member, runs) for chars, member in _ASCII_CLASSES[kind]]
    others = F.transform(
        F.regexp_extract_all(body, runs, F.lit(0)),
        lambda run, i: _entry(F.substring(run, 1, 1), F.length(run), i, 1, F.lit(0)),
    )
    found = F.filter(F.concat(F.array(*entries), others), lambda e: e["n"] > 0)
    generator = F.inline_outer if keep_empty else F.inline
    chars = prepared.select(*keys, generator(found))
    counted = chars.groupBy(*keys, "ch").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    name = F.when(F.col("ch").isNotNull(), code_point_name(F.ascii("ch"), kind)).alias("name")
    named = counted.select(*keys, name, "n", "first_pos")
    if not keep_empty:
        named = named.where(F.col("name").isNotNull())
    return named.groupBy(*keys, "name").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def _entry(ch: Column, n: Column, rank: Column, side: int, offset: Column) -> Column:
    position = F.struct(
        rank.cast("bigint").alias("rank"), F.lit(side).alias("side"), offset.cast("bigint").alias("offset")
    )
    return F.struct(ch.alias("ch"), n.cast("bigint").alias("n"), position.alias("first_pos"))


def _ascii_entry(body: Column, chars: str, member: str, runs: Column) -> Column:
    n = F.length(body) - F.length(F.regexp_replace(body, f"[{chars}]+", ""))
    lead = F.regexp_extract(body, f"^[^{chars}]*", 0)
    return _entry(F.lit(member), n, F.regexp_count(lead, runs), 0, F.length(lead))


def histogram(profile: DataFrame, keys: Sequence[str], normalize: bool = True, digits: int = 9) -> DataFrame:
    """Counts, or fractions of the counted characters of each text."""
    if not normalize:
        return profile.select(*keys, "name", "n")
    entries = F.collect_list(F.struct("name", "n")).alias("entries")
    per_text = profile.groupBy(*keys).agg(F.sum("n").alias("total"), entries)
    exploded = per_text.select(*keys, "total", F.explode("entries").alias("e"))
    fraction = F.round(F.col("e.n") / F.col("total"), digits).alias("fraction")
    return exploded.select(*keys, F.col("e.name").alias("name"), fraction)


def unicode_block_histogram(df: DataFrame, keys: Sequence[str], normalize: bool = True, **options) -> DataFrame:
    """Characters per Unicode block of each text."""
    return histogram(char_profile(df, keys, BLOCK, **options), keys, normalize)


def script_histogram(df: DataFrame, keys: Sequence[str], normalize: bool = True, **options) -> DataFrame:
    """Characters per Unicode script of each text, ``Common`` included."""
    return histogram(char_profile(df, keys, SCRIPT, **options), keys, normalize)


def dominant(df: DataFrame, keys: Sequence[str], kind: str = BLOCK, **options) -> DataFrame:
    """Most frequent block or script of each text.

    Of equally frequent names the first one in the text wins; a text without
    counted characters gets an empty name.
    """
    profile = char_profile(df, keys, kind, keep_empty=True, **options)
    order = F.struct(
        F.col("n").alias("n"),
        (-F.col("first_pos.rank")).alias("rank"),
        (-F.col("first_pos.side")).alias("side"),
        (-F.col("first_pos.offset")).alias("offset"),
    )
    best = profile.groupBy(*keys).agg(F.max_by("name", F.when(F.col("name").isNotNull(), order)).alias("name"))
    return best.withColumn("name", F.coalesce("name", F.lit("")))


def script_shares(dominant_scripts: DataFrame, language: str = "language") -> DataFrame:
    """Sentences per (language, dominant script) with the share in the language."""
    counts = dominant_scripts.groupBy(language, "name").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(language).agg(F.sum("n").alias("total"))
    return counts.join(totals, language).select(
        language, F.col("name").alias("script"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share")
    )
