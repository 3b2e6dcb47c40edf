"""Unicode profiles and romanization."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaria.operators import romanize as rom
from glossaria.operators import scripts as sc
from glossaria.plans import fixtures as fx

KEYS = ["doc_id", "language"]


def unicode_block_histogram(spark, sf_dir):
    return sc.unicode_block_histogram(fx.cyrillic(spark, sf_dir), KEYS)


def unicode_block_counts(spark, sf_dir):
    return sc.unicode_block_histogram(
        fx.cyrillic(spark, sf_dir), KEYS, normalize=False, strip=True, ignore_punctuation=True, ignore_numbers=True
    )


def script_histogram(spark, sf_dir):
    return sc.script_histogram(fx.cyrillic(spark, sf_dir), KEYS)


def script_counts(spark, sf_dir):
    return sc.script_histogram(fx.cyrillic(spark, sf_dir), KEYS, normalize=False, ignore_punctuation=True, ignore_numbers=True)


def dominant_block(spark, sf_dir):
    return sc.dominant(fx.cyrillic(spark, sf_dir), KEYS, sc.BLOCK)


def dominant_script(spark, sf_dir):
    return sc.dominant(fx.cyrillic(spark, sf_dir), KEYS, sc.SCRIPT)


def script_detection(spark, sf_dir):
    return sc.script_shares(dominant_script(spark, sf_dir))


def romanize(spark, sf_dir):
    out = rom.romanize(fx.cyrillic(spark, sf_dir))
    return out.select("doc_id", "language", F.md5("text").alias("text"))


def augment_romanized(spark, sf_dir):
    out = rom.augment_romanized(fx.cyrillic(spark, sf_dir))
    return out.groupBy("corpus", "language", F.substring(F.md5("text"), 1, 2).alias("digest")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


QUERIES = {
    f.__name__: f
    for f in (
        unicode_block_histogram, unicode_block_counts, script_histogram, script_counts, dominant_block,
        dominant_script, script_detection, romanize, augment_romanized,
    )
}

# The blocks met in the given tables.
_BLOCK = """CASE WHEN unicode(ch) < 128 THEN 'BASIC_LATIN' WHEN unicode(ch) < 256 THEN 'LATIN_1_SUPPLEMENT'
  WHEN unicode(ch) < 384 THEN 'LATIN_EXTENDED_A' WHEN unicode(ch) < 592 THEN 'LATIN_EXTENDED_B'
  WHEN unicode(ch) BETWEEN 1024 AND 1279 THEN 'CYRILLIC' WHEN unicode(ch) BETWEEN 8192 AND 8303 THEN 'GENERAL_PUNCTUATION'
  ELSE 'OTHER' END"""
_SCRIPT = r"""CASE WHEN regexp_matches(ch, '\p{Latin}') THEN 'Latin' WHEN regexp_matches(ch, '\p{Cyrillic}') THEN 'Cyrillic'
  WHEN regexp_matches(ch, '\p{Common}') THEN 'Common' ELSE 'Other' END"""
_CLEAN = r"regexp_replace(regexp_replace({0}, '[\p{{P}}\p{{S}}]+', '', 'g'), '\p{{N}}+', '', 'g')"
_STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _profile(name: str, text: str = "text") -> str:
    return f"""{fx.CYRILLIC_SQL}, chars AS (
  SELECT doc_id, language, ch, count(*) AS n, min(step) AS first_pos FROM (
    SELECT doc_id, language, unnest(string_split({text}, '')) AS ch, generate_subscripts(string_split({text}, ''), 1) AS step
    FROM cyrillic) WHERE ch <> '' GROUP BY ALL),
profile AS (SELECT doc_id, language, {name} AS name, CAST(sum(n) AS BIGINT) AS n, min(first_pos) AS first_pos
  FROM chars GROUP BY ALL),
best AS (SELECT doc_id, language, name FROM profile
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) = 1),
dominant AS (SELECT c.doc_id, c.language, coalesce(b.name, '') AS name FROM cyrillic c LEFT JOIN best b USING (doc_id))"""


def _romanized(text: str = "text") -> str:
    """The letter tables as SQL, one branch per language."""
    branches = []
    for code, letters in rom.LETTERS.items():
        single_from, single_to, longer = rom.letter_table(letters)
        sql = f"translate({text}, '{single_from}', '{single_to}')"
        for source, target in longer:
            sql = f"replace({sql}, '{source}', '{target}')"
        branches.append(f"WHEN '{code}' THEN {sql}")
    return f"CASE language {' '.join(branches)} ELSE {text} END"


_FRACTIONS = """SELECT doc_id, language, name, round(n / sum(n) OVER (PARTITION BY doc_id), 9) AS fraction FROM profile"""
ORACLES = {
    "unicode_block_histogram": f"WITH {_profile(_BLOCK)} {_FRACTIONS}",
    "unicode_block_counts": f"WITH {_profile(_BLOCK, _CLEAN.format(_STRIPPED))} SELECT doc_id, language, name, n FROM profile",
    "script_histogram": f"WITH {_profile(_SCRIPT)} {_FRACTIONS}",
    "script_counts": f"WITH {_profile(_SCRIPT, _CLEAN.format('text'))} SELECT doc_id, language, name, n FROM profile",
    "dominant_block": f"WITH {_profile(_BLOCK)} SELECT * FROM dominant",
    "dominant_script": f"WITH {_profile(_SCRIPT)} SELECT * FROM dominant",
    "script_detection": f"""WITH {_profile(_SCRIPT)} SELECT language, name AS script, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY language), 6) AS share FROM dominant GROUP BY language, name""",
    "romanize": f"""WITH {fx.CYRILLIC_SQL} SELECT doc_id, language || '-rom' AS language, md5({_romanized()}) AS text FROM cyrillic""",
    "augment_romanized": f"""WITH {fx.CYRILLIC_SQL}, both_texts AS (SELECT corpus, language, text FROM cyrillic
        UNION ALL SELECT corpus, language, {_romanized()} FROM cyrillic)
      SELECT corpus, language, substr(md5(text), 1, 2) AS digest, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars
      FROM both_texts GROUP BY ALL""",
}
