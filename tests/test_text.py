"""Hand-worked cases of the text expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glossaria.functions import text as tx
from glossaria.operators import romanize as rom
from glossaria.operators import scripts as sc
from glossaria.operators import subwords as sw


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"text {kind}").select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("«Hej!»", "hej"), ("...", "..."), ("", ""), (None, None), (" A-b ", "a-b"), ("_x_", "_x_"), ("42%", "42")],
)
def test_clean_word(spark, raw, expected):
    assert one(spark, raw, tx.clean_word("text")) == expected


def test_strip_keeps_inner_and_drops_unicode_space(spark):
    assert one(spark, " \t a  b  \n", tx.strip_whitespace("text")) == "a  b"


def test_word_and_space_tokens(spark):
    assert one(spark, "Ein  Éa x 12_3!", tx.word_tokens("text")) == ["ein", "éa", "12_3"]
    assert one(spark, "a  B ", tx.space_tokens("text")) == ["a", "", "B", ""]
    assert one(spark, "", tx.space_tokens("text")) == [""]


@pytest.mark.parametrize(("n", "expected"), [(1, ["a", "b", "c"]), (2, ["a b", "b c"]), (3, ["a b c"]), (4, [])])
def test_ngrams(spark, n, expected):
    assert one(spark, ["a", "b", "c"], tx.ngrams("text", n), "array<string>") == expected


def test_ngrams_of_nothing(spark):
    assert one(spark, [], tx.ngram_range("text", 1, 3), "array<string>") == []


def test_char_ngrams_cross_borders_and_planes(spark):
    assert one(spark, "Ab  c", tx.char_ngrams("text", 2)) == ["ab", "b ", " c"]
    assert one(spark, "a😀b", tx.char_ngrams("text", 2)) == ["a😀", "😀b"]
    assert one(spark, "a", tx.char_ngrams("text", 2)) == []


def test_bleu_tokens(spark):
    assert one(spark, "It's 3.5, ok-ay.", tx.bleu_tokens("text")) == ["It's", "3.5", ",", "ok-ay", "."]


def test_characters_outside_any_block_are_not_counted(spark):
    df = spark.createDataFrame([(1, "\u2fe0"), (2, "a\u2fe0")], "id long, text string")
    profile = sc.unicode_block_histogram(df, ["id"], normalize=False).collect()
    assert [(r["id"], r["name"], r["n"]) for r in profile] == [(2, "BASIC_LATIN", 1)]
    assert {r["id"]: r["name"] for r in sc.dominant(df, ["id"]).collect()} == {1: "", 2: "BASIC_LATIN"}


CORNERS = ["", " ", "!?", "123", "x", "ab ab", "a  b", "é", "a😀", "Да wow", "日本語 kana かな", "ελ ά"]


@pytest.mark.parametrize("kind", [sc.BLOCK, sc.SCRIPT])
def test_profile_counts_every_character(spark, kind):
    df = spark.createDataFrame(list(enumerate(CORNERS)), "id long, text string")
    profile = sc.char_profile(df, ["id"], kind)
    totals = {r.id: r.n for r in profile.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    assert totals == {i: len(t) for i, t in enumerate(CORNERS) if t}
    for r in sc.histogram(profile, ["id"]).groupBy("id").agg(F.sum("fraction").alias("f")).collect():
        assert abs(r.f - 1) < 1e-6


def test_profile_names(spark):
    df = spark.createDataFrame([(1, "Да wow"), (2, "日本 かな"), (3, "𐍈x")], "id long, text string")
    blocks = {(r.id, r.name): r.n for r in sc.char_profile(df, ["id"]).collect()}
    assert blocks == {
        (1, "CYRILLIC"): 2, (1, "BASIC_LATIN"): 4, (2, "CJK_UNIFIED_IDEOGRAPHS"): 2, (2, "HIRAGANA"): 2,
        (2, "BASIC_LATIN"): 1, (3, "GOTHIC"): 1, (3, "BASIC_LATIN"): 1,
    }
    scripts = {(r.id, r.name): r.n for r in sc.char_profile(df, ["id"], sc.SCRIPT).collect()}
    assert scripts == {
        (1, "Cyrillic"): 2, (1, "Latin"): 3, (1, "Common"): 1, (2, "Han"): 2, (2, "Hiragana"): 2, (2, "Common"): 1,
        (3, "Gothic"): 1, (3, "Latin"): 1,
    }


@pytest.mark.parametrize(
    ("text", "expected"), [("aД", "Latin"), ("Дa", "Cyrillic"), (" aД", "Common"), ("", ""), ("ДaД", "Cyrillic"), ("éД", "Latin"), ("Дé", "Cyrillic")]
)
def test_dominant_script_first_seen_wins(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert [r.name for r in sc.dominant(df, ["id"], sc.SCRIPT).collect()] == [expected]


def test_profile_options(spark):
    df = spark.createDataFrame([(1, " a1+! "), (2, "٣٤")], "id long, text string")
    kept = sc.char_profile(df, ["id"], strip=True, ignore_punctuation=True, ignore_numbers=True)
    assert [tuple(r)[:3] for r in kept.collect()] == [(1, "BASIC_LATIN", 1)]


def test_romanize(spark, rows):
    data = [("srp", "Љубав и џез"), ("rus", "Щука"), ("mon", "Өнөр"), ("fin", "Дом"), ("ukr", "Їжак")]
    df = spark.createDataFrame(data, "language string, text string")
    assert rows(rom.romanize(df)) == sorted(
        [("srp-rom", "Ljubav i džez"), ("rus-rom", "Shhuka"), ("mon-rom", "Önör"), ("fin", "Дом"), ("ukr-rom", "Jižak")], key=str
    )
    assert rom.augment_romanized(df).count() == 10


def test_longest_match():
    pieces = frozenset(["un", "##able", "##ab", "a", "##l"])
    assert sw.longest_match("unable", pieces, 4) == ["un", "##able"]
    assert sw.longest_match("al", pieces, 4) == ["a", "##l"]
    assert sw.longest_match("alx", pieces, 4) == [sw.UNK]
    assert sw.longest_match("", pieces, 4) == []


def test_tokenize_corpus(spark):
    vocabulary = spark.createDataFrame([("ab", 3), ("##c", 2), ("!", 1)], "piece string, n long")
    segmenter = sw.Segmenter.from_table(vocabulary)
    df = spark.createDataFrame([(1, "abc! zz"), (2, "")], "id long, text string")
    tokens = sw.tokenize_corpus(df, segmenter, ["id"]).orderBy("id", "position").collect()
    assert [(r.id, r.token, r.word_id, r.word) for r in tokens] == [
        (1, "[CLS]", None, None), (1, "ab", 0, "abc"), (1, "##c", 0, "abc"), (1, "!", 1, "!"), (1, "[UNK]", 2, "zz"),
        (1, "[SEP]", None, None), (2, "[CLS]", None, None), (2, "[SEP]", None, None),
    ]
    ids = {r.token: r.token_id for r in sw.add_token_ids(sw.tokenize_corpus(df, segmenter, ["id"]), vocabulary).collect()}
    assert ids == {"ab": 0, "##c": 1, "!": 2, "[UNK]": -1, "[CLS]": -2, "[SEP]": -3}
    shares = {r.id: r.unk_fraction for r in sw.unk_fraction(df, segmenter, ["id"]).collect()}
    assert shares == {1: 1 / 6, 2: 0.0}


def test_merged_segmentations(spark):
    segmenter = sw.Segmenter.from_table(spark.createDataFrame([("a", 1), ("##a", 1)], "piece string, n long"))
    df = spark.createDataFrame([(1, "aa a aa")], "id long, text string")
    merged = sw.word_segmentations(df, segmenter, ["id"], merge_repeats=True).collect()
    assert {r.word: r.pieces for r in merged} == {"aa": ["a", "##a", "a", "##a"], "a": ["a"]}


def test_token_probabilities_sum_to_one(spark):
    lex = spark.createDataFrame([("x", "aa", 3, ["a", "##a", "##a"]), ("x", "ab", 1, ["a", "##b"])], "language string, word string, n long, pieces array<string>")
    joint = sw.token_word_joint(lex)
    assert {(r.token, r.word): r.n for r in joint.collect()} == {("a", "aa"): 3, ("##a", "aa"): 6, ("a", "ab"): 1, ("##b", "ab"): 1}
    p = sw.conditional_probabilities(joint)
    for column, key in (("token_given_word", "word"), ("word_given_token", "token")):
        for r in p.groupBy(key).agg(F.sum(column).alias("s")).collect():
            assert abs(r.s - 1) < 1e-6
