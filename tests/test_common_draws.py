"""Draws among shared positions: every draw lands, positions are right, all shared positions are reached."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossaria.operators import common_draws

HELD = {"a": {0, 3, 5, 40_000, 70_001}, "b": {3, 5, 6, 40_000, 70_000}, "c": {5}, "d": set(range(0, 100_000, 7))}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(lang, p, f"{lang}{p}") for lang, held in HELD.items() for p in held]
    return spark.createDataFrame(rows, "language string, sentence_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(x, y) for x in "abcd" for y in "abcd" if x != y], "language1 string, language2 string")


def test_shared_bitmaps_count_shared_positions(corpus, pairs):
    got = {}
    for r in common_draws.shared_bitmaps(corpus, pairs).collect():
        found = got.setdefault((r["language1"], r["language2"]), set())
        bits = int.from_bytes(bytes(r["bitmap"]), "little")
        assert r["before"] == len(found) and r["n"] == bits.bit_count()
        assert r["total"] == len(HELD[r["language1"]] & HELD[r["language2"]])
        found |= {r["bucket"] * common_draws.BITMAP + k for k in range(common_draws.BITMAP) if bits >> k & 1}
    assert got == {(x, y): HELD[x] & HELD[y] for x in "abcd" for y in "abcd" if x != y and HELD[x] & HELD[y]}


@pytest.mark.parametrize("run", [1 << 16, 7])
def test_every_draw_lands(corpus, pairs, monkeypatch, run):
    monkeypatch.setattr(common_draws, "DRAWS", run)
    rows = common_draws.drawn_positive_pairs(corpus, pairs, 50).collect()
    assert Counter((r["language1"], r["language2"]) for r in rows) == {(x, y): 50 for x in "abcd" for y in "abcd" if x != y and HELD[x] & HELD[y]}
    for r in rows:
        assert r["index1"] == r["index2"] and r["index1"] in HELD[r["language1"]] & HELD[r["language2"]]
        assert (r["sentence1"], r["sentence2"], r["label"]) == (f"{r['language1']}{r['index1']}", f"{r['language2']}{r['index1']}", "yes")
    assert {r["index1"] for r in rows if (r["language1"], r["language2"]) == ("a", "b")} == {3, 5, 40_000}
    assert len({r["index1"] for r in rows if r["language1"] == "d" and r["language2"] == "a"}) == len(HELD["d"] & HELD["a"])


def test_negative_draws_are_two_positions(corpus, pairs):
    rows = common_draws.drawn_negative_pairs(corpus, pairs, 40).collect()
    expected = {(x, y): 40 for x in "abcd" for y in "abcd" if x != y and len(HELD[x] & HELD[y]) > 1}
    assert Counter((r["language1"], r["language2"]) for r in rows) == expected
    for r in rows:
        assert r["index1"] < r["index2"] and {r["index1"], r["index2"]} <= HELD[r["language1"]] & HELD[r["language2"]]
        assert (r["sentence1"], r["sentence2"]) == (f"{r['language1']}{r['index1']}", f"{r['language2']}{r['index2']}")
    assert {(r["index1"], r["index2"]) for r in rows if (r["language1"], r["language2"]) == ("a", "b")} == {(3, 5), (3, 40_000), (5, 40_000)}


def test_no_draws(corpus, pairs):
    assert common_draws.drawn_positive_pairs(corpus, pairs, 0).count() == 0
    assert common_draws.drawn_negative_pairs(corpus.where(F.col("language") == "a"), pairs, 5).count() == 0
