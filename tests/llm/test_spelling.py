"""Spelling variants against brute force, and the rows of the query against SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from oracle_check import compare, connect

from conftest import SF
from glossaria.llm import queries, spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def distance_one(a, b):
    """Textbook edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
    return row[-1] == 1


def plain(docs, least=7, minimum=2, every=31, ratio=10):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= minimum}
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if abs(len(a) - len(b)) <= 1 and distance_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(rows)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_the_sql_gives_the_same_rows(spark):
    found = queries.QUERIES["op12_spelling_variants"](spark, SF).toPandas().astype({"form_n": "Int64"})
    assert compare(found, connect(SF).execute(queries.ORACLES["op12_spelling_variants"]).df()) == ""
    assert found["form"].notna().sum() > 0


def test_one_edit_equals_the_edit_distance():
    draw = random.Random(1)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randrange(1, 6))) for _ in range(250)})
    rows = [spelling.letters_of([w]) for w in words]
    for i, j in combinations(range(len(words)), 2):
        if len(words[i]) > len(words[j]):
            i, j = j, i
        if len(words[j]) - len(words[i]) <= 1:
            assert spelling.one_edit(rows[i][None], rows[j][None])[0] == distance_one(words[i], words[j])


def test_gram_matrix_gives_squared_distances():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcéÿ") for _ in range(draw.randrange(1, 9))) for _ in range(120)]
    vectors = spelling.letter_counts(words)
    half = spelling.half_norms(vectors)
    found = set(zip(*(x.tolist() for x in spelling.close_counts(vectors, vectors, half, half))))
    letters = [Counter(w) for w in words]
    expected = {
        (x, y) for x in range(120) for y in range(120)
        if sum((letters[x][c] - letters[y][c]) ** 2 for c in letters[x] | letters[y]) <= 2
    }
    assert found == expected


@pytest.mark.parametrize("fine_rows", [0, 3, 12, 10**6])
def test_runs_find_all_near_pairs(monkeypatch, fine_rows):
    monkeypatch.setattr(spelling, "FINE_ROWS", fine_rows)
    monkeypatch.setattr(spelling, "CHECKED", 50)
    draw = random.Random(5)
    make = lambda n, size: sorted({"".join(draw.choice("eanzé") for _ in range(size)) for _ in range(n)})
    words, same, longer = make(200, 7), make(200, 7), make(200, 8)
    for others in (None, same, longer):
        i, j = spelling.near_pairs(words, others)
        found = list(zip(i.tolist(), j.tolist()))
        pairs = combinations(range(len(words)), 2) if others is None else ((x, y) for x in range(len(words)) for y in range(len(others)))
        expected = {(x, y) for x, y in pairs if distance_one(words[x], (others or words)[y])}
        if others is None:
            found = [(min(p), max(p)) for p in found]
        assert len(found) == len(set(found)) and set(found) == expected and expected
    assert [len(x) for x in spelling.near_pairs([], None)] == [0, 0]


def test_steps_reach_every_edit():
    def key(w):
        return (len(w), *(sum(w.count(c) for c in group) for group in spelling.CLASSES))

    letters = [g[0] for g in spelling.CLASSES] + ["z", "é"]
    base, reach = "".join(letters) + "z", set(spelling.STEPS)
    edits = [base[:i] + c + base[i + k :] for i in range(len(base)) for c in [*letters, ""] for k in (0, 1)]
    for w in edits:
        change = tuple(x - y for x, y in zip(key(w), key(base)))
        assert (change in reach) + (tuple(-x for x in change) in reach) == (2 if not any(change) else 1)


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(6)
    base = ["".join(draw.choice("aeoisunrdtlcéxz") for _ in range(draw.randrange(6, 12))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = base[min(int(draw.expovariate(0.1)), 59)]
            if draw.random() < 0.1:
                at, c = draw.randrange(len(w)), draw.choice("abcéÿz")
                w = draw.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i, draw.choice([" ", "1", "\n", "œ", "-"]).join(words)))
    rows += [rows[0], rows[0], (None, rows[1][1]), (900, None), (901, ""), (902, "x" * 5000 + " " + "x" * 5001), (903, "x" * 5000 + " " + "x" * 5001)]
    return rows


@pytest.mark.parametrize("block_words", [40, 2048])
def test_variants_equal_brute_force_for_every_block_size(spark, docs, block_words):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS n", "'x' AS word", "2 AS key", "3 AS near")
    expected = plain(docs)
    assert result(spelling.variants(df.repartition(5), block_words=block_words)) == expected
    assert sum(r[1] is not None for r in expected) > 30


def test_chains_are_followed_to_the_end(spark):
    counts = {"kitchen": 4000, "kitchens": 400, "kitchense": 40, "kitchenses": 4, "kitten": 9, "another": 3}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = {r["word"]: r for r in spelling.variants(df, every=10**9).collect()}
    assert {w: r["root"] for w, r in found.items()} == {
        "kitchen": "kitchen", "kitchens": "kitchen", "kitchense": "kitchen", "kitchenses": "kitchen", "another": "another"
    }
    assert found["kitchense"]["form"] == "kitchens" and found["kitchense"]["n_near"] == 2


def test_the_counts_of_a_task_may_be_sent_in_parts(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    whole = sorted(map(tuple, spelling.word_counts(df).collect()))
    assert sorted(map(tuple, spelling.word_counts(df, held_words=5).collect())) == whole


def test_empty_table_and_long_words(spark):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert spelling.variants(df).count() == 0
    assert spelling.variants(df.limit(0)).count() == 0
    vectors = spelling.letter_counts(["a" * 9000, "a" * 9001])
    half = spelling.half_norms(vectors)
    assert vectors.dtype == np.float64 and len(spelling.close_counts(vectors[:1], vectors[1:], half[:1], half[1:])[0]) == 1
