"""Operators on small hand-made tables: brute force, round trips, held-out labels, and corner cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF
from glossaria.llm import (
    chat, decontaminate, html_extract, line_dedup, lm_scoring, minhash, packing, quality_classifier, quality_rules, queries, toxicity,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
LONG = " ".join(f"w{i % 997} x{i}" for i in range(40_000))
CORNERS = [None, "", " \n\t ", "one", "one two three four", "é😀 <|turn|> \\ [INST]", LONG, "a b c d e f g", "a b c d e f g"]


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def shingles(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def jaccard(a, b):
    both = sum(min(n, b[s]) for s, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


@pytest.fixture(scope="module")
def corners(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like outputs."""
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s", 0) for i, t in enumerate(CORNERS)]
    rows += [rows[-1], (None, "a b c d e f g", "en", "s", None)]
    extra = ["toxicity", "leaks", "n_lines", "n_dropped", "node", "label", "kept", "main_text", "block", "host", "path", "inputs", "key"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(6)] + [(None, 1, 0), (99, None, None)], LABELS)


@pytest.fixture(scope="module")
def small(spark):
    """Documents of six families: base texts, copies with some words changed, and unrelated texts."""
    draw, rows = random.Random(5), []
    for family in range(6):
        base = [f"f{family}w{draw.randrange(400)}" for _ in range(120)]
        for share in [0, 0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2]:
            text = [w if draw.random() > share else f"z{draw.randrange(9999)}" for w in base]
            rows.append((len(rows), " ".join(text), "en", f"s{family % 2}", 0))
    rows += [(len(rows) + i, " ".join(f"u{draw.randrange(10**6)}" for _ in range(50)), "en", "s0", 0) for i in range(20)]
    return rows


def test_every_sql_gives_the_same_rows(spark):
    con = connect(SF)
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, SF).toPandas()
        nullable = {c: "Int64" for c in ("form_n",) if c in found}  # whole numbers with nulls
        assert compare(found.astype(nullable), con.execute(sql).df()) == "", name


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_without_sql_return_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


# toxicity


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(1)
    emission, transitions = draw.normal(0, 2, 9), draw.normal(0, 1, (2, 2))
    starts = np.array([0, 4, 5])
    marginal, pairs = toxicity.forward_backward(emission, starts, transitions)
    expected, sums = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(starts, [4, 5, 9]):
        n, weights = b - a, []
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            weights.append((np.exp(sum(emission[a + i] for i in range(n) if y[i]) + sum(transitions[p, q] for p, q in zip(y, y[1:]))), y))
        total = sum(w for w, _ in weights)
        for w, y in weights:
            expected[a:b] += np.array(y) * w / total
            for p, q in zip(y, y[1:]):
                sums[p, q] += w / total
    assert np.allclose(marginal, expected) and np.allclose(pairs, sums)


def test_toxicity_on_held_out_rows_and_spans(spark):
    draw, rows = random.Random(2), []
    for i in range(400):
        text = [draw.choice("the of and to in a is that for it".split()) + draw.choice("xyz") for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                text[draw.randrange(60)] = "vile" + draw.choice(["ness", "ly", "st", "", "r"])
        rows.append((i, " ".join(text), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400) if i % 3], LABELS)
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    for i in range(0, 400, 3):
        assert (got[i]["toxicity"] >= 0.3) == (i % 4 == 0)
        spans = {rows[i][1][s["start"] : s["end"]] for s in got[i]["toxic_spans"]}
        assert all("vile" in s for s in spans) and bool(spans) == (i % 4 == 0)


def test_toxicity_is_fitted_on_all_rows():
    draw, texts = random.Random(14), []
    for i in range(1400):
        text = [draw.choice("the of and to in a is that for it".split()) + draw.choice("xyz") for _ in range(12)]
        if i < 700:
            text[draw.randrange(12)] = "vile" if i < 600 else "grim"  # late rows have a word of their own
        texts.append(" ".join(text))
    model = toxicity.fit_rows(texts, [int(i < 700) for i in range(1400)], 0.5)
    for word in ("vile", "grim"):
        text = f"thex ofy {word} toz"
        spans = toxicity.scorer(model)([text])[1].to_pylist()[0]
        assert [text[s["start"] : s["end"]] for s in spans] == [word]


def test_toxicity_corners(spark, corners, labels):
    model = toxicity.fit(corners, labels)
    got = toxicity.score(corners, model).collect()
    assert len(got) == corners.count() and all(0 <= r["toxicity"] <= 1 for r in got)
    assert len({r["toxicity"] for r in got if not words(r["text"])}) == 1
    none = toxicity.fit(corners, labels.limit(0))
    assert {r["toxicity"] < 0.01 for r in toxicity.score(corners, none).collect()} == {True}
    assert toxicity.score(corners.limit(0), model).count() == 0


# quality rules


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = list(zip(w, w[1:], w[2:]))
    often, covered, seen, dup = Counter(three), set(), set(), 0
    for i, g in enumerate(three):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_equal_brute_force(spark, corners):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab c\n\t#|") for _ in range(draw.randrange(80))) for _ in range(300)] + [LONG + " " + LONG]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    for frame in (docs, corners):
        for r in quality_rules.signals(frame, keep=("doc_id", "text")).collect():
            own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            assert own == base_counts(r["text"])


def test_binomial_bound_equals_the_sum(spark):
    from math import comb

    cases = [(0, 10), (1, 30), (3, 200), (0, 500), (4, 1000), (10, 100)]
    frame = spark.createDataFrame(cases, "k bigint, n bigint").withColumn("p", quality_rules.binomial_at_most(F.col("k"), F.col("n"), 0.02))
    for r in frame.collect():
        exact = sum(comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == (1.0 if r["k"] >= 0.02 * r["n"] else pytest.approx(exact))


def test_quality_rules_keep_good_and_drop_bad(spark):
    draw = random.Random(4)
    good = lambda: " ".join(draw.choice("alpha beta gamma delta eps") + str(draw.randrange(10**6)) for _ in range(80))
    rows = [(i, good() if i % 5 else re.sub(" ", " ### ", good()), "en", "s", 0) for i in range(2500)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(2500)], LABELS)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, marks).collect()}
    assert not any(got[i]["kept"] for i in range(0, 2500, 5)) and not any(r["base_failed"] for r in got.values())
    assert sum(not got[i]["kept"] for i in range(2500) if i % 5) <= 0.02 * 2000
    unlabelled = quality_rules.judge(docs, marks.limit(0)).collect()
    assert all(r["kept"] and r["level"] is None for r in unlabelled)


def test_quality_corners(corners, labels):
    got = quality_rules.judge(corners, labels).collect()
    assert len(got) == corners.count() and all(r["base_failed"] == (r["n_words"] < 50) for r in got)
    assert quality_rules.judge(corners.limit(0), labels).count() == 0
    scored = quality_classifier.classify(corners, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(scored) == corners.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_classifier.classify(corners.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_are_shrunk_to_the_prior(spark):
    draw, rows = random.Random(6), []
    for host, n, bad in (("big_good", 300, 0.02), ("big_bad", 300, 0.9), ("tiny", 2, 1.0)):
        for _ in range(n):
            text = " ".join(f"w{draw.randrange(10**5)}" for _ in range(60))
            rows.append((len(rows), re.sub(" ", " %%% ", text) if draw.random() < bad else text, "en", host, 0))
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, int("%" not in r[1]), 0) for i, r in enumerate(rows) if i % 2], LABELS)
    got = quality_classifier.classify(docs, marks, F.col("source"), F.col("source")).collect()
    assert all(r["kept"] == ("%" not in rows[r["doc_id"]][1]) for r in got)
    host = {r["host"]: r["host_posterior"] for r in got}
    assert host["big_bad"] < 0.25 < host["tiny"] < 0.75 < host["big_good"]


# decontamination


def test_decontamination_equals_brute_force(spark, corners):
    draw = random.Random(7)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [" ".join(draw.choice(vocabulary) for _ in range(draw.choice([3, 12, 30, 60]))) for _ in range(12)] + ["", None]
    texts = []
    for i in range(60):
        text = [draw.choice(vocabulary) for _ in range(80)]
        inside = (items[i % 12]).split()
        if i % 3 == 1:
            inside[draw.randrange(len(inside))] = "changed"
        if i % 3 == 2:
            inside.insert(len(inside) // 2, "added")
        at = draw.randrange(80)
        texts.append(" ".join(text[:at] + inside + text[at:]) if i < 50 else " ".join(text))
    expected = set()
    for d, text in enumerate(texts):
        w = words(text)
        for k, item in enumerate(items):
            own = words(item)
            best = max((jaccard(shingles(w[i : i + len(own)]), shingles(own)) for i in range(len(w) - len(own) + 1)), default=0) if own else 0
            if best >= 0.8:
                expected.add((d, k, round(best, 9)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontaminate.search(docs, bench).select("doc_id", "text", F.inline("leaks")).collect()
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got} == expected and len(got) == len(expected)
    for r in got:
        if r["similarity"] == 1:
            assert words(r["text"][r["start"] : r["end"]]) == words(items[r["item_id"]])
    found = decontaminate.search(corners, spark.createDataFrame([(1, "A b, c d e f")], "item_id int, text string")).collect()
    assert sum(bool(r["leaks"]) for r in found) == 4 and len(found) == corners.count()
    assert decontaminate.search(corners, bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontaminate.search(corners.limit(0), bench).count() == 0


def best_windows(texts, items, least=0.8):
    """(text, item, similarity) by comparing every window of an item's length, or the whole text if it is shorter."""
    expected = set()
    for d, text in enumerate(texts):
        w = words(text)
        for k, item in enumerate(items):
            own = words(item)
            n = min(len(own), len(w))
            best = max((jaccard(shingles(w[i : i + n]), shingles(own)) for i in range(len(w) - n + 1)), default=0) if n else 0
            if best >= least:
                expected.add((d, k, round(best, 9)))
    return expected


def found_leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.search(docs, bench).select("doc_id", "text", F.inline("leaks")).collect()
    for r in rows:
        inside = words(r["text"][r["start"] : r["end"]])
        assert round(jaccard(shingles(inside), shingles(words(items[r["item_id"]]))), 9) == round(r["similarity"], 9)
    return {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in rows}


def test_changed_items_equal_brute_force(spark):
    """Changed edges, one word changed, left out or put in inside, cut documents, halves swapped, repeated words."""
    draw = random.Random(13)
    new = lambda: f"c{draw.randrange(10**6)}"
    items = [[f"i{k}w{draw.randrange(400)}" for _ in range(n)] for k, n in enumerate([5, 8, 9, 15, 22, 31, 40, 47, 49, 58, 75, 120])]
    items += [["a", "b"] * 12, ["x"], ["one", "two", "three"], [f"r{i % 5}" for i in range(60)]]
    texts = []
    for item in items:
        n, edge = len(item), (len(item) - 4) // 9
        changed = [list(item)]
        changed += [[new() for _ in range(left)] + item[left : n - edge + left] + [new() for _ in range(edge - left)] for left in range(edge + 1)] if edge > 0 else []
        for at in {n // 7, n // 3, n // 2, 4 * n // 5}:
            changed += [item[:at] + [new()] + item[at + 1 :], item[:at] + item[at + 1 :], item[:at] + [new()] + item[at:], item[at:] + item[:at]]
        for inside in changed:
            around = [[f"o{draw.randrange(10**6)}" for _ in range(draw.choice([3, 40]))] for _ in range(2)]
            texts.append(" ".join(around[0] + inside + around[1]))
        texts += [" ".join(item[cut:]) for cut in range(1, n // 4)] + [" ".join(item[: n - cut]) for cut in range(1, n // 4)]
    texts += ["", " . ", "x x x", "a b a b a b a b a b a b a b a b", " ".join(new() for _ in range(500))]
    joined = [" ".join(i) for i in items]
    expected = best_windows(texts, joined)
    found = found_leaks(spark, texts, joined)
    assert found <= expected and len(expected) > 150
    assert len(found) == len(expected), sorted(expected - found)


def test_nothing_is_found_without_the_blocks(spark, monkeypatch):
    items = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(5)]
    texts = [f"before {item} after" for item in items]
    assert len(found_leaks(spark, texts, items)) == 5
    whole = decontaminate.index_of
    monkeypatch.setattr(decontaminate, "index_of", lambda *a: whole(*a).where("block < 0"))
    assert found_leaks(spark, texts, items) == set()


def test_items_of_one_opening_and_copies_of_items(spark):
    opening = [f"o{i}" for i in range(12)]
    items = [" ".join(opening + [f"k{k}w{i}" for i in range(10)]) for k in range(40)] + ["same words in this item here"] * 3
    texts = [" ".join(opening), "x " + items[7] + " y", items[40].upper(), None]
    assert found_leaks(spark, texts, items) == {(1, 7, 1.0), (2, 40, 1.0), (2, 41, 1.0), (2, 42, 1.0)}


def test_parts_lie_inside_of_their_items():
    for n in range(0, 400):
        parts = decontaminate.parts_of(n)
        assert bool(parts) == (n > 0)
        ends = 0
        for first, length in parts:
            assert first >= ends and length >= 1
            ends = first + length
        assert ends <= n


def test_window_fingerprints_equal_counting_bits():
    draw = np.random.default_rng(3)
    words = draw.integers(0, 2**63, 700, np.uint64)
    for length in (1, 2, 3, 8, 64, 300, 700):
        run = min(decontaminate.RUN, length)
        runs = [int(x) for x in decontaminate.features(words, run)]
        n = length - run + 1
        for i in (0, 1, (701 - length) // 2, 700 - length):
            if i <= 700 - length:
                expected = sum((2 * sum(x >> b & 1 for x in runs[i : i + n]) > n) << b for b in range(64))
                assert int(decontaminate.window_fingerprints(words, length)[i]) == expected


def test_blocks_list_every_fingerprint_within_the_radius():
    draw, mask = random.Random(8), (1 << decontaminate.BLOCK_BITS) - 1
    flips = set(decontaminate.FLIPPED.tolist())
    for _ in range(300):
        apart = sum(1 << bit for bit in draw.sample(range(64), decontaminate.RADIUS))
        assert any((apart >> b * decontaminate.BLOCK_BITS) & mask in flips for b in range(decontaminate.BLOCKS))


# near-duplicates


def components_of(rows):
    sets, parent = [shingles(words(t)) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_classes_equal_brute_force(spark, small, monkeypatch):
    docs = spark.createDataFrame(small, DOCS)
    expected = components_of(small)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert got == expected
    monkeypatch.setattr(minhash, "BLOCK", 2)  # several blocks per bucket
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()} == expected
    kept = minhash.representatives(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values())) and kept.columns == docs.columns


def test_copies_edited_independently_are_one_class(spark):
    draw = random.Random(11)
    base = [f"s{i}" for i in range(120)]
    texts = [base]
    for c in range(1000):
        copy = list(base)
        for at in draw.sample(range(120), 2):
            copy[at] = f"e{c}x{at}"
        texts.append(copy)
    draw.shuffle(texts)
    assert all(jaccard(shingles(base), shingles(t)) >= 0.8 for t in texts)  # so brute force has one class
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert {r["class_id"] for r in minhash.classes(docs).collect()} == {0}


def test_nodes_outside_of_a_large_component_meet_its_nodes(spark, monkeypatch):
    draw, rows = random.Random(12), []
    for family in range(3):
        base = [f"f{family}s{i}" for i in range(120)]
        for c in range(60):
            copy = list(base)
            for at in draw.sample(range(120), 2 + c % 3):
                copy[at] = f"e{family}y{c}x{at}"
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    docs, expected = spark.createDataFrame(rows, DOCS), components_of(rows)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    for rounds in (1, 2):
        monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
        assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()} == expected


def test_signatures_agree_with_the_similarity():
    draw = random.Random(9)
    a = [f"w{draw.randrange(50)}" for _ in range(400)]
    b = a[:330] + [f"q{i}" for i in range(70)]
    from glossaria.llm.common import WordHashes, hash_words, shingle_hashes

    w, counts = hash_words([" ".join(a), " ".join(b)], minhash.WORD, WordHashes())
    s, present = minhash.signatures(*shingle_hashes(w, counts, 5)[:2], 2)
    assert present.all() and abs((s[0] == s[1]).mean() - jaccard(shingles(a), shingles(b))) < 0.16


def test_minhash_corners(spark, corners):
    got = minhash.classes(corners).collect()
    assert len(got) == corners.count()
    by_id = {r["doc_id"]: r["class_id"] for r in got}
    assert by_id == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, None: 7}
    assert sorted(r["doc_id"] for r in minhash.representatives(corners).collect()) == [0, 2, 3, 4, 5, 6, 7]
    assert minhash.classes(corners.limit(0)).count() == 0 and minhash.representatives(corners.limit(0)).count() == 0


# HTML


def test_extraction():
    extract = html_extract.extractor()
    page = (
        "<html><head><title>no</title><style>p{}</style><script>var t='</p>'</script></head><body><nav><a href=/>menu</a></nav>"
        "<div class='cookie-notice'>we use cookies</div><article><h1>Head &amp; tail</h1><p>First\n <b>bo</b>ld&nbsp;text.<br>next"
        "<p>a &lt; b<!-- <p>gone</p> --></p><form><input>your name</form><section id=comments><p>nice one, friend of mine</p></section>"
        "</article><aside>see also</aside><footer>&copy; us</footer></body></html>"
    )
    assert extract([page])[0].to_pylist() == ["Head & tail First bold text. next a < b"]
    assert extract(["", "<p>cut <a href='x", "<script>x"])[0].to_pylist() == ["", "cut", ""]


def test_extraction_keeps_articles_whole():
    extract = html_extract.extractor()
    body = "<h1>A town</h1><p>the river rose through the night and people near the water left their houses</p>"
    want = "A town the river rose through the night and people near the water left their houses"
    pages = {
        "<article><p>one <svg class=i /> two</p><p>three</p></article>": "one two three",
        "<article><p>one <svg class='a>b' d=\"/>\"><title>no</title></svg> two</p></article>": "one two",
        "<article><p>one <math/> two <svg><path /></svg>three</p></article>": "one two three",
        "<article><video-card><p>one</p></video-card><object-x>two</object-x></article>": "one two",
        f"<body class='single comment-open'><article>{body}</article></body>": want,
        f"<body class=home><article class='review comments-on'>{body}</article></body>": want,
        f"<div class=feedback><article>{body}</article></div>": want,
        f"<div class=review><p>{body}</p></div>": want,
    }
    for page, text in pages.items():
        assert extract([page])[0].to_pylist() == [text], page
    assert extract([f"<article>{body}<section class=comments><article class=comment><p>nice one</p></article></section></article>"])[0].to_pylist() == [want]


def test_extraction_corners(spark, corners):
    pages = corners.withColumnRenamed("text", "html")
    got = html_extract.extract(pages).collect()
    assert len(got) == pages.count() and got[0]["main_text"] == "" and max(len(r["main_text"]) for r in got) == len(LONG)
    assert html_extract.extract(pages.limit(0)).count() == 0


# packing


def test_packing_keeps_every_token_once(spark, corners):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = corners.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(50, "a<|endoftext|>b  c", "x")], "doc_id long, text string, lang string"))
    got = packing.pack(docs, path, max_tokens=64, group_tokens=5000).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], bytes(r["tokens"]), r["doc_tokens"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(set(by_doc[doc_id]))
        assert b"".join(p[2] for p in pieces) == ids.tobytes() and {p[3] for p in pieces} == {len(ids)}
        assert [p[0] for p in pieces] == list(np.cumsum([0] + [p[1] for p in pieces])[:-1])
    for parts in by_sequence.values():
        ends = [0] + [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    assert packing.pack(docs.limit(0), path).count() == 0


def test_long_runs_of_white_space_are_tokenized():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, tokens = Tokenizer.from_file(path), packing.TokenBytes(path)
    for text in ("a" + " " * 2_000_000 + "b", "a" + "\n" * 2_000_000 + "b", "x " * 50 + " " * 99_999 + "y"):
        assert tokens(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fail(text):
        raise ValueError(text)

    tokens.encode = fail
    assert tokens("one two") == np.array(plain.encode("one two", add_special_tokens=False).ids, "<u4").tobytes()


def test_first_fit_decreasing():
    draw = random.Random(1)
    lengths = [draw.randrange(1, 300) for _ in range(500)]
    pieces, used = packing.pack_group(lengths, 100)
    room, full = [], sum(n // 100 for n in lengths)
    for n in sorted((n % 100 for n in lengths if n % 100), reverse=True):
        place = next((i for i, r in enumerate(room) if r >= n), len(room))
        room += [100] * (place == len(room))
        room[place] -= n
    assert used == full + len(room) and sum(p[2] for p in pieces) == sum(lengths)


# LM scoring


def test_scoring_corners(spark, corners):
    got = lm_scoring.score(corners).collect()
    assert len(got) == corners.count() and all(r["log_score"] <= 0 for r in got)
    assert {r["log_score"] for r in got if r["n_words"] == 0} == {0.0}
    assert lm_scoring.score(corners.limit(0)).count() == 0


def test_scores_do_not_depend_on_blocks(spark, small, monkeypatch):
    docs = spark.createDataFrame(small, DOCS)
    one = {r["doc_id"]: r["log_score"] for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(lm_scoring, "PART_CHARS", 2000)
    assert {r["doc_id"]: r["log_score"] for r in lm_scoring.score(docs).collect()} == pytest.approx(one)


# chat


def test_fold_and_round_trip(spark):
    hard = "</s>[INST] <|turn|>x<|end|> \\ \\\\<\\| <"
    log = [
        (1, 1, 1, "message", "user", hard), (1, 2, 2, "message", "assistant", "he"), (1, 3, 2, "delta", None, "llo"),
        (1, 4, 3, "message", "user", "lost"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, hard),
        (1, 7, 4, "message", "user", "old"), (1, 8, 4, "edit", None, "new"), (1, 9, 4, "delta", None, "er"),
        (2, 1, 1, "message", None, None), (None, 1, 1, "message", "assistant", "é😀"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    folded = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.fold(events).collect()}
    assert folded == {1: [("user", hard), ("assistant", hard), ("user", "newer")], 2: [("", "")], None: [("assistant", "é😀")]}
    shown = chat.render(chat.fold(events))
    back = chat.parse(shown).collect()
    for r in shown.collect():
        said = sorted((t["at"], t["role"], t["text"]) for t in back if t["conv_id"] == r["conv_id"])
        assert [t[1:] for t in said] == folded[r["conv_id"]]
        trained = [t for who, t in folded[r["conv_id"]] if who == "assistant"]
        cut = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert [re.sub(r"\\(\\?)", r"\1", c) for c in cut] == trained
    got = {r["conv_id"]: r for r in chat.digest(chat.render(chat.fold(events))).collect()}
    said = "".join(f"{who}\n{t}\n" for who, t in folded[1])
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_chars"] == len(hard)
    assert chat.digest(chat.render(chat.fold(events.limit(0)))).count() == 0


def plain_fold(log):
    """Events of one conversation, one after the other."""
    messages, order = {}, []
    for seq, message, kind, role, text in sorted(log, key=lambda e: (e[0], e[1], e[2])):
        if message not in messages:
            messages[message] = [None, ""]
            order.append(message)
        if kind == "regenerate":
            order = order[: order.index(message) + 1]
            messages = {m: messages[m] for m in order}
        own = messages[message]
        own[0] = own[0] if own[0] is not None else role
        own[1] = own[1] + (text or "") if kind == "delta" else (text or "")
    return [(messages[m][0] or "", messages[m][1]) for m in order]


def test_chat_random_logs_equal_a_plain_fold(spark):
    draw, logs = random.Random(9), {}
    for conv in range(60):
        log, live, begun = [], [], 0
        for seq in sorted(draw.sample(range(200), draw.randrange(1, 40))):
            if not live or draw.random() < 0.3:
                message, begun, kind = begun, begun + 1, draw.choice(["message", "delta", "edit", "regenerate"])
                live.append(message)
            else:  # a discarded message gets no more events
                message, kind = draw.choice(live), draw.choice(["delta", "delta", "delta", "edit", "regenerate"])
                if kind == "regenerate":
                    live = live[: live.index(message) + 1]
            log.append((seq, message, kind, draw.choice(["user", "assistant", None]), draw.choice(["a", "[b]", "<|end|>", "\\", None, ""])))
        logs[conv] = log
    rows = [(c, *e) for c, log in logs.items() for e in log]
    draw.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")
    folded = chat.fold(events)
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in folded.collect()}
    assert got == {c: plain_fold(log) for c, log in logs.items()}
    for r in chat.digest(chat.render(folded)).collect():
        said = "".join(f"{who}\n{t}\n" for who, t in got[r["conv_id"]])
        trained = "".join(t for who, t in got[r["conv_id"]] if who == "assistant")
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["n_turns"] == len(got[r["conv_id"]])
        assert r["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest() and r["loss_chars"] == len(trained)


def test_chat_long_logs_take_linear_time(spark):
    events = spark.range(1, 80_000).selectExpr(
        "1L AS conv_id", "id AS seq", "id % 7 AS message", "if(id < 8, 'message', 'delta') AS kind", "'assistant' AS role", "'x' AS text"
    )
    began = time.time()
    got = chat.digest(chat.render(chat.fold(events))).first()
    assert got["loss_chars"] == 79_999 and time.time() - began < 25


def test_chat_repeated_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("x"))
    got = chat.fold(chat.from_turns(turns)).first()
    assert [tuple(t) for t in got["turns"]] == [("assistant", ""), ("user", "a"), ("user", "a")]


# line dedup


def test_line_dedup_ratio(spark, corners):
    rows = [(i, f"Menu \nline {i}\n" + ("rare" if i < 4 else "x"), "en", "big", 0) for i in range(40)]
    rows += [(100 + i, "Menu\nown " + str(i), "en", None, 0) for i in range(3)] + [(200 + i, "same page\nMenu", "en", "copies", 0) for i in range(50)]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0]["text"] == "line 0" and got[9]["text"] == "line 9" and got[9]["n_dropped"] == 2
    assert got[100]["text"] == "own 0" and got[200]["text"] == "same page\nMenu" and len(got) == len(rows)
    own = line_dedup.drop_boilerplate(corners).collect()
    assert len(own) == corners.count() and [r["text"] for r in own if r["doc_id"] == 0] == [None]
    assert line_dedup.drop_boilerplate(corners.limit(0)).count() == 0


# pipeline


def test_pipeline_equals_its_stages_in_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = queries.fit_toxicity(spark, SF)
    score = toxicity.scorer(model)
    ids = sorted(rows)
    kept = [i for i, s in zip(ids, score([rows[i]["text"] or "" for i in ids])[0].to_pylist()) if s < corpus_pipeline.REJECTED]
    pages = {}
    for i in kept:
        pages.setdefault(rows[i]["source"], set()).add(rows[i]["text"])
    seen = Counter((s, line) for s, texts in pages.items() for t in texts for line in {x.strip(" ") for x in t.split("\n")} if line)
    drop = {(s, line) for (s, line), n in seen.items() if n > 1 and n > 0.05 * len(pages[s])}
    text = {i: "\n".join(x for x in rows[i]["text"].split("\n") if (rows[i]["source"], x.strip(" ")) not in drop) for i in kept}
    classes = components_of([(i, text[i]) for i in kept])
    kept = sorted(set(classes.values()))
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(w):
        return any(jaccard(shingles(w[i : i + len(b)]), shingles(b)) >= 0.8 for b in items for i in range(len(w) - len(b) + 1) if w[i : i + 1])

    kept = [i for i in kept if not leaks(words(text[i]))]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r["doc_id"] for r in got}) == kept
    for r in got:
        ids = np.array(plain.encode(text[r["doc_id"]], add_special_tokens=False).ids + [0], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_stages_accept_corners(spark, corners):
    docs = corners.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
