"""Hand-worked cases, invariants and brute force for the table operators."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaria.operators import combine, distance, evaluate, ids, lid, ngrams, pairs, recode, retrieval
from glossaria.operators import morphology as mo
from glossaria.sources import names

CORPUS = "language string, sentence_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    data = [(lang, i, f"{lang} text {i % 3} {i}") for lang, n in (("a", 7), ("b", 5), ("c", 6)) for i in range(n)]
    return spark.createDataFrame(data, CORPUS)


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_dense_positions_any_bucket(spark, bucket_rows):
    data = [(lang, k) for k in (0, 1, 5, 9, 10, 40) for lang in ("x", "y", None)] + [("x", 7)]
    got = ids.dense_positions(spark.createDataFrame(data, "language string, k long"), ["language"], "k", bucket_rows=bucket_rows)
    found = sorted(((r.language or "", r.k, r.sentence_id) for r in got.collect()))
    expected = []
    for lang in ("x", "y", None):
        keys = sorted(k for la, k in data if la == lang)
        expected += [(lang or "", k, i) for i, k in enumerate(keys)]
    assert found == sorted(expected)


def test_dense_positions_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(ids, "RUN_RANGES", 2)
    keys = [k * k for k in range(40)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = ids.dense_positions(df, [], "k", bucket_rows=3)
    assert sorted((r.k, r.sentence_id) for r in got.collect()) == [(k, i) for i, k in enumerate(keys)]


def test_global_ids_are_dense(corpus):
    got = ids.add_global_sentence_id(corpus).orderBy("language", "sentence_id").collect()
    assert [r.global_sentence_id for r in got] == list(range(18))


def test_strip_script_keeps_last_script(spark, rows):
    df = spark.createDataFrame([("srp_Cyrl", 0, "ц"), ("srp_Latn", 0, "c"), ("fin", 0, "f")], CORPUS)
    assert rows(recode.strip_script(df).select("language", "script", "text")) == [("fin", "", "f"), ("srp", "Latn", "c")]


def test_argmax_takes_first_of_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "scores array<double>")
    assert recode.argmax_prediction(df).first().prediction == 1


def test_label_vocabulary_roundtrip(spark, rows):
    a, b = (spark.createDataFrame([(x,) for x in s], "label string") for s in ("ba", "ca"))
    vocabulary = recode.label_vocabulary(a, b)
    assert rows(vocabulary) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(recode.decode_labels(recode.encode_labels(b, vocabulary).drop("label"), vocabulary).select("label")) == [("a",), ("c",)]


def test_split_by_label_parts_are_whole(corpus):
    parts = combine.split_by_label(corpus, part_rows=2).orderBy("language", "part").collect()
    assert all(len(r.texts) <= 2 for r in parts)
    joined = [t for r in parts if r.language == "a" for t in r.texts]
    assert joined == [f"a text {i % 3} {i}" for i in range(7)]


def test_equal_length(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",)], "language string")
    assert rows(combine.equal_length_languages(df, "a")) == [("a", 2), ("b", 2)]
    assert rows(combine.equal_length_languages(df, "a", drop_target=True)) == [("b", 2)]


def language_pairs(corpus):
    return combine.language_pairs_ordered(corpus)


def test_pairs(corpus):
    built = pairs.sentence_pairs_dataset(corpus, language_pairs(corpus), "b").collect()
    positive = [r for r in built if r.label == "yes"]
    negative = [r for r in built if r.label == "no"]
    assert len(positive) == len(negative) == 6 * 5
    assert all(r.index1 == r.index2 for r in positive)
    assert all(r.index1 < r.index2 < 5 for r in negative)
    by_pair = {}
    for r in negative:
        by_pair.setdefault((r.language1, r.language2), set()).add((r.draw_id, r.index1, r.index2))
    assert len({frozenset(v) for v in by_pair.values()}) == 1


@pytest.mark.parametrize("run", [1, 2, 1000])
def test_all_negative_pairs(corpus, run):
    got = pairs.all_negative_pairs(corpus, language_pairs(corpus), "b", run).where("language1 = 'a' AND language2 = 'c'").collect()
    assert sorted((r.index1, r.index2) for r in got) == list(itertools.combinations(range(5), 2))
    assert sorted(r.draw_id for r in got) == list(range(10))


def test_drawn_positive_pairs(spark, corpus):
    built = pairs.sentence_pairs_dataset(corpus, language_pairs(corpus), "b", n_pos=9, n_neg=4)
    counts = {r.label: r["count"] for r in built.groupBy("label").count().collect()}
    assert counts == {"yes": 9 * 6, "no": 4 * 6}


@pytest.mark.parametrize("bucket_rows, run_ranges", [(1, 8192), (2, 8192), (1000, 8192), (1, 1), (1, 2)])
def test_bigrams_cross_borders(spark, rows, monkeypatch, bucket_rows, run_ranges):
    monkeypatch.setattr(ngrams, "RUN_RANGES", run_ranges)
    data = [("a", 0, ["x", "y"]), ("a", 1, []), ("a", 2, ["z"]), ("b", 0, ["x", "y"])]
    df = spark.createDataFrame(data, "language string, k long, tokens array<string>")
    crossing = ngrams.bigram_counts(df, [], "language", "k", bucket_rows=bucket_rows)
    assert rows(crossing) == [("x y", 2), ("y z", 1), ("z x", 1)]
    assert rows(ngrams.bigram_counts(df, [], "language", "k", cross_border=False)) == [("x y", 2)]


def test_divergence_against_brute_force(spark):
    rng = np.random.default_rng(1)
    cells = {(lang, s, g): int(rng.integers(1, 3)) for lang in "abcd" for s in range(6) for g in "pqrstu" if rng.random() < (0.1 if lang == "d" else 0.6)}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "language string, sentence_id long, ngram string, n long")
    got = {(r.lang1, r.lang2): r.num_disagreements for r in ngrams.divergence_matrix(df).collect()}
    for a, b in itertools.permutations("abcd", 2):
        expected = sum(cells.get((a, s, g), 0) != cells.get((b, s, g), 0) for s in range(6) for g in "pqrstu")
        assert got[a, b] == expected == got[b, a]


def test_divergence_without_common_cells(spark):
    df = spark.createDataFrame([("a", 0, "p", 1), ("b", 0, "q", 1), ("b", 1, "q", 1)], "language string, sentence_id long, ngram string, n long")
    assert {(r.lang1, r.lang2): r.num_disagreements for r in ngrams.divergence_matrix(df).collect()} == {("a", "b"): 3, ("b", "a"): 3}


@pytest.mark.parametrize(
    ("one", "two", "default", "exact"),
    [("a/b", "a/b", 2, 0), ("a/b", "a/b/c", 3, 1), ("a/b/c", "a/b/d", 2, 2), ("a", "b", 2, 2), ("a/b", "c/d", 4, 4), ("a/b/c", "a/x", 3, 3)],
)
def test_tree_distance(spark, one, two, default, exact):
    df = spark.createDataFrame([(1, "x", one), (2, "y", two)], "position long, iso string, classification string")
    assert distance.classification_distance(df).first().distance == default
    assert distance.classification_distance(df, exact=True).first().distance == exact


def test_classification_paths(spark, rows):
    data = [("x", "a", 1), ("nan", "b", 2), ("y", None, 3), ("x", "c", 4)]
    df = spark.createDataFrame(data, "iso string, classification string, position long")
    assert rows(distance.classification_paths(df)) == [("nan", "b", 2), ("x", "c", 1)]


def average_ranks(values):
    v = np.asarray(values)
    return [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    data = []
    for lang, n in (("p", 9), ("q", 7), ("r", 12)):
        for i in range(n):
            v = rng.integers(-2, 3, 4).astype(float) if i else np.zeros(4)
            data.append(("m", lang, i, v.tolist()))
    return data, spark.createDataFrame(data, "model string, language string, sentence_id long, embedding array<float>")


def brute_distances(data, a, b):
    def unit(v):
        v = np.asarray(v)
        n = np.sqrt((v * v).sum())
        return v / n if n else v

    q = np.array([unit(v) for _, la, _, v in data if la == a])
    c = np.array([unit(v) for _, la, _, v in data if la == b])
    return np.round(np.clip(1 - q @ c.T, 0, 2), 9)


@pytest.mark.parametrize("block_rows", [2, None])
def test_nearest_candidates_against_brute_force(vectors, block_rows):
    data, df = vectors
    got = {}
    for r in retrieval.nearest_candidates(df, 3, block_rows).orderBy("position").collect():
        got.setdefault((r.lang1, r.lang2, r.sentence_id), []).append(r.candidate_id)
    assert len(got) == 28 * 3
    for (a, b, i), found in got.items():
        d = brute_distances(data, a, b)[i]
        assert found == sorted(range(len(d)), key=lambda j: (d[j], j))[:3]


@pytest.mark.parametrize("block_rows", [2, None])
def test_retrieval_against_brute_force(vectors, block_rows):
    data, df = vectors
    got = {(r.lang1, r.lang2, r.sentence_id): r["rank"] for r in retrieval.retrieval_ranks(df, block_rows).collect()}
    expected = {}
    for a, b in itertools.product("pqr", repeat=2):
        d = brute_distances(data, a, b)
        for i in range(min(d.shape)):
            expected[a, b, i] = average_ranks(d[i])[i]
    assert got == expected


def test_similarity_summary(vectors):
    data, df = vectors
    summary = retrieval.similarity_search_summary(retrieval.retrieval_ranks(df))
    got = {(r.lang1, r.lang2): (r.avg_rank, r.std_rank, r.mrr) for r in summary.collect()}
    d = brute_distances(data, "p", "r")
    ranks = np.array([average_ranks(d[i])[i] for i in range(9)])
    assert got["p", "r"] == pytest.approx((ranks.mean(), ranks.std(ddof=1), (1 / ranks).mean()), abs=1e-6)


@pytest.mark.parametrize("bins", [4, 4096])
def test_all_ranks_against_brute_force(vectors, bins):
    data, df = vectors
    cells = retrieval.cosine_distances(df, "p", "q", block_rows=3)
    got = {(r.sentence_id, r.candidate_id): r["rank"] for r in retrieval.all_ranks(cells, bins).collect()}
    d = brute_distances(data, "p", "q")
    assert got == {(i, j): average_ranks(d[i])[j] for i in range(9) for j in range(7)}


def test_average_ties(spark):
    df = spark.createDataFrame([("m", "a", "b", 0, j, d) for j, d in enumerate([0.1, 0.5, 0.5, 0.9])], "model string, lang1 string, lang2 string, sentence_id long, candidate_id long, distance double")
    assert [r["rank"] for r in retrieval.all_ranks(df).orderBy("candidate_id").collect()] == [1.0, 2.5, 2.5, 4.0]


@pytest.fixture(scope="module")
def predicted(spark):
    data = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    return spark.createDataFrame(data, "label string, prediction string")


def test_f1(predicted):
    scores = evaluate.per_class_f1(evaluate.confusion_counts(predicted))
    got = {r["class"]: r.f1 for r in scores.collect()}
    assert got == pytest.approx({"a": 10 / 13, "b": 6 / 8, "c": 0.0}, abs=1e-8)
    assert evaluate.macro_f1(scores).first().macro_f1 == pytest.approx(sum(got.values()) / 3, abs=1e-6)
    assert evaluate.micro_f1(scores).first().micro_f1 == pytest.approx(8 / 11, abs=1e-6)
    wanted = {r["class"]: r.f1 for r in evaluate.f1_for_languages(scores, ["b", "z"]).collect()}
    assert wanted == {"b": 0.75, "z": 0.0}


def test_confusion_square_and_expand(predicted):
    counts = evaluate.confusion_counts(predicted)
    square = evaluate.confusion_matrix(counts)
    assert square.count() == 9 and square.agg(F.sum("n")).first()[0] == 11
    assert evaluate.confusion_matrix(counts, drop_empty=True).count() == 6
    wide = evaluate.confusion_display(square, ["a", "b", "c"])
    back = evaluate.expand_confusion(wide).select("label", "prediction")
    assert back.exceptAll(predicted).count() == predicted.exceptAll(back).count() == 0


def test_normalized_confusion_rows_sum_to_one(predicted):
    shares = evaluate.normalize_confusion(evaluate.confusion_counts(predicted), "label")
    assert all(abs(r.s - 1) < 0.02 for r in shares.groupBy("label").agg(F.sum("share").alias("s")).collect())


def test_binary_outcomes(spark):
    data = [("p", x, y) for x, y in [("yes", "yes"), ("yes", "no"), ("no", "yes"), ("no", "no"), ("no", "no")]]
    df = spark.createDataFrame(data, "g string, label string, prediction string")
    r = evaluate.binary_outcomes(df, ["g"]).first()
    assert (r.true_positives, r.false_negatives, r.false_positives, r.true_negatives) == (1, 1, 1, 2)
    assert r.total_correct + r.total_incorrect == 5


def bleu(spark, data):
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(data)], "id long, prediction string, reference string")
    return evaluate.corpus_bleu(evaluate.bleu_statistics(df, "id")).first().bleu


def test_bleu(spark):
    same = "the quick brown fox jumps over it"
    assert bleu(spark, [(same, same)]) == pytest.approx(100.0)
    assert bleu(spark, [("x y z w", "a b c d")]) == 0.0
    # 4 of 4 unigrams, 3 of 3, 2 of 2, 1 of 1, but half the length
    assert bleu(spark, [("a b c d", "a b c d e f g h")]) == pytest.approx(100 * np.exp(1 - 8 / 4), abs=1e-3)
    # orders 3 and 4 have no match: 1 / (2 * 2) and 1 / (4 * 1)
    expected = 100 * np.exp((np.log(3 / 4) + np.log(1 / 3) + np.log(1 / 4) + np.log(1 / 4)) / 4)
    assert bleu(spark, [("a b x d", "a b c d")]) == pytest.approx(expected, abs=1e-3)


def test_language_names(spark, rows):
    data = [("zho-CN", "Chinese (Simplified)", 1), ("zho-TW", "Mandarin (Taiwan)", 2), ("fin", "Finnish", 3), ("fin-x", "Other (x)", 4)]
    table = spark.createDataFrame(data, "language_code string, language string, position long")
    full = names.language_names(table)
    assert ("zho", "Mandarin") in rows(full) and ("fin", "Finnish") in rows(full) and full.count() == 5
    assert dict(rows(names.language_names(table, overrides=names.NAME_OVERRIDES)))["zho"] == "Chinese"
    codes = spark.createDataFrame([("zho",), ("fi",), ("xx",)], "language string")
    assert rows(names.name_by_prefix(codes, table)) == [("fi", "Finnish"), ("xx", None), ("zho", "Chinese (Simplified)")]
    assert ("xx", "UNKNOWN (xx)") in rows(names.display_name(codes, full))


def test_feature_matrix(spark, rows):
    segments = spark.createDataFrame([("talossa", ["talo", "##ssa"]), ("yö", ["yö"])], "word string, pieces array<string>")
    analyses = spark.createDataFrame([("talossa", "N;IN+ESS"), ("talossa", "N;SG"), ("muu", "N")], "form string, features string")
    triples = mo.word_subword_features(segments, analyses)
    assert rows(mo.subword_feature_matrix(triples).where("subword = 'talo'")) == [("talo", "IN+ESS", 1), ("talo", "N", 1), ("talo", "SG", 1)]
    assert rows(mo.word_feature_matrix(triples)) == [("talossa", "IN+ESS", 2), ("talossa", "N", 2), ("talossa", "SG", 2)]
    assert rows(mo.analyse_word_features(analyses).where("feature = 'N'")) == [("muu", "N", 1), ("talossa", "N", 2)]


def test_language_identification(spark):
    words = {"x": "aa ab ba aab abb", "y": "cc cd dc ccd cdd"}
    data = [(lang, i, " ".join(text.split()[i % 3:])) for lang, text in words.items() for i in range(12)]
    df = spark.createDataFrame(data, "language string, doc_id long, text string")
    for model, frame in (
        (lid.lid_char_bigram_model(df, max_iter=20), df),
        (lid.lid_word_bigram_model(lid.with_word_tokens(df), max_iter=20), lid.with_word_tokens(df)),
    ):
        scored = lid.identify_language(model, frame)
        assert scored.where("prediction <> language").count() == 0
        assert scored.where("confidence <= 0.5").count() == 0
    p = lid.lid_char_bigram_model(df, max_iter=5).predict(df).select(F.explode("probabilities").alias("k", "v"), "language", "doc_id")
    for r in p.groupBy("language", "doc_id").agg(F.sum("v").alias("s")).collect():
        assert abs(r.s - 1) < 1e-6


def test_no_join_on_hot_keys(spark, vectors, corpus):
    """Vectors are not joined on model or language, small tables do not make the texts move by language."""
    ranks = retrieval.retrieval_ranks(vectors[1])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in ranks
    plan = ids.add_global_sentence_id(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_sketches_merge_and_stay_within_their_error(spark):
    df = spark.range(60_000).selectExpr(
        "if(id % 2 = 0, 'x', 'y') AS language", "id % 3 AS corpus", "array(concat('t', id % 20000), concat('u', id % 7)) AS tokens"
    )
    parts = ngrams.term_sketches(df, F.col("tokens"), ["corpus", "language"])
    merged = {r["language"]: r["estimate"] for r in ngrams.merged_sketches(parts, ["language"]).collect()}
    whole = {r["language"]: r["n"] for r in ngrams.unique_tokens(df, F.col("tokens"), ["language"]).groupBy("language").agg(F.count("*").alias("n")).collect()}
    direct = {r["language"]: r["n"] for r in ngrams.term_sketches(df, F.col("tokens"), ["language"]).select("language", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    assert merged.keys() == whole.keys() == {"x", "y"}
    for language, n in whole.items():
        assert abs(merged[language] / n - 1) < 0.05 and abs(direct[language] / n - 1) < 0.05


def test_co_located_partitions_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id", "repeat('x', 100) AS text")
    monkeypatch.setattr(ids, "CO_LOCATED_BYTES", 1 << 9)
    assert ids.co_locate(df, "id").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
