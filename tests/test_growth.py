"""What may not grow faster than the input: partitions, shuffled rows, batches of workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossaria.functions.text import explode_terms, ngram_range, word_tokens
from glossaria.operators import ids, ngrams, retrieval, scripts, subwords
from glossaria.plans import ngram_queries, subword_queries

from conftest import SF


def test_co_located_partitions_of_a_join_follow_its_tables(spark, monkeypatch):
    """A join's estimated size is the product of its sides, and rows from a list have no size at all."""
    monkeypatch.setattr(ids, "CO_LOCATED_BYTES", 1 << 14)
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = (spark.range(5000).selectExpr("id", f"id AS {c}") for c in "ab")
    listed = spark.createDataFrame([(1, "x")], "id long, text string")
    for df in (a.join(b, "id"), listed):
        assert ids.co_locate(df, "id").rdd.getNumPartitions() == session
    assert ids.co_locate(spark.range(100_000), "id").rdd.getNumPartitions() == 800_000 >> 14


def test_sentences_are_segmented_in_slices_of_bounded_size():
    words = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"], ["d"] * 4], pa.list_(pa.string()))
    slices = list(subwords.word_slices(words, 5))
    assert [s.to_pylist() for s in slices] == [[["a"] * 3, None, []], [["b"] * 9], [["c"], ["d"] * 4]]


def test_pieces_of_null_empty_and_sliced_sentences(spark, monkeypatch, rows):
    vocabulary = spark.createDataFrame([("ab",), ("##c",), ("d",)], "piece string")
    segmenter = subwords.Segmenter.from_table(vocabulary)
    df = spark.createDataFrame([(1, ["ab", "abc"]), (2, None), (3, []), (4, ["d", "x", "abc"])], "id int, words array<string>").coalesce(1)
    monkeypatch.setattr(subwords, "SENTENCE_WORDS", 2)
    monkeypatch.setattr(subwords, "KNOWN_WORDS", 1)
    found = rows(df.select("id", segmenter.sentence_pieces(F.col("words"))))
    assert found == [(1, [["ab"], ["ab", "##c"]]), (2, None), (3, []), (4, [["d"], ["[UNK]"], ["ab", "##c"]])]


def test_merged_segmentations_are_not_collected(spark, rows):
    """A repeated key's rows are merged; nothing but texts is shuffled for it."""
    segmenter = subwords.Segmenter.from_table(spark.createDataFrame([("a",), ("##a",), ("b",)], "piece string"))
    df = spark.createDataFrame([(1, "aa b aa"), (1, "b"), (None, "b c")], "id long, text string")
    merged = subwords.word_segmentations(df, segmenter, ["id"], merge_repeats=True)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert rows(merged) == [(1, "aa", ["a", "##a"] * 2), (1, "b", ["b", "b"]), (None, "b", ["b"]), (None, "c", ["[UNK]"])]
    assert "collect_list" not in plan and plan.count("Exchange") == 1


def test_index_and_posting_lists_shuffle_texts_alone(spark, rows):
    df = spark.createDataFrame([(1, "x", "a b a"), (5, "x", "a"), (5, "x", "a"), (None, "x", "b")], "id long, language string, text string")
    for size, exchanged in ((None, 2), (4, 1)):
        index = subwords.word_sentence_index(df, "id", size)
        assert rows(index.select("word", "id", "n")) == [("a", 1, 2), ("a", 5, 2), ("b", 1, 1), ("b", None, 1)]
        lists = subwords.posting_lists(index, "id", 4)
        assert rows(lists.selectExpr("word", "part", "postings.id", "postings.n")) == [
            ("a", 0, [1], [2]), ("a", 1, [5], [2]), ("b", 0, [1], [1]), ("b", None, [None], [1])
        ]
        assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange") == exchanged


def test_profiles_shuffle_texts_alone(spark, rows):
    df = spark.createDataFrame([(1, "ab ж"), (1, "жж"), (None, "a"), (3, "")], "id long, text string")
    found = scripts.dominant(df, ["id"], scripts.SCRIPT)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(found) == [(1, "Cyrillic"), (3, ""), (None, "Latin")]


def test_normalized_divergence_stores_no_cells(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(ngram_queries, "materialize", lambda df, name: stored.append(name) or df)
    ngram_queries.normalized_divergence(spark, SF)
    assert stored == []


def test_null_texts_have_special_tokens_alone(spark, rows):
    segmenter = subwords.Segmenter.from_table(spark.createDataFrame([("a",)], "piece string"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert rows(subwords.unk_fraction(df, segmenter, ["id"])) == [(1, 0.0), (2, 0.0)]
    assert rows(subwords.tokenize_corpus(df, segmenter, ["id"]).where("id = 2").select("position", "token")) == [(0, "[CLS]"), (1, "[SEP]")]


ODD_TOKENS = [(1, ["a", "b", "a", "b"]), (1, ["a", "b"]), (None, ["x"]), (2, []), (3, None), (4, ["a", None, "b c", ""])]


def test_ngram_rows_equal_exploded_arrays(spark, rows):
    """Repeated and null keys, null and empty lists, null tokens: the rows that exploding the array gives, without lambdas."""
    df = spark.createDataFrame(ODD_TOKENS, "id long, tokens array<string>")
    for low, high in ((1, 1), (1, 3), (2, 2), (2, 3)):
        found = ngrams.ngram_rows(df, "tokens", low, high, ["id"])
        assert rows(found) == rows(df.select("id", explode_terms(ngram_range("tokens", low, high)).alias("ngram")))
        assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_are_counted_without_carrying_or_repeating_tokens(spark):
    texts = ngram_queries.fx.text_docs(spark, SF).select("doc_id", word_tokens("text").alias("tokens"))
    for counts in (ngrams.ngram_counts(texts, 1, 3, ["doc_id"]), ngrams.bigram_counts(texts, [], "doc_id", "doc_id", cross_border=False)):
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and plan.count("regexp_extract_all") == 1
        generates = [line for line in plan.splitlines() if "Generate posexplode" in line]
        assert len(generates) == 1 and "tokens#" not in generates[0].rpartition("))")[2]  # what each row carries


def test_large_tables_are_dealt_out_before_bigrams(spark, monkeypatch, rows):
    monkeypatch.setattr(ids, "DEALT_BYTES", 1 << 12)
    df = spark.range(10_000, numPartitions=2).selectExpr("id", "array('a', string(id % 3)) AS tokens")
    assert ids.dealt(df.select("id")).rdd.getNumPartitions() == 80_000 >> 12
    assert ids.dealt(spark.range(10)).rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()
    counts = ngrams.bigram_counts(df, [], "id", "id", cross_border=False)
    assert "RoundRobinPartitioning" in counts._jdf.queryExecution().executedPlan().toString()
    assert rows(counts) == [("a 0", 3334), ("a 1", 3333), ("a 2", 3333)]


def test_unknown_shares_are_given_for_every_language(spark, tmp_path, rows):
    """All languages come out, highest first; there were once 18 at most."""
    docs = [(i, "ab ab x" if i % 2 else "ab", f"l{i // 2:02d}", f"src{i % 10}", 4) for i in range(60)] + [(60, None, None, "src10", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = subword_queries.unk_by_language(spark, str(tmp_path)).collect()
    assert {r["language"] for r in found} == {None, *(f"l{i:02d}" for i in range(30))}
    assert [r["mean_unk_fraction"] for r in found] == sorted((r["mean_unk_fraction"] for r in found), reverse=True)


def test_ranks_shuffle_vectors_once(spark, tmp_path, rows):
    """Small blocks make many pairs; the vectors are not copied for them, and ranks stay those of all pairs, repeated and null keys included."""
    draw = np.random.default_rng(5)
    data = [("m", lang, i, draw.normal(size=4).round(1).tolist()) for lang in ("a", "b", None) for i in range(30)]
    data += [("m", "a", 3, data[40][3]), ("m", "b", None, [1.0, 0.0, 0.0, 0.0]), ("m", "a", None, [0.5, 1.0, 0.0, 0.0]), ("n", "a", 1, None)]
    vectors = spark.createDataFrame(data, "model string, language string, sentence_id long, embedding array<double>")
    ranks = retrieval.retrieval_ranks(vectors, block_rows=4)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan
    expected = {}
    units = [(lang, i, np.array(v) / (np.linalg.norm(v) or 1)) for _, lang, i, v in data if v is not None]

    def away(a, b):
        return round(min(max(1 - float(a @ b), 0), 2), 9)

    for lang1, i, u in units:
        for lang2, j, v in units:
            if i == j:
                others = [away(u, x) for l, k, x in units if l == lang2 and (k != i or k is None)]
                target = away(u, v)
                found = expected.setdefault(("m", lang1, lang2, i), [target, 0, 0])
                found[0] = max(found[0], target)
                found[1] += sum(d < target for d in others)
                found[2] += sum(d == target for d in others)
    expected = {k: (d, closer + (tied + 2) / 2) for k, (d, closer, tied) in expected.items() if k[3] is not None}
    got = {tuple(r)[:4]: tuple(r)[4:] for r in ranks.collect()}
    assert {k: v for k, v in got.items() if k[3] is not None} == expected
    assert {k[:3] for k in got if k[3] is None} == {("m", a, b) for a in "ab" for b in "ab"}
