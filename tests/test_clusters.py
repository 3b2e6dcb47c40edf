"""Pruned ranks and the inverted lists against comparing all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaria.operators import clusters, retrieval

SCHEMA = "model string, language string, sentence_id long, embedding array<double>"


def vectors(spark, seed=1, n=60, noise=0.05, width=8):
    """Sentences around ten topics; translations are near each other. Zero vectors, ties and missing translations."""
    draw = np.random.default_rng(seed)
    topics = draw.normal(0, 1, (10, width))
    rows = []
    for model in ("m1", "m2"):
        for i in range(n):
            sense = topics[i % 10] + draw.normal(0, noise, width)
            for language in ("p", "q", "r"):
                if (i + len(language)) % 17 or language == "p":
                    rows.append((model, language, i, (sense + draw.normal(0, noise, width)).tolist()))
        rows += [(model, "p", 100, [0.0] * width), (model, "q", 100, [0.0] * width), (model, "r", 101, [0.0] * width)]
        rows += [(model, "q", 102 + k, rows[1][3]) for k in range(4)] + [(model, "p", 103, rows[0][3]), (model, "r", 105, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("lists, block_rows", [(1, 4096), (10, 4096), (7, 4), (40, 3)])
def test_ranks_equal_all_pairs(spark, rows, lists, block_rows):
    df = vectors(spark)
    pruned = clusters.ranks(df, lists, block_rows)
    assert rows(pruned.drop("compared")) == rows(retrieval.retrieval_ranks(df))


def test_bounds_settle_most_pairs_of_clustered_vectors(spark):
    df = vectors(spark, n=200, noise=0.02).where("sentence_id < 100 or sentence_id > 105")
    pairs = df.groupBy("model", "language").count().toPandas()
    all_pairs = sum(a * b for _, g in pairs.groupby("model") for a in g["count"] for b in g["count"])
    compared = clusters.ranks(df, lists=20).agg(F.sum("compared")).head()[0]
    print(f"share of compared pairs {compared / all_pairs:.3f}")
    assert compared < 0.2 * all_pairs


@pytest.mark.parametrize("lists, probes, block_rows", [(1, 1, 4096), (10, 1, 4096), (10, 3, 2), (30, 2, 4096)])
def test_nearest_with_residual_check_is_exact(spark, rows, lists, probes, block_rows):
    df = vectors(spark)
    asked = df.where("sentence_id % 5 = 0").select("model", "language", "sentence_id")
    found = clusters.nearest(clusters.build(df, lists, block_rows), asked, 4, probes)
    truth = retrieval.nearest_candidates(df, 4, asked=asked)
    assert rows(found.select(*truth.columns)) == rows(truth)
    assert set(rows(truth)) <= set(rows(retrieval.nearest_candidates(df, 4)))


def test_recall_of_the_nearest_lists_alone(spark):
    df = vectors(spark, n=200)
    asked = df.where("sentence_id % 50 = 0").select("model", "language", "sentence_id")
    truth = retrieval.nearest_candidates(df, 5, asked=asked)
    found = clusters.nearest(clusters.build(df, 10), asked, 5, probes=3, exact=False)
    for r in clusters.recall(found, truth).collect():
        assert r["recall"] >= 0.9 and r["n_rows"] == truth.where(F.col("model") == r["model"]).count()


def test_no_vectors(spark):
    df = vectors(spark).limit(0)
    assert clusters.ranks(df).count() == 0
    assert clusters.nearest(clusters.build(df), df.select("model", "language", "sentence_id"), 3).count() == 0


@pytest.mark.parametrize("k, n", [(1, 1), (5, 3), (5, 79), (5, 80), (5, 1000), (70, 1000)])
def test_nearest_of_a_block_without_sorting_all(monkeypatch, k, n):
    draw = np.random.default_rng(5)
    near = np.round(draw.uniform(-1, 1, (30, n)), 2)  # many ties
    near += draw.uniform(-1, 1, near.shape) * 1e-10  # that rounding brings back
    near[3], near[4, ::2], near[5, : n // 2] = 1 + 1e-15, np.nan, np.nan
    rounded, counted = np.round, []
    monkeypatch.setattr(retrieval.np, "round", lambda x, digits: counted.append(x.size) or rounded(x, digits))
    place, d = retrieval._nearest(near, k)
    monkeypatch.undo()
    all_d = np.round(np.clip(1.0 - near, 0.0, 2.0), retrieval.DIGITS)
    best = np.argsort(all_d, axis=1, kind="stable")[:, :k]
    assert np.array_equal(place, best) and np.array_equal(d, np.take_along_axis(all_d, best, axis=1), equal_nan=True)
    assert n < 1000 or k > 5 or sum(counted) < near.size / 3


@pytest.mark.parametrize("bundle_bytes", [1 << 25, 800])
def test_vectors_are_sent_once_to_a_bundle_of_blocks(spark, rows, monkeypatch, bundle_bytes):
    monkeypatch.setattr(clusters, "BUNDLE_BYTES", bundle_bytes)
    df = vectors(spark, noise=1.0).where("sentence_id < 100")  # no clusters: the bounds settle little
    index = clusters.build(df, 12, 5)
    targets = clusters._targets(index.members)
    opened = clusters.block_pairs(index, targets).where(F.col("state") == clusters.OPEN).select(*clusters.PAIR)
    counts = clusters._counted(index, targets, opened)
    blocks = index.blocks.count()
    per_query = counts.groupBy("model", "lang1", "lang2", "sentence_id").count().agg(F.max("count")).head()[0]
    assert blocks > 60 and (per_query == 1 if bundle_bytes > 800 else 1 < per_query <= 8)
    assert rows(clusters.ranks(df, 12, 5).drop("compared")) == rows(retrieval.retrieval_ranks(df))
