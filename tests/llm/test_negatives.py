"""Hard negatives against brute force with Python integers, and the rows of the query against SQL."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from oracle_check import compare, connect

from conftest import SF
from glossaria.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, positives=5, count=10):
    """Scores by plain loops; rows as (vec_id, components, label)."""
    valid = [
        (i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v], c) for i, v, c in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    clip = lambda x: max(-negatives.MOST, min(negatives.MOST, x))
    out = []
    for at, (i, v, c) in enumerate(valid):
        if i % 100:
            continue
        scored = [(clip(sum(x * y for x, y in zip(v, w))), j, d) for k, (j, w, d) in enumerate(valid) if k != at]
        same = sorted(((-s, j) for s, j, d in scored if d == c))[:positives]
        for s, j in same:
            window = sorted((-t, k) for t, k, d in scored if d != c and -30 * s <= 100 * t <= -90 * s)[:count]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(window, 1)]
    return sorted(out)


def vectors(seed, n, width=6, spread=1.0, ids=400):
    draw = random.Random(seed)
    rows = [(draw.randrange(ids), [draw.gauss(0.3, spread) for _ in range(width)], draw.randrange(3)) for _ in range(n)]
    return rows + [(100 * k, [draw.gauss(0.3, spread) for _ in range(width)], k % 3) for k in range(4)]


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'x' AS key", "2 AS copies", "3 AS x", "4 AS row").repartition(3)
    found = negatives.mine(df, df.where("vec_id % 100 = 0"), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def test_the_sql_gives_the_same_rows(spark):
    con, name = connect(SF), "op13_hard_negatives"
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert len(found) > 100
    assert compare(found, con.execute(queries.ORACLES[name]).df()) == ""


@pytest.mark.parametrize("spread", [1.0, 1e4, 1e9, 1e30, 1e303])
def test_scores_of_any_size_equal_brute_force(spark, spread):
    rows = vectors(1, 150, spread=spread)
    assert mined(spark, rows) == plain(rows)


def test_ties_repeats_nulls_and_lengths(spark):
    rows = vectors(2, 120, ids=60)
    rows = [(i, [float(round(x)) for x in v], c) for i, v, c in rows]  # many equal scores
    rows += [rows[0]] * 3 + [rows[-1]] * 3 + [rows[-2]] * 2 + [(200, rows[-3][1], 1), (200, rows[-3][1], 2)]
    rows += [(300, None, 1), (300, [1.0, None], 1), (None, [1.0, 1.0], 1), (5, [1.0, 2.0], None), (100, [math.nan, 1.0], 1)]
    rows += [(100, [math.inf], 1), (300, [], 1), (300, [2.0], 1), (7, [1.0] * 9, 2), (8, [], 2)]
    expected = plain(rows)
    assert expected and mined(spark, rows) == expected


def test_slabs_and_blocks_do_not_change_the_rows(spark, monkeypatch):
    rows = vectors(3, 300)
    monkeypatch.setattr(negatives, "CELLS", 1 << 5)
    monkeypatch.setattr(negatives, "CANDIDATES", 1 << 4)
    assert mined(spark, rows, slab_bytes=1000) == plain(rows)


def test_one_vector_may_be_most_rows(spark):
    rows = vectors(4, 60) + [(i, [0.5] * 6, i % 3) for i in range(300)]
    assert mined(spark, rows) == plain(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (2, [1.0], 1)]) == []


@pytest.mark.parametrize("most", [3, 200, 10**6, 10**12])
def test_packed_fields_give_exact_products(most):
    draw = np.random.default_rng(most)
    a, c = (draw.integers(-most, most // 3, (n, 7)) for n in (9, 50))
    packed = negatives.Packed(c.astype(np.float64), int(a.min()), int(a.max()))
    expected = [[max(-negatives.MOST, min(negatives.MOST, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in c] for u in a]
    assert packed.scores(a.astype(np.float64)).astype(np.int64).tolist() == expected
    assert packed.wide or len(packed.fields) == 53 // packed.bits
