"""User functions over batches: edges, sizes, schema errors."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from glossaria.operators import batches


def arrow(*sizes):
    out, at = [], 0
    for n in sizes:
        out.append(pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int64()), pa.array(["x" * 10] * n)], names=["k", "t"]))
        at += n
    return out


@pytest.mark.parametrize("sizes", [(10,), (3, 3, 4), (1,) * 10, (0, 7, 0, 3), (9, 1), ()])
@pytest.mark.parametrize("size", [1, 3, 4, 10, 99])
def test_batches_are_cut_anew_to_the_exact_size(sizes, size):
    got = list(batches.cut(iter(arrow(*sizes)), size))
    n = sum(sizes)
    assert [b.num_rows for b in got] == [size] * (n // size) + ([n % size] if n % size else [])
    assert [k for b in got for k in b.column("k").to_pylist()] == list(range(n))


def test_long_values_make_smaller_batches():
    texts = ["a" * n for n in (1, 500, 1, 1, 2000, 5, 5, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got = list(batches.cut(iter([batch, batch]), 5, max_bytes=600))
    assert [t for b in got for t in b.column("t").to_pylist()] == texts * 2
    for b in got:
        assert b.num_rows <= 5 and (b.num_rows == 1 or int(batches.row_bytes(b).sum()) <= 700)
    assert [b.num_rows for b in batches.cut(iter([batch]), 5, max_bytes=1)] == [1] * 8


def test_map_adds_and_replaces_columns(spark, rows):
    df = spark.range(23).selectExpr("id", "cast(id AS string) AS t", "id * 1.5 AS x").repartition(3)

    def double(columns):
        assert set(columns) == {"id", "t"} and len(columns["id"]) <= 4
        return {"t": [t + t if t != "5" else None for t in columns["t"]], "batch": [len(columns["id"])] * len(columns["id"])}

    got = batches.map_batches(df, double, "t string, batch int", 4, ["id", "t"])
    assert got.columns == ["id", "x", "t", "batch"]
    assert rows(got.select("id", "t")) == rows(df.select("id", F.when(F.col("id") != 5, F.concat("t", "t"))))
    sizes = got.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("batch").alias("b")).collect()
    for r in sizes:
        n = len(r["b"])
        assert sorted(r["b"], reverse=True) == [4] * (n // 4 * 4) + [n % 4] * (n % 4)


def test_map_may_change_the_number_of_rows(spark, rows):
    df = spark.createDataFrame([("a b",), ("",), ("c",), (None,)], "t string")
    words = lambda c: {"w": [w for t in c["t"] for w in (t or "").split()]}
    assert rows(batches.map_batches(df, words, "w string", 2, keep=False)) == [("a",), ("b",), ("c",)]
    assert batches.map_batches(df.limit(0), words, "w string", keep=False).count() == 0


@pytest.mark.parametrize("made, message", [
    ({"y": [1]}, "schema has"), ({"x": [1], "y": [2]}, "schema has"), ({"x": ["no number"]}, "is no int"), ({"x": [1, 2]}, "rows in a batch"),
])
def test_results_that_do_not_fit_the_schema_are_errors(spark, made, message):
    with pytest.raises(PythonException, match=message):
        batches.map_batches(spark.range(1).coalesce(1), lambda c: made, "x int").collect()


def test_filter(spark, rows):
    df = spark.range(50).withColumn("t", F.col("id").cast("string"))
    got = batches.filter_batches(df, lambda c: [None if k == 9 else k % 3 == 0 for k in c["id"]], 7, ["id"])
    assert rows(got) == rows(df.where("id % 3 = 0 AND id <> 9"))
