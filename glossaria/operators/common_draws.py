"""Sentence pairs drawn among the positions that two languages share, so that every draw lands.

The positions of a language are bitmaps of ``BITMAP`` positions each. Two languages
share the bits that both have; counts of bits and their running sum give every shared
position a rank, and a draw is a rank: it finds its bitmap by range and its position
as the bit of that rank. No list of shared positions is made, which would have a row
per position for each of the language pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.draws import draw
from glossaria.operators.ids import dimension
from glossaria.operators.pairs import PAIR_COLUMNS
from glossaria.sources.shared import materialize

BITMAP = 1 << 15
DRAWS = 1 << 16  # draws of a language pair that one task handles together
PAIR = ["language1", "language2"]


def shared_bitmaps(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(language1, language2, bucket, bitmap, n, before, total)``: shared positions, their count, and the counts before."""
    bits = df.groupBy("language", F.floor(F.col("sentence_id") / BITMAP).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("sentence_id"), F.lit(BITMAP))).alias("bitmap")
    )
    sides = pairs.select(*PAIR, F.explode(F.array(*PAIR)).alias("language"))
    both = bits.join(dimension(sides), "language").groupBy(*PAIR, "bucket").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("sides")
    )
    shared = both.where(F.col("sides") == 2).withColumn("n", F.bitmap_count("bitmap")).where(F.col("n") > 0).drop("sides")
    order = Window.partitionBy(*PAIR).orderBy("bucket")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return shared.withColumns(
        {"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*PAIR))}
    )


def _draws(shared: DataFrame, n: int, least: int) -> DataFrame:
    """``n`` draws of each pair with at least ``least`` shared positions, spread before they are listed."""
    totals = shared.where(F.col("total") >= least).select(*PAIR, "total").distinct()
    starts = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // DRAWS))).alias("run"))
    starts = starts.repartition(*PAIR, "run")
    first = F.col("run").cast("long") * DRAWS
    return starts.select(*PAIR, "total", "run", F.explode(F.sequence(first, F.least(first + DRAWS, F.lit(n)) - 1)).alias("draw_id"))


def _positions(ranked: DataFrame, shared: DataFrame) -> DataFrame:
    """Add ``position`` to rows ``(language1, language2, run, draw_id, side, rank)``."""
    cell = lambda c: F.expr(f"({c}) DIV {BITMAP}")
    ranges = shared.select(
        F.col("language1").alias("of1"), F.col("language2").alias("of2"), "bucket", "before", "n",
        F.explode(F.sequence(cell("before"), cell("before + n - 1"))).alias("cell"),
    )
    same = (F.col("language1") == F.col("of1")) & (F.col("language2") == F.col("of2")) & (cell("rank") == F.col("cell"))
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    placed = ranked.join(ranges, same & inside).select(
        *PAIR, "run", "draw_id", "side", "bucket", (F.col("rank") - F.col("before")).alias("nth")
    )
    placed = materialize(placed, "draws")
    group = [*PAIR, "bucket", "run"]
    bitmaps = shared.select(*PAIR, "bucket", "bitmap").join(placed.select(*group).distinct(), [*PAIR, "bucket"])
    bitmaps = bitmaps.select(*[F.col(c).alias(c) for c in [*group, "bitmap"]])
    schema = "language1 string, language2 string, draw_id long, side int, position long"

    def select(key: tuple, draws: pa.Table, bitmap: pa.Table) -> pa.Table:
        bits = np.unpackbits(np.frombuffer(bitmap.column("bitmap")[0].as_py(), np.uint8), bitorder="little")
        found = np.flatnonzero(bits)[draws.column("nth").to_numpy()] + key[2].as_py() * BITMAP
        return pa.table(
            [*(draws.column(c) for c in (*PAIR, "draw_id")), draws.column("side").cast(pa.int32()), pa.array(found, pa.int64())],
            names=[*PAIR, "draw_id", "side", "position"],
        )

    return placed.groupBy(*group).cogroup(bitmaps.groupBy(*group)).applyInArrow(select, schema)


def _with_texts(df: DataFrame, drawn: DataFrame, label: str) -> DataFrame:
    """Texts of both positions; ``drawn`` has index1 of language1 and index2 of language2."""
    for k in "12":
        texts = df.select(F.col("language").alias(f"language{k}"), F.col("sentence_id").alias(f"index{k}"), F.col("text").alias(f"sentence{k}"))
        drawn = drawn.join(texts, [f"language{k}", f"index{k}"])
    return drawn.withColumn("label", F.lit(label)).select(*PAIR_COLUMNS)


def drawn_positive_pairs(df: DataFrame, pairs: DataFrame, n: int, seed: str = "positive") -> DataFrame:
    """Exactly ``n`` rows for each language pair that shares a position: the same sentence in both, label ``yes``.

    Draws are with replacement and differ between pairs.
    """
    shared = materialize(shared_bitmaps(df, pairs), "shared-positions")
    drawn = _draws(shared, n, 1) if n > 0 else _draws(shared, 1, 1).limit(0)
    ranked = drawn.select("*", F.lit(1).alias("side"), draw(seed, F.col("total"), F.col("draw_id"), *map(F.col, PAIR)).alias("rank"))
    placed = _positions(ranked, shared)
    return _with_texts(df, placed.select(*PAIR, "draw_id", F.col("position").alias("index1"), F.col("position").alias("index2")), "yes")


def drawn_negative_pairs(df: DataFrame, pairs: DataFrame, n: int, seed: str = "negative") -> DataFrame:
    """Exactly ``n`` rows for each language pair that shares two positions: different sentences, label ``no``, ``index1 < index2``."""
    shared = materialize(shared_bitmaps(df, pairs), "shared-positions")
    drawn = _draws(shared, n, 2) if n > 0 else _draws(shared, 1, 2).limit(0)
    keys = [F.col("draw_id"), *map(F.col, PAIR)]
    both = drawn.withColumns({"a": draw(seed + ".a", F.col("total"), *keys), "b": draw(seed + ".b", F.col("total") - 1, *keys)})
    both = both.withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("int"))
    ranked = both.select(*PAIR, "run", "draw_id", F.posexplode(F.array("a", "b")).alias("side", "rank"))
    placed = _positions(ranked, shared).groupBy(*PAIR, "draw_id").agg(F.min("position").alias("index1"), F.max("position").alias("index2"))
    return _with_texts(df, placed, "no")
