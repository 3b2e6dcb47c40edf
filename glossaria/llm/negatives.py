"""Hard negatives by exact integer inner products, several candidates per multiplication.

Vectors become integers (``floor(scale * x)``), so scores are exact. Rows and
anchors are dealt to slabs and blocks of bounded bytes, every slab meets every
anchor block in one cogroup, and there the products are Kronecker-packed: the
components of a slab's candidates, biased to be non-negative, are written into
separated fields of wide integers, one integer for several candidates. Each
component of an anchor is multiplied once with such an integer; the sums hold the
candidates' scores in their fields, and taking off the biases gives them exactly.
An integer has the 53 bits that a double holds exactly, so a matrix product does
the multiplications; where a single field needs more bits (components beyond
some millions) Python's integers of any width take their place.

Two passes: the first gives each anchor its ``positives`` best rows of its own
label; the second, knowing their scores, the best ``negatives`` rows of other labels
in the window that each positive's score opens. A cogroup sends only the best rows
of its slab, so no group ever holds an anchor's candidates.

Rows with a null id, label, vector or component, or a component that is not
finite, take no part. Vectors of different lengths meet as if the shorter ended
in zeros. Repeated rows are rows of their own (an anchor row is no positive of
itself, its copies are); repeated anchors return their rows once each. A score that
a 64-bit integer cannot hold counts as ``MOST`` with its sign. Other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.sources.shared import materialize

EXACT_BITS = 53
SLAB_BYTES = 1 << 25  # of the vectors of a slab or block, at most
LEAST_BYTES = 1 << 21  # of a slab, unless SLABS are enough
SLABS = 16  # of a small table, to keep all cores at work
CANDIDATES = 1 << 13  # packed together
CELLS = 1 << 21  # scores held at a time
MOST = (1 << 63) - 1


def integers(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Components as integers, one row per vector, shorter ones filled with zeros."""
    flat = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    with np.errstate(over="ignore"):
        whole = np.floor(scale * values)
    if len(whole) and not np.abs(whole).max() < 1 << EXACT_BITS:  # beyond that doubles are whole numbers
        whole = np.array([int(x) if np.isfinite(x) else int(scale * 2) * int(v) // 2 for x, v in zip(whole, values)], object)
    out = np.zeros((len(size), int(size.max(initial=0))), whole.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(whole)) - np.repeat(ends - size, size)] = whole
    return out


def ends_of(x: np.ndarray) -> tuple[int, int]:
    return (int(x.min()), int(x.max())) if x.size else (0, 0)


def of_kind(x: np.ndarray, kind: type) -> np.ndarray:
    """Doubles stay doubles; for Python integers they pass through whole numbers."""
    return x.astype(np.int64).astype(object) if kind is object and x.dtype != object else x.astype(kind)


class Packed:
    """Candidates in fields of wide integers; ``scores`` multiplies anchors with all of them."""

    def __init__(self, candidates: np.ndarray, least: int, most: int):
        """``least`` and ``most``: of the components of the anchors to come."""
        (low, high), (self.n, width) = ends_of(candidates), candidates.shape
        self.least, self.low = least, low
        largest = width * max(abs(least), abs(most)) * max(abs(low), abs(high))
        self.wide = (4 * largest).bit_length() > EXACT_BITS
        self.kind = object if self.wide else np.float64
        self.bits = max(1, (width * (most - least) * (high - low)).bit_length())
        fields = 8 if self.wide else EXACT_BITS // self.bits
        each = max(1, -(-self.n // fields))
        self.fields = [slice(at, min(at + each, self.n)) for at in range(0, self.n, each)]
        shifted = of_kind(candidates, self.kind) - low
        self.sums = shifted.sum(axis=1) * least
        self.packed = np.zeros((width, each), self.kind)
        for f, part in enumerate(self.fields):
            self.packed[:, : part.stop - part.start] += shifted[part].T * (1 << f * self.bits)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, one row per anchor: exact doubles, or 64-bit integers where those do not do."""
        shifted = of_kind(anchors, self.kind) - self.least
        # (a - least)(c - low) = ac - least(c - low) - low(a - least) - least low
        back = shifted.sum(axis=1) * self.low + self.least * self.low * anchors.shape[1]
        held = shifted @ self.packed  # one product per anchor component and wide integer
        out = np.empty((len(anchors), self.n), self.kind)
        for f in range(len(self.fields) - 1, -1, -1):
            part, unit = self.fields[f], 1 << f * self.bits
            field = held // unit if self.wide else np.floor(held * (1.0 / unit))
            out[:, part] = field[:, : part.stop - part.start]
            held -= field * unit
        out += self.sums[None, :]
        out += back[:, None]
        return np.clip(out, -MOST, MOST).astype(np.int64) if self.wide else out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], axis=1)


def scored_parts(anchors: np.ndarray, candidates: np.ndarray):
    """Yield (slice of anchors, parts), the parts as (slice of candidates, scores) with at most ``CELLS`` scores."""
    width = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = widened(anchors, width), widened(candidates, width)
    cuts = [slice(c, c + CANDIDATES) for c in range(0, len(candidates), CANDIDATES)]
    packed = [(cut, Packed(candidates[cut], *ends_of(anchors))) for cut in cuts]
    for a in range(0, len(anchors), CELLS // CANDIDATES):
        some = slice(a, min(a + CELLS // CANDIDATES, len(anchors)))
        yield some, ((cut, p.scores(anchors[some])) for cut, p in packed)


class Best:
    """The best rows of each group so far: highest scores, ties by smaller id."""

    def __init__(self, groups: int, most: int):
        self.most, self.floor = most, np.full(groups, -MOST)  # floor: what a further row must reach
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, ids = np.concatenate([self.group, group]), np.concatenate([self.ids, ids])
        score = np.concatenate([self.score, score.astype(np.int64)])
        order = np.lexsort((ids, -score, group))
        group = group[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        kept = place < self.most
        self.group, self.score, self.ids = group[kept], score[order[kept]], ids[order[kept]]
        last = place == self.most - 1
        self.floor[group[last]] = score[order[last]]


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    slab_bytes: int = SLAB_BYTES,
) -> DataFrame:
    """One row per anchor, positive and negative: ids, rank and exact scores.

    ``anchors`` are rows of ``vectors``, ids and labels are integers. A negative's
    score lies between ``least_percent`` and ``most_percent`` of the positive's.
    """

    def valid(df: DataFrame) -> DataFrame:
        x = F.col(vector)
        finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        some = df.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
        return some.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))

    numbered = F.monotonically_increasing_id()
    rows = materialize(valid(vectors).withColumn("row", numbered), "vectors")
    # equal anchors are searched once
    chosen = valid(anchors).groupBy("id", "label", "x").agg(F.count(F.lit(1)).alias("copies"))
    chosen = materialize(chosen.withColumn("key", numbered), "anchors")

    def cuts(df: DataFrame, least: int) -> int:
        total = df.agg(F.coalesce(F.sum(F.size("x") * 8 + 16), F.lit(0))).head()[0]
        return max(-(-total // slab_bytes), min(least, -(-total // min(LEAST_BYTES, slab_bytes))), 1)

    slabs, blocks = cuts(rows, SLABS), cuts(chosen, 1)
    every_slab, every_block = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (slabs, blocks))
    slab = F.pmod(F.xxhash64("row"), F.lit(slabs)).cast("int")
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    candidates = rows.select("id", "label", "x", slab.alias("slab"), every_block.alias("block"))

    def meet(asked: DataFrame, search, schema: str) -> DataFrame:
        """Every slab of rows with every block of anchors."""
        asked = asked.withColumn("block", block).withColumn("slab", every_slab)
        return asked.groupBy("slab", "block").cogroup(candidates.groupBy("slab", "block")).applyInArrow(search, schema)

    def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
        return [table.column(n).to_numpy() for n in names]

    def table_of(schema: str, parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
        names = [c.split()[0] for c in schema.split(", ")]
        columns = zip(*parts) if parts else [[]] * len(names)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in columns], names=names)

    best_rows = "key long, own long, found long, score long"

    def same_label(a: pa.Table, c: pa.Table) -> pa.Table:
        """The best rows of the anchor's label, its own row among them, and its product with itself."""
        ax, cx = integers(a.column("x"), scale), integers(c.column("x"), scale)
        (key, al), (ids, cl), parts = numbers(a, "key", "label"), numbers(c, "id", "label"), []
        own = np.array([max(-MOST, min(MOST, sum(int(v) ** 2 for v in x))) for x in ax], np.int64)
        for p, scored in scored_parts(ax, cx):
            found = Best(p.stop - p.start, positives + 1)
            for q, s in scored:
                row, col = np.nonzero((s >= found.floor[:, None]) & (al[p, None] == cl[None, q]))
                found.add(row, s[row, col], ids[q][col])
            parts.append((key[p][found.group], own[p][found.group], found.ids, found.score))
        return table_of(best_rows, parts)

    window_rows = "key long, nth long, found long, score long"

    def other_label(a: pa.Table, c: pa.Table) -> pa.Table:
        """The best rows of other labels in each positive's window."""
        ax, cx = integers(a.column("x"), scale), integers(c.column("x"), scale)
        (key, al), (ids, cl), parts = numbers(a, "key", "label"), numbers(c, "id", "label"), []
        # an anchor with fewer positives has windows that nothing is in
        low, high = np.full((len(ax), positives), MOST), np.full((len(ax), positives), -MOST)
        for i, wanted in enumerate(a.column("wanted").to_pylist()):
            for w in wanted:
                low[i, w["nth"]] = -(-least_percent * w["positive"] // 100)
                high[i, w["nth"]] = most_percent * w["positive"] // 100
        for p, scored in scored_parts(ax, cx):
            found = Best(low[p].size, negatives)
            for q, s in scored:
                lower = np.maximum(low[p], found.floor.reshape(-1, positives))
                row, col = np.nonzero(s >= lower.min(axis=1)[:, None])
                other = al[p][row] != cl[q][col]
                row, col = row[other], col[other]
                score, new = s[row, col], [(row[:0], row[:0], row[:0])]
                for k in range(positives):
                    hit = np.flatnonzero((score >= lower[row, k]) & (score <= high[p][row, k]))
                    new.append((row[hit] * positives + k, score[hit], ids[q][col[hit]]))
                found.add(*(np.concatenate(x) for x in zip(*new)))
            anchor, nth = np.divmod(found.group, positives)
            parts.append((key[p][anchor], nth, found.ids, found.score))
        return table_of(window_rows, parts)

    order = [F.col("score").desc(), F.col("found")]
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order)).alias("place")
    first = meet(chosen.select("key", "label", "x"), same_label, best_rows).select("*", place)
    first = first.where(F.col("place") <= positives + 1).join(chosen.select("key", F.col("id").alias("anchor_id"), "copies"), "key")
    # the anchor's own row is the first with its id and its product with itself
    alike = (F.col("found") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    in_place = Window.partitionBy("key").orderBy("place")
    first = first.withColumn("itself", alike & (F.sum(alike.cast("int")).over(in_place) == 1)).where(~F.col("itself"))
    nth = (F.row_number().over(in_place) - 1).cast("long").alias("nth")
    first = first.select("key", "anchor_id", "copies", F.col("found").alias("positive_id"), F.col("score").alias("positive"), nth)
    first = materialize(first.where(F.col("nth") < positives), "positives")

    wanted = first.groupBy("key").agg(F.collect_list(F.struct("nth", "positive")).alias("wanted"))
    second = meet(chosen.select("key", "label", "x").join(wanted, "key"), other_label, window_rows)
    rank = F.row_number().over(Window.partitionBy("key", "nth").orderBy(*order)).alias("rank")
    second = second.select("*", rank).where(F.col("rank") <= negatives)
    joined = second.join(first, ["key", "nth"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(
        "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"),
        F.col("positive").alias("positive_score"), F.col("score").alias("negative_score"),
    )


# The same rows in DuckDB, for vectors of one length.
ORACLE_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS other,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.r <> b.r
),
positives AS (
  SELECT r, anchor_id, other AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS nth
  FROM scored WHERE alike
),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scored s ON s.r = p.r AND NOT s.alike
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
  WHERE p.nth <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
