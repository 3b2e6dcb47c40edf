"""Retrieval over clustered vectors: exact ranks and nearest candidates without comparing all pairs.

Unit vectors are dealt to blocks of near ones: spherical k-means on a bounded sample
gives centres per model, every vector goes to its nearest centre, and large clusters
are cut by hash. A block has a direction and a radius, the largest angle of a member
from it. Angles obey the triangle inequality, so the angle of two blocks bounds the
distance of all their members, and most pairs of blocks need no look at the vectors.

Input: ``vectors(model, language, sentence_id, embedding)`` as in
:mod:`glossaria.operators.retrieval`, whose functions compare all pairs and return the
same rows. A vector of zeros has the distance 1 from everything and its own blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.vectors import cosine_distance
from glossaria.operators.retrieval import DIGITS, unit_vectors
from glossaria.sources.shared import materialize

MAX_LISTS = 1024  # centres of a model, at most
SAMPLE_PER_LIST = 32  # vectors that centres are fitted on, per centre
BLOCK_ROWS = 4096
BUNDLE_BYTES = 1 << 25  # of the vectors of a bundle of blocks
SLACK = 1e-7  # of distances, far above the noise of their rounding and of angles
NONE, ALL, OPEN = "none", "all", "open"
BLOCK = ["model", "language", "cluster", "sub"]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _directions(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit_centres(units: DataFrame, lists: int, rounds: int = 10) -> DataFrame:
    """``(model, centres)`` by spherical k-means on ``SAMPLE_PER_LIST * lists`` vectors of each model, drawn by hash."""
    present = units.where(F.exists("unit", lambda x: x != 0))
    drawn = F.row_number().over(Window.partitionBy("model").orderBy(F.xxhash64("language", "sentence_id"), "sentence_id"))
    sample = present.withColumn("drawn", drawn).where(F.col("drawn") <= SAMPLE_PER_LIST * lists)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows.sort_values("drawn")["unit"])
        centres = np.unique(x, axis=0)
        centres = centres[np.linspace(0, len(centres) - 1, min(lists, len(centres))).astype(int)]
        for _ in range(rounds):
            nearest = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, x)
            moved = _directions(sums)
            kept = moved.any(axis=1)  # an empty cluster keeps its centre
            centres[kept] = moved[kept]
        return pd.DataFrame({"model": [rows["model"].iloc[0]], "centres": [centres.tolist()]})

    return sample.select("model", "drawn", "unit").groupBy("model").applyInPandas(fit, "model string, centres array<array<double>>")


@dataclass(frozen=True)
class Index:
    """``members`` (model, language, cluster, sub, sentence_id, unit, row) and ``blocks`` (their key, n, centre, radius)."""

    members: DataFrame
    blocks: DataFrame


def build(vectors: DataFrame, lists: int | None = None, block_rows: int = BLOCK_ROWS) -> Index:
    """Index all vectors. ``lists`` is by default the root of the largest number of vectors of a language."""
    units = materialize(unit_vectors(vectors), "units")
    if lists is None:
        largest = units.groupBy("model", "language").count().agg(F.max("count")).head()[0] or 1
        lists = max(1, min(MAX_LISTS, round(largest**0.5)))
    # at most lists x width numbers for each model
    centres = {r["model"]: np.array(r["centres"]) for r in fit_centres(units, lists).collect()}

    def assign(parts):
        for rows in parts:
            cluster = np.full(len(rows), -1, np.int32)
            for model, at in rows.groupby("model").indices.items():
                x = _matrix(rows["unit"].iloc[at])
                if model in centres:
                    cluster[at] = np.where(x.any(axis=1), np.argmax(x @ centres[model].T, axis=1), -1)
            yield rows.assign(cluster=cluster)

    schema = "model string, language string, sentence_id long, unit array<double>, cluster int"
    rows = units.select("model", "language", F.col("sentence_id").cast("long").alias("sentence_id"), "unit")
    placed = materialize(rows.mapInPandas(assign, schema), "clusters")
    cuts = placed.groupBy("model", "language", "cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("cuts"))
    sub = F.pmod(F.xxhash64("sentence_id"), F.col("cuts")).cast("int").alias("sub")
    placed = placed.join(materialize(cuts, "cluster-cuts"), ["model", "language", "cluster"])
    members = placed.select(*BLOCK[:3], sub, "sentence_id", "unit", F.monotonically_increasing_id().alias("row"))
    members = materialize(members, "members")

    def describe(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows["unit"])
        centre = _directions(x.sum(axis=0, keepdims=True))[0]
        radius = 0.0
        if key[2] >= 0:  # opposite vectors may have no common direction
            radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) if centre.any() else float(np.pi)
        return pd.DataFrame([(*key, len(rows), centre, radius)], columns=[*BLOCK, "n", "centre", "radius"])

    schema = "model string, language string, cluster int, sub int, n long, centre array<double>, radius double"
    blocks = members.groupBy(*BLOCK).applyInPandas(describe, schema)
    return Index(members, materialize(blocks, "blocks"))


def _named(df: DataFrame, suffix: str, *names: str) -> DataFrame:
    """The block's key under the names of one side of a pair, and more columns as they are."""
    key = [F.col(c).alias(f"{d}{suffix}") for c, d in (("language", "lang"), ("cluster", "cluster"), ("sub", "sub"))]
    return df.select("model", *key, *names)


def _angle(a: Column, b: Column) -> Column:
    """Of two directions; a right angle if one of them is zero, as its distance is 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def _targets(members: DataFrame) -> DataFrame:
    """Each vector's block, and every language that has its translation with the distance to it."""
    names = ["language", "cluster", "sub", "unit", "row"]
    met = members.groupBy("model", "sentence_id").agg(F.collect_list(F.struct(*names)).alias("v"))
    queries = met.select("model", "sentence_id", "v", F.inline("v").alias("lang1", "cluster1", "sub1", "unit", "row"))
    pairs = F.explode("v").alias("c")
    rows = queries.select("model", "sentence_id", "lang1", "cluster1", "sub1", "unit", "row", pairs)
    target = cosine_distance(F.col("unit"), F.col("c.unit"), DIGITS).alias("target")
    return rows.select("model", "sentence_id", "lang1", "cluster1", "sub1", "row", F.col("c.language").alias("lang2"), target)


QUERY_BLOCK = ["model", "lang1", "cluster1", "sub1", "lang2"]


def block_pairs(index: Index, targets: DataFrame) -> DataFrame:
    """Pairs of a query block and a candidate block with what the bounds say about them.

    ``all``: every candidate is closer than every query's translation; ``none``: none
    is as close; ``open``: the vectors decide. One row per pair of blocks.
    """
    reached = [F.min("target").alias("least"), F.max("target").alias("most"), F.count(F.lit(1)).alias("queries")]
    ranges = targets.groupBy(*QUERY_BLOCK).agg(*reached)
    own = _named(index.blocks, "1", F.col("centre").alias("centre1"), F.col("radius").alias("radius1"))
    cone = [F.col(c).alias(d) for c, d in (("centre", "centre2"), ("radius", "radius2"), ("n", "candidates"))]
    other = _named(index.blocks, "2", *cone)
    met = ranges.join(own, ["model", "lang1", "cluster1", "sub1"]).join(other, ["model", "lang2"])
    zero = (F.col("cluster1") == -1) | (F.col("cluster2") == -1)
    reach = F.when(zero, F.lit(0.0)).otherwise(F.col("radius1") + F.col("radius2"))
    angle = _angle(F.col("centre1"), F.col("centre2"))
    lowest = F.lit(1.0) - F.cos(F.greatest(F.lit(0.0), angle - reach))
    highest = F.lit(1.0) - F.cos(F.least(F.lit(float(np.pi)), angle + reach))
    state = F.when(lowest > F.col("most") + SLACK, NONE).when(highest < F.col("least") - SLACK, ALL).otherwise(OPEN)
    return met.select(*QUERY_BLOCK, "cluster2", "sub2", "queries", "candidates", state.alias("state"))


PAIR = [*QUERY_BLOCK, "cluster2", "sub2"]
COUNTS = "model string, lang1 string, lang2 string, sentence_id long, closer long, tied long, compared long"


def _count(x: np.ndarray, target: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray):
    """Closer, tied and compared candidates of each query; queries that the block's cone settles are not compared."""
    centre = _directions(y.sum(axis=0, keepdims=True))[0]
    closer, tied = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    unsettled = np.ones(len(x), bool)
    if centre.any():
        angle = np.arccos(np.clip(x @ centre, -1, 1))
        radius = np.arccos(np.clip((y @ centre).min(), -1, 1))
        nonzero = x.any(axis=1)
        inside = nonzero & (1 - np.cos(np.minimum(np.pi, angle + radius)) < target - SLACK)
        outside = nonzero & (1 - np.cos(np.maximum(0, angle - radius)) > target + SLACK)
        closer[inside] = len(y)
        unsettled = ~(inside | outside)
    at = np.flatnonzero(unsettled)
    for start in range(0, len(at), 256):
        some = at[start : start + 256]
        d = np.round(np.clip(1.0 - x[some] @ y.T, 0.0, 2.0), DIGITS)
        rival = own[some, None] != ids[None, :]
        closer[some] = ((d < target[some, None]) & rival).sum(axis=1)
        tied[some] = ((d == target[some, None]) & rival).sum(axis=1)
    return closer, tied, unsettled * len(y)


def _count_bundle(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """Sums of :func:`_count` over the open pairs of blocks of two bundles; rows with ``opened`` list them."""
    names = [x.split()[0] for x in COUNTS.split(", ")]
    listed = q["opened"].notna()
    pairs, q = q[listed], q[~listed]
    if not len(q) or not len(c):
        return pd.DataFrame(columns=names)
    y, ids, blocks = _matrix(c["unit"]), c["sentence_id"].to_numpy(), c.groupby(["cluster2", "sub2"]).indices
    x, target, own = _matrix(q["unit"]), q["target"].to_numpy(), q["sentence_id"].to_numpy()
    queries, sums = q.groupby(["cluster1", "sub1"]).indices, np.zeros((3, len(q)), np.int64)
    for cluster, sub, opened in zip(pairs["cluster1"], pairs["sub1"], pairs["opened"]):
        at = queries[cluster, sub]
        for block in opened:
            to = blocks[block["cluster2"], block["sub2"]]
            sums[:, at] += _count(x[at], target[at], own[at], y[to], ids[to])
    return pd.DataFrame(
        {"model": key[0], "lang1": key[1], "lang2": key[3], "sentence_id": own, "closer": sums[0], "tied": sums[1], "compared": sums[2]}
    )[names]


def _bundles(index: Index) -> DataFrame:
    """``(block, bundle)``: blocks of a language dealt by hash to bundles of about ``BUNDLE_BYTES``."""
    rows = F.floor(F.lit(BUNDLE_BYTES // 8) / F.greatest(F.max(F.size("centre")), F.lit(1)))
    sizes = index.blocks.groupBy("model", "language").agg(F.greatest(F.ceil(F.sum("n") / rows), F.lit(1)).cast("int").alias("bundles"))
    bundle = F.pmod(F.xxhash64("cluster", "sub"), F.col("bundles")).cast("int").alias("bundle")
    return materialize(index.blocks.join(sizes, ["model", "language"]).select(*BLOCK, bundle), "bundles")


BUNDLES = ["model", "lang1", "bundle1", "lang2", "bundle2"]


def _counted(index: Index, targets: DataFrame, opened: DataFrame) -> DataFrame:
    """Counts of the open pairs of blocks; a vector is sent once to each bundle of blocks that it meets."""
    bundles = _bundles(index)
    of = {x: _named(bundles, x, F.col("bundle").alias(f"bundle{x}")) for x in "12"}
    opened = opened.join(of["1"], ["model", "lang1", "cluster1", "sub1"]).join(of["2"], ["model", "lang2", "cluster2", "sub2"])
    opened = materialize(opened, "open-pairs")
    block1, block2 = ["cluster1", "sub1"], ["cluster2", "sub2"]
    lists = opened.groupBy(*BUNDLES, *block1).agg(F.collect_list(F.struct(*block2)).alias("opened"))
    blank = [F.lit(0).cast("long").alias("sentence_id"), F.lit(0.0).alias("target"), F.lit(None).cast("array<double>").alias("unit")]
    lists = materialize(lists, "open-lists")
    marks = lists.select(*BUNDLES, *block1, *blank, "opened")
    queries = targets.join(lists.drop("opened"), QUERY_BLOCK).join(index.members.select("row", "unit"), "row")
    queries = queries.select(*marks.columns[:-1], F.lit(None).cast(lists.schema["opened"].dataType).alias("opened")).unionByName(marks)
    met = opened.select(*BUNDLES, *block2).distinct()
    candidates = _named(index.members, "2", "sentence_id", "unit").join(met, ["model", "lang2", *block2])
    fresh = [F.col(c).alias(c) for c in candidates.columns]
    return queries.groupBy(*BUNDLES).cogroup(candidates.select(*fresh).groupBy(*BUNDLES)).applyInPandas(_count_bundle, COUNTS)


def ranks(vectors: DataFrame, lists: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of :func:`retrieval.retrieval_ranks`, and ``compared``: candidates whose distance was taken.

    Pairs of blocks that the bounds settle add the size of a block, or nothing,
    to the ranks of all queries of a block; vectors are sent for the open pairs only,
    and once for all blocks of a bundle.
    """
    index = build(vectors, lists, block_rows)
    targets = materialize(_targets(index.members), "targets")
    pairs = materialize(block_pairs(index, targets), "block-pairs")
    opened = pairs.where(F.col("state") == OPEN).select(*PAIR)
    counts = _counted(index, targets, opened)
    settled = pairs.where(F.col("state") == ALL).groupBy(*QUERY_BLOCK).agg(F.sum("candidates").alias("closer"))
    zero = F.lit(0).cast("long")
    base = targets.join(settled, QUERY_BLOCK, "left").select(
        "model", "lang1", "lang2", "sentence_id", "target", F.coalesce("closer", zero).alias("closer"), zero.alias("tied"), zero.alias("compared")
    )
    rows = counts.withColumn("target", F.lit(None).cast("double")).unionByName(base)
    totals = rows.groupBy("model", "lang1", "lang2", "sentence_id").agg(
        F.max("target").alias("distance"), *[F.sum(c).alias(c) for c in ("closer", "tied", "compared")]
    )
    rank = F.col("closer") + (F.col("tied") + F.lit(2)) / F.lit(2)
    return totals.select("model", "lang1", "lang2", "sentence_id", "distance", rank.alias("rank"), "compared")


FOUND = "model string, lang1 string, lang2 string, sentence_id long, candidate_id long, distance double"


def _probe(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best members of the asked blocks: ``asked`` has the query, its vector and a block."""

    def best(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in FOUND.split(", ")]
        if not len(q) or not len(c):
            return pd.DataFrame(columns=names)
        c = c.sort_values("sentence_id")
        ids, y, parts = c["sentence_id"].to_numpy(), _matrix(c["unit"]), []
        for start in range(0, len(q), 256):
            part = q.iloc[start : start + 256]
            d = np.round(np.clip(1.0 - _matrix(part["unit"]) @ y.T, 0.0, 2.0), DIGITS)
            nearest = np.argsort(d, axis=1, kind="stable")[:, :k]
            few = nearest.shape[1]
            rows = part[["model", "lang1", "lang2", "sentence_id"]].loc[part.index.repeat(few)]
            parts.append(rows.assign(candidate_id=ids[nearest].ravel(), distance=np.take_along_axis(d, nearest, axis=1).ravel()))
        return pd.concat(parts)[names]

    group = ["model", "lang2", "cluster", "sub", "part"]
    # a block asked by many queries is probed by parts of them
    part = F.pmod(F.xxhash64("lang1", "sentence_id"), F.col("parts")).cast("int").alias("part")
    sizes = asked.groupBy(*group[:-1]).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
    sizes = materialize(sizes, "probe-sizes")
    queries = asked.join(sizes, group[:-1]).select(*group[:-1], "lang1", "sentence_id", "unit", part)
    members = index.members.withColumnRenamed("language", "lang2").join(sizes, group[:-1])
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    members = members.select(*[F.col(c).alias(c) for c in [*group[:-1], "sentence_id", "unit"]], every_part)
    return queries.groupBy(*group).cogroup(members.groupBy(*group)).applyInPandas(best, FOUND)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("model", "lang1", "lang2", "sentence_id").orderBy("distance", "candidate_id")
    return found.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= k)


def nearest(index: Index, queries: DataFrame, k: int = 10, probes: int = 4, exact: bool = True) -> DataFrame:
    """The ``k`` nearest sentences of every language, the own one included, for each query ``(model, language, sentence_id)``.

    First the ``probes`` blocks of a language with the nearest directions are searched.
    With ``exact``, the distance of the ``k``-th row found there is then held against the
    cones of all other blocks, and those that could hold a nearer row are searched too, so
    nothing is missed; without, rows in other blocks are missed.
    """
    asked = index.members.join(queries.select("model", "language", "sentence_id"), ["model", "language", "sentence_id"], "left_semi")
    asked = materialize(asked.select("model", F.col("language").alias("lang1"), F.col("cluster").alias("cluster1"), "sentence_id", "unit"), "queries")
    blocks = index.blocks.select("model", F.col("language").alias("lang2"), "cluster", "sub", "n", "centre", "radius")
    met = asked.join(blocks, "model")
    reach = F.when((F.col("cluster1") == -1) | (F.col("cluster") == -1), F.lit(0.0)).otherwise(F.col("radius"))
    lowest = F.lit(1.0) - F.cos(F.greatest(F.lit(0.0), F.col("angle") - reach))
    met = met.withColumn("angle", _angle(F.col("unit"), F.col("centre"))).withColumn("lowest", lowest).drop("centre", "unit")
    query = ["model", "lang1", "lang2", "sentence_id"]
    place = F.row_number().over(Window.partitionBy(*query).orderBy("angle", "cluster", "sub"))
    # one number per query and block, as many as the first look at an index takes
    met = materialize(met.select(*query, "cluster", "sub", "lowest", place.alias("place")), "probes")
    vectors = asked.select("model", "lang1", "sentence_id", "unit")

    def probe(some: DataFrame) -> DataFrame:
        return _probe(index, some.select(*query, "cluster", "sub").join(vectors, ["model", "lang1", "sentence_id"]), k)

    first = materialize(_best_of(probe(met.where(F.col("place") <= probes)), k), "first-found")
    if not exact:
        return first
    # fewer than k rows bound nothing
    bound = first.groupBy(*query).agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("rows"))
    rest = met.where(F.col("place") > probes).join(bound, query, "left")
    rest = rest.where(F.col("kth").isNull() | (F.col("rows") < k) | (F.col("lowest") <= F.col("kth") + SLACK))
    return _best_of(first.drop("position").unionByName(probe(rest)), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per model: rows that should be found, and the share that was."""
    key = ["model", "lang1", "lang2", "sentence_id", "candidate_id"]
    marked = truth.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left")
    return marked.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
