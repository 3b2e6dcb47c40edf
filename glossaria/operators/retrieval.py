"""Cross-lingual sentence retrieval over embeddings.

Input: ``vectors(model, language, sentence_id, embedding)``. Comparing every
sentence of one language with every sentence of another is quadratic by
definition. The work is cut into blocks of dimension size that meet in one
cogroup per block pair; a block pair emits one row of counts per query instead
of one row per candidate. For ranks, blocks are packed into one row each and stored once:
tasks read the pairs of some blocks (a product without a shuffle), so what is on disk
grows with the vectors and not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.vectors import cosine_distance, unit
from glossaria.operators.ids import scalar
from glossaria.sources.shared import materialize

DIGITS = 9
BLOCK_BYTES = 1 << 22  # of the vectors of a block
NEAREST_BYTES = 1 << 24  # and of a block when only the nearest are kept
QUERY_ROWS = 256  # queries of a block compared at a time
TASK_BLOCKS = 4  # packed blocks that a task reads on either side
STRIPES = 16  # candidates of a block in whose best ones the nearest are bounded


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Normalise once, before any pairing; rows without a vector are left out."""
    present = vectors.where(F.col("embedding").isNotNull())
    return present.select("model", "language", "sentence_id", unit(F.col("embedding")).alias("unit"))


def _listed_blocks(vectors: DataFrame, block_rows: int | None, block_bytes: int) -> Column:
    """Maps (model, language) -> number of blocks and model -> languages, as one value for all rows.

    Without ``block_rows`` the size follows from the width of the vectors.
    """
    width = F.greatest(F.max(F.size("embedding")), F.lit(1))
    rows = F.lit(block_rows) if block_rows else F.greatest(F.floor(F.lit(block_bytes // 8) / width), F.lit(1))
    sizes = vectors.where(F.col("embedding").isNotNull()).groupBy("model", "language").agg(
        F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("blocks")
    )
    by_model = sizes.groupBy("model").agg(
        F.collect_list(F.struct(F.struct("model", "language"), "blocks")).alias("entries"),
        F.collect_list(F.struct(F.col("language").alias("lang2"))).alias("languages"),
    )
    maps = F.struct(
        F.map_from_entries(F.flatten(F.collect_list("entries"))).alias("blocks"),
        F.map_from_entries(F.collect_list(F.struct("model", "languages"))).alias("languages"),
    )
    return scalar(by_model, maps)


def _blocks_of(listed: Column, language: str) -> Column:
    key = F.struct(F.col("model").alias("model"), F.col(language).alias("language"))
    return F.try_element_at(listed["blocks"], key)


def _translated(units: DataFrame) -> DataFrame:
    """Each vector with the list of languages that have its translation and the distance to it.

    The vectors of a sentence, one per language, meet in one row.
    """
    together = units.groupBy("model", "sentence_id").agg(F.collect_list(F.struct("language", "unit")).alias("v"))

    def targets(q: Column) -> Column:
        return F.transform(
            "v", lambda c: F.struct(c["language"].alias("lang2"), cosine_distance(q["unit"], c["unit"], DIGITS).alias("target"))
        )

    each = F.transform("v", lambda q: F.struct(q["language"].alias("language"), q["unit"].alias("unit"), targets(q).alias("targets")))
    return together.select("model", "sentence_id", F.inline(each))


def _block_pairs(vectors: DataFrame, block_rows: int | None, block_bytes: int = BLOCK_BYTES):
    """Query and candidate rows keyed by (model, lang1, block1, lang2, block2).

    The list of blocks is part of the expressions, so vectors are shuffled by the
    block key alone.
    """
    listed, units = _listed_blocks(vectors, block_rows, block_bytes), unit_vectors(vectors)
    partners = F.try_element_at(listed["languages"], F.col("model"))

    def numbered(rows: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("sentence_id"), _blocks_of(listed, "lang1")).cast("int")
        other = F.sequence(F.lit(0), _blocks_of(listed, "lang2") - 1)
        return rows.withColumn("block1", block).withColumn("block2", F.explode(other))

    queries = numbered(
        units.select("model", F.col("language").alias("lang1"), "sentence_id", "unit", F.inline(partners))
    )
    # the other side's keys swapped, under fresh names: both sides of a cogroup come from one table
    swapped = {"lang1": "lang2", "block1": "block2", "lang2": "lang1", "block2": "block1"}
    candidates = queries.select(*[F.col(c).alias(swapped.get(c, c)) for c in queries.columns])
    return queries, candidates


BLOCK_KEY = ["model", "lang1", "block1", "lang2", "block2"]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _distances(q: pd.DataFrame, c: pd.DataFrame):
    """Parts of the queries with their distances to all candidates."""
    other = _matrix(c["unit"]).T
    for start in range(0, len(q), QUERY_ROWS):
        part = q.iloc[start : start + QUERY_ROWS]
        yield part, np.round(np.clip(1.0 - _matrix(part["unit"]) @ other, 0.0, 2.0), DIGITS)


PACKED = "model string, language string, ids binary, known binary, unit binary, lang2 array<string>, place binary, target binary"


def _pack_block(block: pa.Table) -> pa.Table:
    """One row for the vectors of a block, with the distances of their translations by language."""
    ids = block.column("sentence_id").combine_chunks()
    unit = block.column("unit").combine_chunks().flatten().to_numpy()
    targets = block.column("targets").combine_chunks()
    place = np.repeat(np.arange(len(targets)), targets.value_lengths().to_numpy())
    flat = targets.flatten()
    packed = [ids.fill_null(0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False), unit.astype("<f8")]
    found = [place.astype("<i4"), flat.field("target").to_numpy().astype("<f8")]
    columns = [
        block.column("model")[:1], block.column("language")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in packed),
        pa.array([flat.field("lang2").to_pylist()], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in found),
    ]
    return pa.table(columns, names=["model", "language", "ids", "known", "unit", "lang2", "place", "target"])


def _vectors_of(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, known = (np.frombuffer(row[f"{side}{c}"].as_buffer(), t) for c, t in (("ids", "<i8"), ("known", bool)))
    return ids, known, np.frombuffer(row[f"{side}unit"].as_buffer(), "<f8").reshape(len(ids), -1)


def _count_pairs(batches):
    """Per query of a block and language: how many candidates of a block are closer than the translation or as close."""
    for batch in batches:
        for i in range(batch.num_rows):
            pair = {name: batch.column(name)[i] for name in batch.schema.names}
            model, lang1, lang2 = (pair[c].as_py() for c in ("q_model", "q_language", "c_language"))
            ids, known, queries = _vectors_of(pair, "q_")
            other_ids, other_known, others = _vectors_of(pair, "c_")
            named = pair["q_lang2"].values
            wanted = named.is_null() if lang2 is None else pc.fill_null(pc.equal(named, lang2), False)
            wanted = wanted.to_numpy(zero_copy_only=False)
            place, target = (np.frombuffer(pair[c].as_buffer(), t)[wanted] for c, t in (("q_place", "<i4"), ("q_target", "<f8")))
            if not len(place) or not len(other_ids):
                continue
            closer, tied, others = [], [], others.T
            for start in range(0, len(place), QUERY_ROWS):
                at, t = place[start : start + QUERY_ROWS], target[start : start + QUERY_ROWS, None]
                d = np.round(np.clip(1.0 - queries[at] @ others, 0.0, 2.0), DIGITS)
                rival = ids[at, None] != other_ids
                if not (known.all() and other_known.all()):
                    rival |= ~known[at, None] | ~other_known
                closer.append(((d < t) & rival).sum(axis=1))
                tied.append(((d == t) & rival).sum(axis=1))
            n = len(place)
            yield pa.record_batch(
                [
                    *(pa.array([x] * n, pa.string()) for x in (model, lang1, lang2)), pa.array(ids[place], mask=~known[place]),
                    pa.array(target), pa.array(np.concatenate(closer)), pa.array(np.concatenate(tied)),
                ],
                names=["model", "lang1", "lang2", "sentence_id", "target", "closer", "tied"],
            )


def retrieval_ranks(vectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Rank of the true translation among all sentences of the other language.

    Ties share the average rank: closer + (tied + 1) / 2, where the translation
    itself belongs to its tie group. No sort is involved.
    """
    listed = _listed_blocks(vectors, block_rows, BLOCK_BYTES)
    block = F.pmod(F.xxhash64("sentence_id"), _blocks_of(listed, "language")).cast("int").alias("block")
    numbered = _translated(unit_vectors(vectors)).select("model", "language", "sentence_id", "unit", "targets", block)
    packed = materialize(numbered.groupBy("model", "language", "block").applyInArrow(_pack_block, PACKED), "vector-blocks")
    tasks = max(1, -(-packed.count() // TASK_BLOCKS))
    queries = packed.select(*[F.col(c).alias(f"q_{c}") for c in packed.columns]).repartition(tasks)
    others = ["model", "language", "ids", "known", "unit"]
    candidates = packed.select(*[F.col(c).alias(f"c_{c}") for c in others]).repartition(tasks)
    pairs = queries.join(candidates.hint("shuffle_replicate_nl"), F.col("q_model").eqNullSafe(F.col("c_model")))
    counts = pairs.mapInArrow(
        _count_pairs, "model string, lang1 string, lang2 string, sentence_id long, target double, closer long, tied long"
    )
    totals = counts.groupBy("model", "lang1", "lang2", "sentence_id").agg(
        F.max("target").alias("distance"), F.sum("closer").alias("closer"), F.sum("tied").alias("tied")
    )
    rank = F.col("closer") + (F.col("tied") + F.lit(2)) / F.lit(2)
    return totals.select("model", "lang1", "lang2", "sentence_id", "distance", rank.alias("rank"))


def _nearest(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` nearest candidates of each query and their rounded distances, ties by place.

    ``near`` holds the cosines, queries by candidates. The ``k``-th best of the maxima of disjoint
    sets of candidates bounds the ``k``-th best cosine from below, so few distances are rounded and sorted.
    """
    n = near.shape[1]
    k, stripe = min(k, n), n // STRIPES
    if stripe >= k:
        best = np.fmax.reduce(near[:, : stripe * STRIPES].reshape(len(near), STRIPES, stripe), axis=1)
        best[np.isnan(best)] = -np.inf
        bound = np.partition(best, stripe - k, axis=1)[:, stripe - k, None] - 2 * 10.0**-DIGITS
        row, place = np.nonzero(~(near < bound))
    else:
        row, place = (x.ravel() for x in np.indices(near.shape))
    d = np.round(np.clip(1.0 - near[row, place], 0.0, 2.0), DIGITS)
    order = np.lexsort((d, row))  # stable: places ascend within a row
    first = np.searchsorted(row, np.arange(len(near)))[:, None] + np.arange(k)
    chosen = order[first]
    return place[chosen], d[chosen]


def nearest_candidates(
    vectors: DataFrame, k: int = 10, block_rows: int | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """The ``k`` nearest sentences of every language per query, ties by candidate id.

    A block pair sends at most ``k`` rows per query; the best of all blocks remain.
    ``asked`` (model, language, sentence_id) limits the queries, never the candidates.
    """
    columns = ["model", "lang1", "lang2", "sentence_id", "candidate_id", "distance"]

    def nearest(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame(columns=columns)
        model, lang1, _, lang2, _ = key
        c = c.sort_values("sentence_id")
        ids, found, distance = c["sentence_id"].to_numpy(), [], []
        other = _matrix(c["unit"]).T
        for start in range(0, len(q), QUERY_ROWS):
            best, d = _nearest(_matrix(q["unit"].iloc[start : start + QUERY_ROWS]) @ other, k)
            found.append(ids[best].ravel())
            distance.append(d.ravel())
        return pd.DataFrame(
            {
                "model": model, "lang1": lang1, "lang2": lang2,
                "sentence_id": np.repeat(q["sentence_id"].to_numpy(), min(k, len(c))),
                "candidate_id": np.concatenate(found), "distance": np.concatenate(distance),
            }
        )[columns]

    queries, candidates = _block_pairs(vectors, block_rows, block_bytes=NEAREST_BYTES)
    if asked is not None:
        wanted = asked.select("model", F.col("language").alias("lang1"), "sentence_id")
        queries = queries.join(wanted, ["model", "lang1", "sentence_id"], "left_semi").select(*candidates.columns)
    parts = (
        queries.groupBy(*BLOCK_KEY)
        .cogroup(candidates.groupBy(*BLOCK_KEY))
        .applyInPandas(
            nearest,
            "model string, lang1 string, lang2 string, sentence_id long, candidate_id long, distance double",
        )
    )
    order = Window.partitionBy("model", "lang1", "lang2", "sentence_id").orderBy("distance", "candidate_id")
    return parts.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= k)


def similarity_search_summary(ranks: DataFrame, digits: int = 6) -> DataFrame:
    """Mean and sample deviation of the rank, and mean reciprocal rank."""
    return ranks.groupBy("model", "lang1", "lang2").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg("rank"), digits).alias("avg_rank"),
        F.round(F.stddev_samp("rank"), digits).alias("std_rank"),
        F.round(F.avg(F.lit(1.0) / F.col("rank")), digits).alias("mrr"),
    )


def mrr_pairwise(ranks: DataFrame, digits: int = 6) -> DataFrame:
    """Mean reciprocal rank of lang1 -> lang2."""
    return ranks.groupBy("model", "lang1", "lang2").agg(
        F.round(F.avg(F.lit(1.0) / F.col("rank")), digits).alias("mrr")
    )


def _summarise_block(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    columns = ["model", "lang1", "lang2", "sentence_id", "n", "nearest", "farthest", "total"]
    if not len(q) or not len(c):
        return pd.DataFrame(columns=columns)
    model, lang1, _, lang2, _ = key
    stats = [
        (d.min(axis=1), d.max(axis=1), np.rint(d * 10**DIGITS).astype(np.int64).sum(axis=1)) for _, d in _distances(q, c)
    ]
    nearest, farthest, total = (np.concatenate(x) for x in zip(*stats))
    return pd.DataFrame(
        {
            "model": model, "lang1": lang1, "lang2": lang2, "sentence_id": q["sentence_id"].to_numpy(),
            "n": len(c), "nearest": nearest, "farthest": farthest, "total": total,
        }
    )[columns]


def cosine_distance_profile(vectors: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Per query and other language: nearest, farthest and mean distance to all candidates.

    Rounded distances are added as integers, so the mean (cut to 9 digits) does
    not depend on the order of the blocks.
    """
    queries, candidates = _block_pairs(vectors, block_rows)
    parts = (
        queries.groupBy(*BLOCK_KEY)
        .cogroup(candidates.groupBy(*BLOCK_KEY))
        .applyInPandas(
            _summarise_block,
            "model string, lang1 string, lang2 string, sentence_id long, n long, nearest double, "
            "farthest double, total long",
        )
    )
    return parts.groupBy("model", "lang1", "lang2", "sentence_id").agg(
        F.sum("n").alias("n_candidates"),
        F.min("nearest").alias("nearest"),
        F.max("farthest").alias("farthest"),
        F.sum("total").alias("total"),
    ).select(
        "model", "lang1", "lang2", "sentence_id", "n_candidates", "nearest", "farthest",
        (F.expr("total DIV n_candidates") / F.lit(float(10**DIGITS))).alias("mean_distance"),
    )


def _list_block(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    columns = ["model", "lang1", "lang2", "sentence_id", "candidate_id", "distance"]
    if not len(q) or not len(c):
        return pd.DataFrame(columns=columns)
    d = np.concatenate([d for _, d in _distances(q, c)])
    model, lang1, _, lang2, _ = key
    return pd.DataFrame(
        {
            "model": model, "lang1": lang1, "lang2": lang2,
            "sentence_id": np.repeat(q["sentence_id"].to_numpy(), len(c)),
            "candidate_id": np.tile(c["sentence_id"].to_numpy(), len(q)), "distance": d.ravel(),
        }
    )[columns]


def cosine_distances(vectors: DataFrame, lang1: str, lang2: str, block_rows: int = 512) -> DataFrame:
    """The full distance matrix of one language pair in long form.

    One row per (query, candidate), as large as the matrix itself; use the
    summaries above unless every cell is wanted.
    """
    both = vectors.where(F.col("language").isin(lang1, lang2))
    queries, candidates = _block_pairs(both, block_rows)
    wanted = (F.col("lang1") == lang1) & (F.col("lang2") == lang2)
    return (
        queries.where(wanted).groupBy(*BLOCK_KEY)
        .cogroup(candidates.where(wanted).groupBy(*BLOCK_KEY))
        .applyInPandas(
            _list_block,
            "model string, lang1 string, lang2 string, sentence_id long, candidate_id long, distance double",
        )
    )


def all_ranks(distances: DataFrame, bins: int = 4096) -> DataFrame:
    """Average-tie rank of every candidate of every query.

    A query may have any number of candidates, so they are not sorted in one
    task. Equal distances are counted first; distinct distances fall into
    ``bins`` equal ranges of [0, 2], and a rank is the count in lower bins plus
    the count within the bin. A bin holds at most 2 * 10**9 / bins distinct
    rounded distances.
    """
    query = ["model", "lang1", "lang2", "sentence_id"]
    ties = distances.groupBy(*query, "distance").agg(F.count(F.lit(1)).alias("n"))
    ties = ties.withColumn("bin", F.floor(F.col("distance") * F.lit(bins / 2)).cast("int"))
    lower = Window.partitionBy(*query).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ties.groupBy(*query, "bin").agg(F.sum("n").alias("__n"))
        .withColumn("offset", F.coalesce(F.sum("__n").over(lower), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*query, "bin").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = (
        ties.withColumn("before", before)
        .join(offsets, [*query, "bin"])
        .withColumn("rank", F.col("offset") + F.col("before") + (F.col("n") + 1) / F.lit(2))
        .select(*query, "distance", "rank")
    )
    return distances.join(ranked, [*query, "distance"])
