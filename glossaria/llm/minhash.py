"""Near-duplicates by DartMinHash signatures and banded joins.

A text is a weighted set of five-word shingles, a shingle's weight is its
count. Darts: every unit of weight of every shingle is a strip on which a
Poisson process, drawn from the hash of the strip, throws darts along the rank
axis. A text reads the darts of its strips up to the rank at which it expects
``DARTS`` of them; each dart hashes to one of ``BANDS * ROWS`` coordinates, and
the earliest per coordinate is kept (texts with an empty coordinate read
further). Two texts share a coordinate's dart with the probability of their
weighted Jaccard similarity.

Bands of ``ROWS`` coordinates give buckets. Texts of similarity 0.8 share at
least one of 25 bands of 5 with probability 0.99995.

* Equal texts are one node, known by a digest.
* In ``HUB_ROUNDS`` rounds, the nodes of a bucket are compared with one of
  them, its hub: the node with the most links so far, ties broken by a hash of
  bucket and node. After each round links give connected components. Only the
  hub leaves the bucket, since it was compared with all others there; a bucket
  is settled once all its nodes are in one component. Nodes in the component of
  their hub are not compared with it, so groups of copies are settled with rows
  linear in the bucket, and joins split hot keys.
* In each bucket that is not settled, the nodes outside of its largest
  component are compared with all of its nodes of other components, in blocks
  of about ``BLOCK`` nodes, a pair of blocks at a time, in the tasks; only
  links come back. No bucket is too large: it has more blocks.
* Comparisons are exact: weighted Jaccard similarity of the shingles, at least
  ``SIMILARITY``. Components come from iterated minima.

Each row gets the class of its node: the least id in the component.

Null text is empty text. All texts without words are equal to each other only
if they are the same text. Texts of fewer than five words have one shingle. A
null id takes part; a class without any id has a null class id. Repeated rows
are copies. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.llm.common import WordHashes, hash_words, map_texts, mix, poly, shingle_hashes, similarity_of
from glossaria.sources.shared import materialize

WORD = re.compile(r"[^\W_]+")
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
WIDTH = BANDS * ROWS
DARTS = WIDTH * (math.log(WIDTH) + 2)
HUB_ROUNDS, BLOCK = 2, 256
STEP, THROW = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def strips(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One id per unit of weight: the n-th occurrence of a shingle in a text is strip n of the shingle."""
    key = mix(hashes + doc.astype(np.uint64) * STEP)
    order = np.argsort(key)
    ordered = key[order]
    again = np.zeros(len(key), bool)
    again[1:] = ordered[1:] == ordered[:-1]
    if again.any():
        place = np.arange(len(key))
        nth = np.zeros(len(key), np.uint64)
        nth[order] = place - np.maximum.accumulate(np.where(again, 0, place))
        hashes = hashes + nth * STEP
    return mix(hashes), doc


def signatures(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix (texts x WIDTH) of dart ids, and which texts have one."""
    out, done = np.zeros((n, WIDTH), np.uint64), np.zeros(n, bool)
    if not len(hashes):
        return out, done
    strip, owner = strips(hashes, doc)
    reach = DARTS / np.maximum(np.bincount(owner, minlength=n), 1)
    present = np.bincount(owner, minlength=n) > 0
    while len(strip):
        at, rank = np.arange(len(strip)), np.zeros(len(strip))
        ids, ranks, cells, throw = [], [], [], np.zeros(1, np.uint64)
        while len(at):
            throw = throw + THROW
            dart = mix(strip[at] + throw)
            rank = rank - np.log(((mix(dart) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))
            near = rank <= reach[owner[at]]
            at, rank, dart = at[near], rank[near], dart[near]
            ids.append(dart)
            ranks.append(rank)
            cells.append(owner[at] * WIDTH + (dart % np.uint64(WIDTH)).astype(np.int64))
        ids, ranks, cells = np.concatenate(ids), np.concatenate(ranks), np.concatenate(cells)
        earliest = np.full(n * WIDTH, np.inf)
        np.minimum.at(earliest, cells, ranks)
        first = ranks == earliest[cells]
        own = np.zeros(n * WIDTH, np.uint64)
        own[cells[first]] = ids[first]
        full = np.isfinite(earliest).reshape(n, WIDTH).all(axis=1) & present & ~done
        out[full] = own.reshape(n, WIDTH)[full]
        done |= full
        rest = ~done[owner]
        strip, owner = strip[rest], owner[rest]
        reach = reach * 2
    return out, done


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Bucket keys (texts x BANDS)."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    return np.stack([poly([parts[:, b, r] for r in range(ROWS)], 1000 * b) for b in range(BANDS)], axis=1)


def sketcher():
    """Function from texts to their bucket keys."""
    known = WordHashes()

    def keys(texts: list[str]):
        words, counts = hash_words(texts, WORD, known)
        hashes, doc, _ = shingle_hashes(words, counts, SHINGLE)
        signature, present = signatures(hashes, doc, len(texts))
        found = band_keys(signature).astype(np.int64)
        lengths = np.where(present, BANDS, 0)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return (pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[present].reshape(-1))),)

    return keys


def shingle_counts(text: str, known: WordHashes) -> Counter:
    words, counts = hash_words([text], WORD, known)
    return Counter(shingle_hashes(words, counts, SHINGLE)[0].tolist())


def comparer(left: str, right: str):
    """Arrow function: similarity of the texts of each pair; equal left texts in a row are read once."""

    def run(batches):
        known, last, own = WordHashes(), None, Counter()
        for batch in batches:
            values = []
            for a, b in zip(batch.column(left).to_pylist(), batch.column(right).to_pylist()):
                if a != last:
                    last, own = a, shingle_counts(a, known)
                values.append(similarity_of(shingle_counts(b, known), own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("hub"), batch.column("node"), pa.array(values, pa.float64())], names=["hub", "node", "similarity"]
            )

    return run


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, node) -> with ``similarity``."""
    right = pairs.join(texts.select(F.col("node"), F.col("body").alias("right")), "node")
    both = right.join(texts.select(F.col("node").alias("hub"), F.col("body").alias("left")), "hub")
    return both.select("hub", "node", "left", "right").mapInArrow(
        comparer("left", "right"), "hub binary, node binary, similarity double"
    )


def components(links: DataFrame) -> DataFrame:
    """(hub, node) links -> (node, label), the least node of each component; nodes without links are absent."""
    both = links.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    edges = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("label").alias("other")), "b")
        near = near.groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near, "a").select("a", "label", F.least("label", "other").alias("low"))
        jump = labels.select(F.col("a").alias("low"), F.col("label").alias("far"))
        step = step.join(jump, "low").select("a", "label", F.least("low", "far").alias("new"))
        step = materialize(step, "labels")
        if step.where("new != label").isEmpty():
            return labels.select(F.col("a").alias("node"), "label")
        labels = step.select("a", F.col("new").alias("label"))


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def sketches(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Per row: ``id``, ``node`` (digest of the text) and its bucket ``keys``."""
    bodies = docs.select(F.col(id_column).alias("id"), digest(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    keys = map_texts(bodies, "body", T.StructType().add("keys", T.ArrayType(T.LongType())), sketcher)
    return materialize(keys.select("id", "node", "keys"), "sketches")


def candidate_texts(docs: DataFrame, rows: DataFrame, nodes: DataFrame, id_column: str, text: str) -> DataFrame:
    """(node, body) of the given nodes, each from its row with the least id, so copies are not moved."""
    first = rows.groupBy("node").agg(F.min("id").alias("first")).withColumnRenamed("node", "of")
    first = first.join(nodes.withColumnRenamed("node", "wanted"), F.col("of") == F.col("wanted"), "left_semi")
    bodies = docs.select(F.col(id_column).alias("id"), digest(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    bodies = bodies.join(first, F.col("id").eqNullSafe(F.col("first")) & F.col("node").eqNullSafe(F.col("of")), "left_semi")
    return materialize(bodies.dropDuplicates(["id", "node"]).select("node", "body"), "candidates")


def overlaps(texts: list[str], known: WordHashes) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of a bounded list of texts."""
    words, counts = hash_words(texts, WORD, known)
    hashes, doc, _ = shingle_hashes(words, counts, SHINGLE)
    units, owner = strips(hashes, doc)
    _, column, seen = np.unique(units, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner_shared, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner_shared, column = owner_shared[order], column[order]
    both, width = np.zeros((len(texts), len(texts)), np.float32), 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        some = slice(*np.searchsorted(column, [start, start + width]))
        part = np.zeros((len(texts), width), np.float32)
        part[owner_shared[some], column[some] - start] = 1
        both += part @ part.T
    size = np.bincount(owner, minlength=len(texts)).astype(np.float32)
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def block_comparer(similarity: float):
    """Arrow function: links between the blocks of one pair of blocks."""

    def run(rows):
        rows, pairs = rows.sort_by("node"), []
        node, block = rows.column("node").to_pylist(), np.array(rows.column("block").to_pylist())
        label = rows.column("label").to_pylist()
        if len(set(label)) > 1:
            near = np.triu(overlaps(rows.column("body").to_pylist(), WordHashes()) >= similarity, 1)
            if block.min() != block.max():
                near &= block[:, None] != block[None, :]
            pairs = [(node[i], node[j]) for i, j in np.argwhere(near) if label[i] != label[j]]
        return pa.table({"hub": pa.array([p[0] for p in pairs], pa.binary()), "node": pa.array([p[1] for p in pairs], pa.binary())})

    return run


def block_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (hub, node) among the nodes of different components of each bucket; ``members`` come from ``unsettled``."""
    of = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    rows = members.select(
        "key", "node", "label", (F.col("label") == F.col("main.label")).alias("inside"),
        of(F.col("n") - F.col("main.n")).alias("outer"), of(F.col("main.n")).alias("inner"),
    )
    dealt = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("inside"), F.col("outer")).otherwise(0) + dealt)
    last = F.col("outer") + F.when(F.col("inside"), 0).otherwise(F.col("inner")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("key", "node", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return rows.join(texts, "node").groupBy("key", "low", "high").applyInArrow(block_comparer(similarity), "hub binary, node binary")


def unsettled(state: DataFrame) -> DataFrame:
    """Rows (key, node, label, links) of the buckets with several components, with their ``lead`` (next hub and its
    label), number of nodes ``n`` and largest component ``main``."""
    order = F.struct("links", F.xxhash64("key", "node").alias("draw"), "node", "label")
    parts = state.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("lead"))
    buckets = parts.groupBy("key").agg(
        F.max("lead").alias("lead"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")
    )
    return state.join(buckets.where("n > main.n"), "key")


def link(docs: DataFrame, rows: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame | None:
    """Components (node, label) of the nodes that are similar to others; ``rows`` are the sketches of ``docs``."""
    members = rows.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = materialize(members.join(shared, "key"), "members")
    if members.isEmpty():
        return None
    texts = candidate_texts(docs, rows, members.select("node").distinct(), id_column, text)
    state = members.withColumns({"links": F.lit(0).cast("bigint"), "label": F.col("node")})
    found = None
    for _ in range(HUB_ROUNDS):
        state = unsettled(state).select("key", "node", "label", F.col("lead.node").alias("hub"), F.col("lead.label").alias("hub_label"))
        state = materialize(state, "members")
        pairs = state.where("node != hub and label != hub_label").select("hub", "node").distinct()
        if found is not None:
            pairs = pairs.join(found, ["hub", "node"], "left_anti")
        fresh = compare(pairs, texts)
        found = materialize(fresh if found is None else found.unionByName(fresh), "compared")
        links = found.where(F.col("similarity") >= similarity).select("hub", "node")
        labels = labelled(links)
        state = with_labels(state.where("node != hub").select("key", "node"), labels)
    rest = materialize(unsettled(state).select("key", "node", "label", "n", "main"), "members")
    if rest.isEmpty():
        return labels.select("node", "label")
    more = materialize(block_links(rest, texts, similarity), "links").distinct()
    return labelled(links.unionByName(more)).select("node", "label")


def labelled(links: DataFrame) -> DataFrame:
    """(node, label, links): component and number of links of the nodes that have any."""
    ends = links.select("node").unionByName(links.select(F.col("hub").alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return materialize(components(links).join(degrees, "node"), "labels")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace ``label`` and ``links`` of the rows' nodes; a node without links is its own component."""
    known = labels.select("node", F.col("label").alias("own"), F.col("links").alias("degree"))
    rows = rows.drop("label", "links").join(known, "node", "left")
    return rows.withColumns({"label": F.coalesce("own", "node"), "links": F.coalesce("degree", F.lit(0))}).drop("own", "degree")


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: id, ``node`` (digest of its text), ``class_node`` and ``class_id``."""
    rows = sketches(docs, id_column, text)
    labels = link(docs, rows, id_column, text, similarity)
    rows = rows.select(F.col("id").alias(id_column), "node")
    if labels is None:
        rows = rows.withColumn("class_node", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("class_node", F.coalesce("label", "node")).drop("label")
    rows = materialize(rows, "classes")
    least = rows.groupBy("class_node").agg(F.min(id_column).alias("class_id"))
    return rows.join(least, "class_node").select(id_column, "node", "class_node", "class_id")


def representatives(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that of the least id, with all its columns."""
    own = classes(docs, id_column, text, similarity)
    first = F.min(F.struct(F.col(id_column).isNull().alias("last"), F.col(id_column).alias("id"), F.col("node").alias("text")))
    kept = own.groupBy("class_node").agg(first.alias("__k")).select(F.col("__k.id").alias("__id"), F.col("__k.text").alias("__node"))
    names = docs.columns
    rows = docs.withColumn("__own", digest(text))
    rows = rows.join(kept, F.col(id_column).eqNullSafe(F.col("__id")) & F.col("__own").eqNullSafe(F.col("__node")), "left_semi")
    return rows.dropDuplicates([id_column, "__own"]).select(*names)
