"""Benchmark items inside documents, by SimHash windows and multi-index Hamming blocks.

Texts are sequences of lower-case words. An item is found where a window of its
number of words (the whole document, if that is shorter) has a weighted Jaccard
similarity of five-word shingles of at least ``similarity`` with it (weights are
counts; a text of fewer than five words has one shingle of all its words).

1. Windows. A similar window may differ from the item at its edges, and in as many
   places inside as the lost shingles allow. What lies between the edges is cut into
   one more part than there may be such places, so one part at least is whole in
   every similar window (``parts_of``). Windows as long as the parts, of which there
   are few lengths, get a 64-bit SimHash at every word of every document, of the runs
   of ``RUN`` words in them: each counts as often as it occurs.
2. Blocks. A fingerprint has ``BLOCKS`` blocks of bits. The index lists for each block
   all values that differ from a part's in at most ``FLIPS`` bits, so two fingerprints
   that differ in at most ``RADIUS`` bits meet in one block at least. Index and windows
   are tables, joined by (length, block, value). So that not every window of the corpus
   is sent to that join, tasks hold a screen of the index: bit arrays of bounded size
   (``SCREEN_BITS``, whatever the benchmark's size) that drop most windows of which no
   block is listed, and none that is.
3. Check. For pairs within the radius, all windows of the item's length around the
   part are compared exactly, and the best one per document and item is returned.

Neither documents nor benchmark pass through the driver; it sees the lengths of
windows and the screen. Items with the same words are one in the index.

Null and empty texts match nothing, nor do items without words. Items with the
same words match alike and are all returned. Repeated rows are searched one by
one. Other columns pass through; a column named ``leaks`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.llm.common import WordHashes, hash_words, mix, poly, shingle_hashes, slices
from glossaria.sources.shared import materialize

WORD = re.compile(r"[^\W_]+")
SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, FLIPS = 2, 2
BLOCK_BITS = 64 // BLOCKS
RADIUS = BLOCKS * (FLIPS + 1) - 1
SCREENS, SCREEN_BITS, SCREEN_SHARE = 3, 26, 64  # bit arrays of at most 2**26 bits, one in 64 set if that is enough
BITMAP = 1 << 15  # bits of one row of a screen
CHUNK = 1 << 13  # words whose windows are computed at a time
RUN = 3  # words of a feature; single words would make the windows of a language alike
MASK = np.uint64((1 << BLOCK_BITS) - 1)
FACTORS = mix(np.arange(1, SCREENS + 1, dtype=np.uint64)) | np.uint64(1)


def length_below(n: int) -> int:
    """The longest window length up to ``n``: all small numbers, then steps of a third."""
    length = 8
    while length <= n:
        best, length = length, length + length // 3
    return n if n < 8 else best


def parts_of(n: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(first word, length) of the parts of an item of ``n`` words, one of which each similar window holds whole.

    A window that lost ``k`` words at an edge, or a document that ends there, has
    lost as many shingles, so ``k <= (1 - similarity) * shingles``. A change inside
    costs four shingles at least, and as many new ones that count against it.
    """
    if n < SHINGLE:
        return [(0, n)] if n else []
    shingles = n - SHINGLE + 1
    edge = int((1 - similarity) * shingles + 1e-9)
    core = n - 2 * edge
    places = int(shingles * (1 - similarity) / ((SHINGLE - 1) * (1 + similarity)) + 1e-9)
    own = core // min(places + 1, core)
    length = length_below(own)
    return [(edge + at * own + (own - length) // 2, length) for at in range(min(places + 1, core))]


def run_of(length: int) -> int:
    """Words of a feature in windows of a length."""
    return min(RUN, length)


def features(words: np.ndarray, run: int) -> np.ndarray:
    """Hashes of the runs of ``run`` words that begin at each word but the last ones."""
    n = max(0, len(words) - run + 1)
    return mix(poly([words[k : k + n] for k in range(run)]))


def bit_sums(hashes: np.ndarray, length: int) -> np.ndarray:
    """Running sums of the hashes' bits, cut to as many bits as tell the sums of windows of up to ``length`` apart."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(hashes) + 1, 64), np.uint8 if length < 256 else np.uint32)
    np.cumsum(bits, axis=0, dtype=sums.dtype, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every ``n`` features in a row; a bit is set if more than half of them have it."""
    ones = (sums[n:] - sums[:-n]) > sums.dtype.type(n // 2)
    return np.packbits(ones, axis=1).view(">u8")[:, 0].astype(np.uint64)


def window_fingerprints(words: np.ndarray, length: int) -> np.ndarray:
    """SimHash of every window of ``length`` words."""
    run = run_of(length)
    return fingerprints(bit_sums(features(words, run), length), length - run + 1)


def block_values(prints: np.ndarray) -> list[np.ndarray]:
    """The value of each block of the fingerprints."""
    return [(prints >> np.uint64(b * BLOCK_BITS)) & MASK for b in range(BLOCKS)]


FLIPPED = np.array(
    [sum(1 << bit for bit in bits) for n in range(FLIPS + 1) for bits in combinations(range(BLOCK_BITS), n)], np.uint64
)


def screen_places(length: int, block: int, values: np.ndarray, bits: int, screen: int) -> np.ndarray:
    """The place of each value in a screen."""
    salt = np.uint64(((length * BLOCKS + block) * SCREENS + screen + 1) << BLOCK_BITS)
    return ((values ^ salt) * FACTORS[screen]) >> np.uint64(64 - bits)


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Shingle hashes of one sequence of words, in order."""
    return shingle_hashes(words, np.array([len(words)]), SHINGLE)[0]


def best_window(words: np.ndarray, item: np.ndarray, part: int, length: int) -> tuple[float, int, int]:
    """Similarity, first word and number of words of the window most similar to the item, with the part in it.

    ``words`` surround the part, which begins at word ``part``; they end where the
    document does. Of equally similar windows it is the first.
    """
    wanted, n = Counter(shingles_of(item).tolist()), len(item)
    span, total = min(n, len(words)), sum(wanted.values())
    first, last = max(0, part + length - span), min(part, len(words) - span)
    if span < SHINGLE:
        shared = [sum((Counter(shingles_of(words[at : at + span]).tolist()) & wanted).values()) for at in range(first, last + 1)]
        size = 1
    else:
        hashes, size = shingles_of(words).tolist(), span - SHINGLE + 1
        counts, both, shared = Counter(hashes[first : first + size]), 0, []
        both = sum((counts & wanted).values())
        shared.append(both)
        for at in range(first, last):
            gone, new = hashes[at], hashes[at + size]
            both -= counts[gone] <= wanted[gone]
            counts[gone] -= 1
            both += counts[new] < wanted[new]
            counts[new] += 1
            shared.append(both)
    most = max(shared)
    return most / (size + total - most), first + shared.index(most), span


def read_items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``(id, words)``: hashes of the items' words; items without words are left out."""
    schema = T.StructType([T.StructField("id", benchmark.schema[item_id].dataType), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for some in slices(batch, "text"):
                words, counts = hash_words([t or "" for t in some.column("text").to_pylist()], WORD, known)
                ends = np.cumsum(counts)
                rows = [words[e - n : e].tobytes() for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(rows, pa.binary())], names=schema.names)

    rows = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    return rows.mapInArrow(run, schema).where(F.length("words") > 0)


INDEX = "item long, size int, length int, part int, print long, block int, value long, places array<long>"


def index_of(items: DataFrame, similarity: float, bits: int) -> DataFrame:
    """One row per item, part, block and value within ``FLIPS`` bits, with the value's places in the screens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            for key, packed in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                words = np.frombuffer(packed, np.uint64)
                for part, length in parts_of(len(words), similarity):
                    own = window_fingerprints(words[part : part + length], length)
                    for block, value in enumerate(block_values(own)):
                        values = FLIPPED ^ value[0]
                        places = np.stack([screen_places(length, block, values, bits, k) for k in range(SCREENS)], axis=1).astype(np.int64)
                        n = len(values)
                        columns = [pa.array(np.full(n, x, t)) for x, t in ((key, "i8"), (len(words), "i4"), (length, "i4"), (part, "i4"))]
                        columns += [pa.array(np.full(n, own.view(np.int64)[0])), pa.array(np.full(n, block, "i4")), pa.array(values.astype(np.int64))]
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, places.size + 1, SCREENS), pa.int32()), pa.array(places.ravel())))
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return items.mapInArrow(run, INDEX)


def read_screens(index: DataFrame, bits: int) -> list[np.ndarray]:
    """The screens as bytes; at most ``SCREENS * 2**SCREEN_BITS`` bits reach the driver."""
    place = F.posexplode("places").alias("screen", "place")
    rows = index.select(place).select("screen", F.expr(f"place DIV {BITMAP}").alias("row"), (F.col("place") % BITMAP).alias("bit"))
    screens = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(SCREENS)]
    for r in rows.groupBy("screen", "row").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect():
        own = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        at = r["row"] * BITMAP // 8
        part = screens[r["screen"]][at : at + len(own)]
        part |= own[: len(part)]
    return screens


WINDOWS = "key long, length int, print long, passed int, part int, first int, words binary, starts binary, ends binary"


def windows_of(keyed: DataFrame, text: str, longest: dict[int, int], screens: list[np.ndarray], bits: int) -> DataFrame:
    """Windows that pass the screens, with the words around them and these words' offsets.

    ``longest`` has the largest item for each length of a window. ``part`` is the
    window's place among the words, ``first`` the first word's place in the document.
    """

    def passing(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, first words, fingerprints and passed blocks (as bits) of the windows."""
        reach = max(longest)
        runs = sorted({run_of(length) for length in longest})
        for start in range(0, len(words), CHUNK):
            some = words[start : start + CHUNK + reach - 1]
            sums = {run: bit_sums(features(some, run), reach) for run in runs}
            for length in longest:
                n, run = min(CHUNK, len(some) - length + 1), run_of(length)
                if n <= 0:
                    continue
                whole = np.flatnonzero(doc[start : start + n] == doc[start + length - 1 : start + length - 1 + n])
                prints = fingerprints(sums[run][: n + length - run + 1], length - run + 1)[whole]
                passed = np.zeros(len(prints), np.int32)
                for block, values in enumerate(block_values(prints)):
                    at = np.arange(len(prints))
                    for screen in range(SCREENS):
                        place = screen_places(length, block, values[at], bits, screen)
                        at = at[(screens[screen][place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                    passed[at] |= 1 << block
                kept = np.flatnonzero(passed)
                yield length, whole[kept] + start, prints[kept], passed[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = WordHashes(), [c.split()[0] for c in WINDOWS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for some in slices(batch, "text"):
                keys, texts = some.column("key").to_pylist(), [t or "" for t in some.column("text").to_pylist()]
                words, counts = hash_words(texts, WORD, known)
                if not len(words):
                    continue
                doc, ends = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts)
                rows, spans, seen = [], {}, set()
                for length, places, prints, passed in passing(words, doc):
                    for at, print_, blocks in zip(places.tolist(), prints.view(np.int64).tolist(), passed.tolist()):
                        d = int(doc[at])
                        if length < SHINGLE:  # such windows match as a whole, the first one will do
                            if (d, length, print_) in seen:
                                continue
                            seen.add((d, length, print_))
                        begin = int(ends[d] - counts[d])
                        lo, hi = max(begin, at + length - longest[length]), min(int(ends[d]), at + longest[length])
                        if d not in spans:
                            spans[d] = np.array([m.span() for m in WORD.finditer(texts[d])], np.int32)
                        own = spans[d][lo - begin : hi - begin]
                        starts, stops = np.ascontiguousarray(own[:, 0]).tobytes(), np.ascontiguousarray(own[:, 1]).tobytes()
                        rows.append((keys[d], length, print_, blocks, at - lo, lo - begin, words[lo:hi].tobytes(), starts, stops))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return keyed.select("key", F.col(text).alias("text")).mapInArrow(run, WINDOWS)


FOUND = "key long, item long, similarity double, first int, start int, end int"


def checked(pairs: DataFrame, similarity: float) -> DataFrame:
    """The most similar window of each pair of a window and an item, if it is similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            rows, columns = [], {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for k in range(batch.num_rows):
                words, item = (np.frombuffer(columns[c][k], np.uint64) for c in ("words", "item_words"))
                s, at, span = best_window(words, item, columns["part"][k], columns["length"][k])
                if s >= similarity:
                    starts, ends = (np.frombuffer(columns[c][k], np.int32) for c in ("starts", "ends"))
                    first = columns["first"][k] + at
                    rows.append((columns["key"][k], columns["item"][k], s, first, int(starts[at]), int(ends[at + span - 1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return pairs.mapInArrow(run, FOUND)


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Append ``leaks``: array of (item_id, similarity, start, end), offsets in characters."""
    entry = T.StructType().add("item_id", benchmark.schema[item_id].dataType).add("similarity", T.DoubleType())
    entry = entry.add("start", T.IntegerType()).add("end", T.IntegerType())
    docs, none = docs.drop("leaks"), F.array().cast(T.ArrayType(entry))
    ids = materialize(read_items(benchmark, item_id, item_text), "items")
    items = materialize(ids.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "item-words")
    size = items.groupBy((F.length("words") / 8).cast("int").alias("n")).count().collect()  # one row per length of an item
    parts = [(n, c, part) for n, c in size for part in parts_of(n, similarity)]
    if not parts:
        return docs.withColumn("leaks", none)
    longest = {}
    for n, _, (_, length) in parts:
        longest[length] = max(n, longest.get(length, 0))
    entries = sum(c for _, c, _ in parts) * BLOCKS * len(FLIPPED)
    bits = min(SCREEN_BITS, max(15, (entries * SCREEN_SHARE - 1).bit_length()))
    index = materialize(index_of(items, similarity, bits), "window-index")
    screens = read_screens(index, bits)

    renamed = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.withColumnsRenamed(renamed).withColumn("key", F.monotonically_increasing_id())
    keyed = materialize(keyed, "documents")
    windows = materialize(windows_of(keyed, renamed[text], longest, screens, bits), "windows")
    low = (1 << BLOCK_BITS) - 1
    block = lambda b: F.shiftrightunsigned("print", b * BLOCK_BITS).bitwiseAND(F.lit(low))
    values = F.posexplode(F.array(*[block(b) for b in range(BLOCKS)])).alias("block", "value")
    listed = index.select("item", F.col("length").alias("of"), F.col("print").alias("own"), F.col("block").alias("of_block"), F.col("value").alias("of_value"))
    same = (F.col("length") == F.col("of")) & (F.col("block") == F.col("of_block")) & (F.col("value") == F.col("of_value"))
    listing = F.expr("shiftright(passed, block) & 1 = 1")
    met = windows.select("*", values).where(listing).join(listed, same)
    # of the blocks that two fingerprints meet in, the first counts
    apart = F.col("print").bitwiseXOR(F.col("own"))
    met = met.where(F.bit_count(apart) <= RADIUS)
    for b in range(BLOCKS - 1):
        before = F.bit_count(F.shiftrightunsigned(apart, b * BLOCK_BITS).bitwiseAND(F.lit(low))) <= FLIPS
        met = met.where((F.col("block") <= b) | ~before)
    wanted = items.select(F.col("item").alias("number"), F.col("words").alias("item_words"))
    pairs = met.join(wanted, F.col("item") == F.col("number"))
    found = checked(pairs.select("key", "length", "part", "first", "words", "starts", "ends", "item", "item_words"), similarity)
    order = F.struct("similarity", (-F.col("first")).alias("first"))
    best = found.groupBy("key", "item").agg(F.max_by(F.struct("similarity", "start", "end"), order).alias("best"))
    named = best.join(items, "item").join(ids, "words").select("key", F.struct(F.col("id").alias("item_id"), "best.similarity", "best.start", "best.end").alias("leak"))
    leaks = named.groupBy(F.col("key").alias("of")).agg(F.sort_array(F.collect_list("leak")).alias("leaks"))
    back = {v: k for k, v in renamed.items()}
    joined = keyed.join(materialize(leaks, "leaks"), F.col("key") == F.col("of"), "left")
    return joined.select(*[F.col(c).alias(back[c]) for c in renamed.values()], F.coalesce("leaks", none).alias("leaks"))
