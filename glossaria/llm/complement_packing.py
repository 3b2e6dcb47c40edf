"""Best-fit packing of tokenized documents with exact complements.

Only documents longer than a sequence are cut; their first piece takes what
whole sequences leave over. How the pieces go together depends on nothing but
how many there are of each length, and there are at most ``max_tokens`` lengths.
So Spark counts the pieces by length, the driver plans over that bounded table,
and every piece finds its place by its rank among the pieces of its length:

* ``plan``: lengths that sum up to a gap are indexed by their sum, as single
  lengths, pairs and triples. Longest first, a length opens as many sequences as
  one combination can fill to the last token, under the counts that are left.
  What no combination completes is placed by best fit, longest first, into the
  sequence with the least room that takes it; each new gap is looked up in the
  index again. All sequences of one pattern are planned in one step, so the plan
  grows with the number of lengths, not of documents.
* ranks: each task numbers its pieces by length while it tokenizes them. The
  counts by (task, length) give running sums; no task sorts or holds all pieces
  of a length, however many documents share it.

Null text is empty and gives the end token alone. Repeated rows are packed one
by one, ties of length in the order of the tables. A null id stays null, other
columns are not read, an empty table gives no rows. Sequence ids are dense.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.llm.common import slices
from glossaria.llm.packing import TokenBytes
from glossaria.sources.shared import materialize


class SumIndex:
    """Available lengths by the sum of one, two or three of them.

    Counts only fall, so an entry that has run out is passed over for good.
    """

    def __init__(self, counts: list[int]):
        self.counts = counts
        present = np.array(counts) > 0
        self.pairs, self.triples = [np.zeros(0, int)], [np.zeros(0, int)]
        for s in range(1, len(counts)):
            larger = np.arange(s - 1, (s - 1) // 2, -1)
            self.pairs.append(larger[present[larger] & present[s - larger]] if s > 1 else larger[:0])
        paired = np.array([len(p) > 0 for p in self.pairs])
        for s in range(1, len(counts)):
            member = np.arange(s - 1, 0, -1)
            self.triples.append(member[present[member] & paired[s - member]])
        self.pairs, self.triples = [p.tolist() for p in self.pairs], [t.tolist() for t in self.triples]
        self.pair_at, self.triple_at = [0] * len(counts), [0] * len(counts)

    def times(self, items: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        if len(items) == 1:
            return self.counts[items[0]]
        return min(self.counts[x] // n for x, n in Counter(items).items())

    def live_pairs(self, s: int) -> Iterator[tuple[int, int]]:
        larger, at = self.pairs[s], self.pair_at[s]
        while at < len(larger) and not self.times((larger[at], s - larger[at])):
            at += 1
        self.pair_at[s] = at
        for a in larger[at:]:
            yield a, s - a

    def live_triples(self, s: int) -> Iterator[tuple[int, int, int]]:
        member, at = self.triples[s], self.triple_at[s]
        while at < len(member) and not (self.counts[member[at]] and next(self.live_pairs(s - member[at]), None)):
            at += 1
        self.triple_at[s] = at
        for c in member[at:]:
            if self.counts[c]:
                for a, b in self.live_pairs(s - c):
                    if self.times((c, a, b)):
                        yield c, a, b
                        break

    def complement(self, gap: int, opened: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """At most three lengths that fill the gap, available beside those of ``opened``."""
        if self.times((*opened, gap)):
            return (gap,)
        for found in (self.live_pairs(gap), self.live_triples(gap)):
            for items in found:
                if self.times(opened + items):
                    return items
        return None


@dataclass
class Pattern:
    """``n`` sequences with the same lengths, as (length, copies) in order."""

    n: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def plus(self, n: int, *items: tuple[int, int]) -> Pattern:
        return Pattern(n, self.items + list(items))


def patterns(histogram: dict[int, int], room: int) -> list[Pattern]:
    """Sequences for the given number of pieces of each length from 1 to ``room``."""
    counts = [0] * (room + 1)
    for length, n in histogram.items():
        counts[length] = n
    index, done, opened = SumIndex(counts), [], defaultdict(list)

    def take(n: int, items: tuple[int, ...]) -> None:
        for x in items:
            counts[x] -= n

    if counts[room]:
        done.append(Pattern(counts[room], [(room, 1)]))
        counts[room] = 0
    for length in range(room - 1, 0, -1):
        while counts[length]:
            items = index.complement(room - length, (length,))
            if items is None:
                break
            items = (length, *items)
            n = index.times(items)
            take(n, items)
            done.append(Pattern(n, [(x, 1) for x in items]))

    def settle(pattern: Pattern, gap: int) -> None:
        """Fill the gap exactly as often as possible, leave the rest open."""
        while gap and pattern.n:
            items = index.complement(gap)
            if items is None:
                opened[gap].append(pattern)
                return
            n = min(pattern.n, index.times(items))
            take(n, items)
            done.append(pattern.plus(n, *((x, 1) for x in items)))
            pattern = pattern.plus(pattern.n - n)
        if pattern.n:
            done.append(pattern)

    for length in range(room - 1, 0, -1):
        while counts[length]:
            gap = next((g for g in range(length, room) if opened.get(g)), room)
            best = opened[gap].pop() if gap < room else Pattern(counts[length])
            copies = min(gap // length, counts[length])
            n = min(best.n, counts[length] // copies)
            if best.n > n and gap < room:
                opened[gap].append(best.plus(best.n - n))
            counts[length] -= n * copies
            settle(best.plus(n, (length, copies)), gap - length * copies)
    return done + [p for left in opened.values() for p in left]


@dataclass(frozen=True)
class Plan:
    """Places by (length, rank): parallel arrays, sorted, with one entry per length of a pattern."""

    key: np.ndarray  # length << 48 | first rank
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        nth, copy = np.divmod(rank - (self.key[at] & ((1 << 48) - 1)), self.copies[at])
        return self.sequence[at] + nth, self.offset[at] + copy * length


def plan(histogram: dict[int, int], room: int) -> Plan:
    rows, given, sequences = [], Counter(), 0
    for p in patterns(histogram, room):
        offset = 0
        for length, copies in p.items:
            rows.append((length << 48 | given[length], copies, sequences, offset))
            given[length] += p.n * copies
            offset += length * copies
        sequences += p.n
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences)


def tokenized(docs: DataFrame, tokenizer_path: str, room: int, end_id: int, id_column: str, text: str) -> DataFrame:
    """One row per piece with its task and its number among the task's pieces of that length."""
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType)])
    for name in ("piece", "start", "length", "part", "nth"):
        schema.add(name, T.IntegerType() if name == "piece" else T.LongType())
    schema.add("tokens", T.BinaryType())
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, seen, part = TokenBytes(tokenizer_path), [0] * (room + 1), TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, "text"):
                ids, rows = some.column("id"), []
                for d, value in enumerate(some.column("text").to_pylist()):
                    tokens = tokenize(value or "") + end
                    n, start, stop = len(tokens) // 4, 0, (len(tokens) // 4 - 1) % room + 1
                    for piece in range(-(-n // room)):
                        rows.append((d, piece, start, stop - start, part, seen[stop - start], tokens[4 * start : 4 * stop]))
                        seen[stop - start] += 1
                        start, stop = stop, stop + room
                for at in range(0, len(rows), 1024):
                    d, piece, *longs, tokens = zip(*rows[at : at + 1024])
                    columns = [pc.take(ids, pa.array(d)), pa.array(piece, pa.int32())]
                    columns += [pa.array(x, pa.int64()) for x in longs] + [pa.array(tokens, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ``tokens`` (little-endian), sequence_id, offset."""
    pieces = materialize(tokenized(docs, tokenizer_path, max_tokens, end_id, id_column, text), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most max_tokens rows
    planned = plan({r["length"]: r["n"] for r in histogram}, max_tokens)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = ["id", "piece", "start", "length", "tokens"]
    ranked = pieces.join(bases, ["part", "length"]).select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
    schema = T.StructType([ranked.schema[c] for c in columns])
    schema = schema.add("sequence_id", T.LongType()).add("offset", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = planned.places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                arrays = [batch.column(c) for c in columns] + [pa.array(x, pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ranked.mapInArrow(run, schema).withColumnRenamed("id", id_column)
