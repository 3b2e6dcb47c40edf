"""Stupid-backoff scores of documents under counts of the whole collection.

Scores are leave-one-out: a document's own occurrences are taken off all
counts, so it is scored by the others. For word i with context the score is
``c(w1 w2 w3) / c(w1 w2)`` if that n-gram is left elsewhere, else ``0.4`` times
the score with one context word less, down to ``c(w3) / N``; a word found
nowhere else gets ``0.4 ** order / N``. Logarithms are summed per document.

The relations are those of a join of exploded n-grams with count tables
partitioned by hash, in packed form, as an exploded row per n-gram would move
many times the input:

* documents are dealt by hash into blocks of about ``BLOCK_CHARS`` characters;
* a block sends its distinct n-grams, as sorted 56-bit hashes, to the parts of
  the count table (ranges of the hash), each with the number of occurrences;
* a part adds up the counts of equal hashes over all blocks and answers each
  block with the sums, in the order of its request;
* blocks join the answers to their n-grams and sum up per document.

A frequent n-gram is one entry per block, hashes spread evenly over the parts,
and parts and blocks grow in number, not in size. With 10^13 distinct n-grams
about one in 10^4 shares its hash with another one.

Null and empty texts have no words and score 0. Repeated rows are documents of
their own. A null id stays null. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.llm.common import WordHashes, hash_words, poly

WORD = re.compile(r"[^\W_]+")
ORDER, BACKOFF = 3, 0.4
HASH_BITS = 56
BLOCK_CHARS, PART_CHARS = 16_000_000, 8_000_000
REQUEST = "part bigint, block bigint, n bigint, hashes binary, counts binary"


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, lowest first; the highest plane is deflated."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    rows = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + rows[:-1].tobytes() + zlib.compress(rows[-1].tobytes(), 1)


def from_planes(raw: bytes, n: int) -> np.ndarray:
    width, cut = raw[0], 1 + (raw[0] - 1) * n
    out = np.zeros((n, 8), np.uint8)
    for k in range(width - 1):
        out[:, k] = np.frombuffer(raw, np.uint8, n, 1 + k * n)
    out[:, width - 1] = np.frombuffer(zlib.decompress(raw[cut:]), np.uint8, n)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def ngrams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each word (0 where the document is shorter), by n, and words per text."""
    words, counts = hash_words(texts, WORD, WordHashes())
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    out, shift = [], np.uint64(64 - HASH_BITS)
    for n in range(1, order + 1):
        h = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            h[n - 1 :] = poly([words[i : len(words) - n + 1 + i] for i in range(n)]) >> shift
        h[place < n - 1] = 0
        out.append(h)
    return out, counts


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def distinct(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of all orders with their counts; hash 0 counts the words."""
    ordered = np.sort(np.concatenate([h[h != 0] for h in hashes]))
    first = runs(ordered)
    counts = np.diff(np.append(first, len(ordered)))
    return np.append(np.uint64(0), ordered[first]), np.append(len(hashes[0]), counts).astype(np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(HASH_BITS - 28)) * np.uint64(parts)) >> np.uint64(28)


def requester(order: int, parts: int):
    """Arrow function: the requests of one block."""

    def run(key, docs):
        keys, counts = distinct(ngrams([x or "" for x in docs.column("text").to_pylist()], order)[0])
        edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
        used = [p for p in range(parts) if edges[p] < edges[p + 1]]
        cut = [slice(edges[p], edges[p + 1]) for p in used]
        return pa.table(
            {
                "part": pa.array(used, pa.int64()),
                "block": pa.array([key[0].as_py()] * len(used), pa.int64()),
                "n": pa.array([int(c.stop - c.start) for c in cut], pa.int64()),
                "hashes": pa.array([planes(np.diff(keys[c], prepend=np.uint64(0))) for c in cut], pa.binary()),
                "counts": pa.array([planes(counts[c]) for c in cut], pa.binary()),
            }
        )

    return run


def answer(requests):
    """Sums over all blocks for one part of the count table, as one answer per request."""
    sizes = requests.column("n").to_pylist()
    keys = np.concatenate([np.cumsum(from_planes(h, n)) for h, n in zip(requests.column("hashes").to_pylist(), sizes)])
    counts = np.concatenate([from_planes(c, n) for c, n in zip(requests.column("counts").to_pylist(), sizes)])
    order = np.argsort(keys)
    first = runs(keys[order])
    total = np.empty(len(keys), np.uint64)
    if len(keys):
        total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(keys))))
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "block": requests.column("block"),
            "part": requests.column("part"),
            "n": requests.column("n"),
            "sums": pa.array([planes(total[e - n : e]) for e, n in zip(ends, sizes)], pa.binary()),
        }
    )


def elsewhere(h: np.ndarray, doc: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Occurrences of each word's n-gram in other documents.

    ``doc`` ascends, so a stable sort by hash puts the occurrences of an n-gram
    in one document next to each other.
    """
    order = np.argsort(h, kind="stable")
    ordered, owner = h[order], doc[order]
    first = runs(ordered)
    total = np.repeat(sums[np.searchsorted(keys, ordered[first])], np.diff(np.append(first, len(h))))
    new = np.zeros(len(h), bool)
    new[first] = True
    new[1:] |= owner[1:] != owner[:-1]
    own = np.flatnonzero(new)
    total -= np.repeat(np.diff(np.append(own, len(h))), np.diff(np.append(own, len(h))))
    total[ordered == 0] = 0
    out = np.empty(len(h))
    out[order] = total
    return out


def scorer(order: int, names: list[str]):
    """Arrow function: scores of the documents of a block, from its answers."""

    def run(docs, answers):
        hashes, counts = ngrams([x or "" for x in docs.column("text").to_pylist()], order)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "n", "sums"))))
        sums = np.concatenate([from_planes(s, n) for _, n, s in rows]).astype(float)
        del rows
        keys = distinct(hashes)[0]
        left = [elsewhere(h, doc, keys, sums) for h in hashes]
        rest = sums[0] - counts[doc]
        score = np.where(left[0] > 0, left[0], BACKOFF) * BACKOFF ** (order - 1) / np.maximum(rest, 1)
        for n in range(2, order + 1):
            seen = np.flatnonzero(left[n - 1] > 0)
            score[seen] = BACKOFF ** (order - n) * left[n - 1][seen] / left[n - 2][seen - 1]
        total = np.bincount(doc, np.log(score), len(counts)) if len(doc) else np.zeros(len(counts))
        columns = {names[0]: docs.column(names[0]), "n_words": pa.array(counts), "log_score": pa.array(total)}
        columns["mean_log_score"] = pa.array(total / np.maximum(counts, 1))
        return pa.table(columns)

    return run


def score(docs: DataFrame, order: int = ORDER, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``log_score`` (natural logarithm, summed) and ``mean_log_score``."""
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    blocks, parts = -(-size // BLOCK_CHARS) or 1, -(-size // PART_CHARS) or 1
    block = F.pmod(F.xxhash64(id_column, text), F.lit(blocks))
    rows = docs.select(F.col(id_column), F.col(text).alias("text"), block.cast("bigint").alias("block"))
    requests = rows.groupBy("block").applyInArrow(requester(order, parts), REQUEST)
    answers = requests.groupBy("part").applyInArrow(answer, "block bigint, part bigint, n bigint, sums binary")
    schema = T.StructType([docs.schema[id_column]]).add("n_words", T.LongType()).add("log_score", T.DoubleType())
    schema.add("mean_log_score", T.DoubleType())
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scorer(order, [id_column]), schema)


ORACLE_SQL = r"""
with doc as (
  select doc_id, row_number() over () as r, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
word as (
  select r, i, w[i] as c, if(i > 1, w[i - 1], null) as b, if(i > 2, w[i - 2], null) as a
  from (select r, w, unnest(range(1, len(w) + 1)) as i from doc)),
one as (select c, count(*) as n from word group by c),
two as (select b, c, count(*) as n from word where b is not null group by b, c),
three as (select a, b, c, count(*) as n from word where a is not null group by a, b, c),
own as (
  select *, count(*) over (partition by r, c) as o1, count(*) over (partition by r, b, c) as o2,
    count(*) over (partition by r, a, b, c) as o3, count(*) over (partition by r) as o0 from word),
left_over as (
  select r, i, o0, one.n - o1 as l1, if(own.b is null, 0, two.n - o2) as l2, if(own.a is null, 0, three.n - o3) as l3
  from own join one on own.c = one.c left join two on own.b = two.b and own.c = two.c
  left join three on own.a = three.a and own.b = three.b and own.c = three.c),
context as (
  select *, lag(l1) over (partition by r order by i) as c1, lag(l2) over (partition by r order by i) as c2 from left_over),
scored as (
  select r, case when l3 > 0 then l3 / c2 when l2 > 0 then 0.4 * l2 / c1
    else 0.16 * if(l1 > 0, l1, 0.4) / greatest((select count(*) from word) - o0, 1) end as s from context),
total as (select r, sum(ln(s)) as log_score, count(*) as n from scored group by r)
select doc_id, cast(coalesce(n, 0) as bigint) as n_words, round(coalesce(log_score, 0.0), 4) as log_score,
  round(coalesce(log_score / n, 0.0), 6) as mean_log_score
from doc left join total on doc.r = total.r
"""
