"""Best-fit packing with exact complements: plans, round trips, corner cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF
from glossaria.llm import complement_packing as cp
from glossaria.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, room):
    free = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, f in enumerate(free) if f >= n), key=lambda i: free[i], default=None)
        if at is None:
            free.append(room)
            at = len(free) - 1
        free[at] -= n
    return len(free)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once_and_no_worse_than_best_fit(seed):
    draw, room = random.Random(seed), [64, 100, 256, 2048][seed % 4]
    lengths = [min(room, 1 + int(draw.expovariate(1 / (room / (2 + seed))))) for _ in range(1500)]
    planned, used, at = cp.plan(Counter(lengths), room), defaultdict(list), Counter()
    for n in lengths:
        (sequence,), (offset,) = planned.places(np.array([n]), np.array([at[n]]))
        at[n] += 1
        used[int(sequence)].append((int(offset), n))
    assert sorted(used) == list(range(planned.sequences))
    for places in used.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= room
    assert -(-sum(lengths) // room) <= planned.sequences <= best_fit(lengths, room)


def test_exact_complements_are_found():
    room = 100
    assert cp.plan({60: 5, 40: 5}, room).sequences == 5
    assert cp.plan({70: 3, 20: 3, 10: 3}, room).sequences == 3
    assert cp.plan({52: 2, 30: 2, 11: 2, 7: 2}, room).sequences == 2
    assert cp.plan({50: 7, 25: 2}, room).sequences == 4
    assert cp.plan({100: 9}, room).sequences == 9
    assert cp.plan({1: 1000}, room).sequences == 10
    assert cp.plan({}, room).sequences == 0


def test_every_combination_of_the_index_sums_up():
    draw = random.Random(3)
    counts = [0] + [draw.choice([0, 0, 1, 3]) for _ in range(80)]
    index = cp.SumIndex(counts)
    present = [x for x, n in enumerate(counts) if n]
    for gap in range(1, 81):
        one = any(x == gap for x in present)
        two = any(index.times((x, y)) for x in present for y in present if x + y == gap)
        three = any(index.times((x, y, gap - x - y)) for x in present for y in present if 0 < gap - x - y)
        found = index.complement(gap)
        assert (found is not None) == (one or two or three)
        assert found is None or (sum(found) == gap and index.times(found))
        assert found is None or len(found) == (1 if one else 2 if two else 3)


def test_plan_grows_with_lengths_not_with_documents():
    few = cp.plan({n: 7 for n in range(1, 2048)}, 2048)
    many = cp.plan({n: 7_000_000 for n in range(1, 2048)}, 2048)
    assert len(many.key) < 3 * len(few.key) < 60_000
    assert many.sequences <= -(-sum(range(1, 2048)) * 7_000_000 // 2048) * 1.0001


def checked(df, texts, room):
    """Pieces checked against the tokenizer; the number of sequences."""
    encode, sequences, pieces = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in df.collect():
        assert len(r["tokens"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["tokens"]))
    for places in sequences.values():
        ends = [0]
        for offset, n in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= room
    assert set(pieces) == {k for k, _ in texts}
    for key, text in texts:
        ids = encode.encode(text or "", add_special_tokens=False).ids + [0]
        same = Counter(k for k, _ in texts)[key]
        found = sorted(pieces[key])
        assert b"".join(t for _, _, _, t in found[::same]) == np.array(ids, "<u4").tobytes()
        assert [(s, n) for _, s, n, _ in found[same::same]] == [(s, room) for s in range(len(ids) - room * (len(found) // same - 1), len(ids), room)]
    return len(sequences)


def test_round_trip_and_corner_cases(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 20, 60, 300])))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, " " * 5000), (103, "é😀 <|endoftext|> x"), (104, "long " * 30_000), (None, "no id"), (7, texts[7][1])]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr(
        "*", "1 AS piece", "2 AS part", "3 AS nth", "'x' AS tokens", "'y' AS id", "4 AS rank", "5 AS base"
    ).repartition(5)
    for room in (64, 2048):
        checked(cp.pack(df, PATH, room), texts, room)
    assert cp.pack(df.limit(0), PATH).count() == 0


def test_one_length_may_hold_all_rows(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'same words' AS text").repartition(7)
    assert checked(cp.pack(df, PATH, 30), [(i, "same words") for i in range(4000)], 30) == 400


def test_query_packs_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows, encode = queries.QUERIES["op11_complement_packing"](spark, SF).collect(), Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    total = 0
    for key, text in docs:
        ids = np.array(encode.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        start = 0
        for i, (piece, at, n, crc) in enumerate(sorted(by_doc.pop(key))):
            assert (piece, at, crc) == (i, start, zlib.crc32(ids[at : at + n].tobytes()))
            assert n == 2048 or i == 0
            start += n
        assert start == len(ids)
    assert not by_doc
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 2
