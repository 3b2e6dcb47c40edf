"""Packing of tokenized documents into sequences of fixed length.

Rows are dealt over tasks of about ``task_bytes`` of text by a hash of ``seed``, id,
text and place in the table, so the groups are random, and the same again for the
same table. Each task cuts its rows into groups of about ``group_tokens`` tokens. In a group a document of more tokens
than a sequence gives full sequences and a rest; rests and shorter documents
are placed by first-fit decreasing: longest first, each into the first sequence
with room for it. A tournament tree over the free room of the sequences finds
that one in a logarithmic number of steps. Groups are independent, so nothing
but one group is held by a task, and no key decides where a row goes.

A document's tokens are those of a byte-level BPE file of the ``tokenizers``
library plus ``end_id``. They are found by ``tiktoken``, which is faster, from
the ranks in the file; texts that spell the special token, hold 100,000 or more
white-space characters in a row, or make ``tiktoken`` fail go to ``tokenizers``. Null text is empty and gives the end token alone.
Repeated rows are packed one by one. A null id stays null; other columns are
not read. Sequence ids are unique, not dense: number of the task * 2**32 +
number in the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.llm.common import slices

# How the byte-level BPE splits texts, and its special token.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
# Runs of white space that the faster library's splitter may not get through.
# Looked for at their beginnings alone, so the search is linear.
LONG_RUN = re.compile(r"(?<!\s)\s{100000}")


def byte_values() -> dict[str, int]:
    """Character -> byte of the vocabulary's spelling: printable Latin-1 as it is, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class TokenBytes:
    """Texts to token ids as little-endian unsigned 32-bit integers.

    The file's vocabulary is in the order of its merges, so it serves as ranks
    for the faster library; texts that spell the special token or that the
    faster library cannot split go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, values = Tokenizer.from_file(path), byte_values()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(values[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
        self.encode = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text and not LONG_RUN.search(text):
            try:
                return self.encode(text)
            except BaseException as error:  # a panic of the library is no Exception
                if not isinstance(error, Exception) and type(error).__name__ != "PanicException":
                    raise
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()


class Tournament:
    """Free room of the sequences as a tree of maxima; finds the first with enough."""

    def __init__(self, places: int, room: int):
        self.leaves = 1 << max(0, places - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        node = 1
        while node < self.leaves:
            node *= 2
            if self.most[node] < size:
                node += 1
        return node - self.leaves

    def take(self, place: int, size: int) -> int:
        """Fill ``size`` tokens of a sequence; their offset is the room left before, from the end."""
        node = place + self.leaves
        before = self.most[node]
        self.most[node] = before - size
        while node > 1:
            node //= 2
            most = max(self.most[2 * node], self.most[2 * node + 1])
            if self.most[node] == most:
                break
            self.most[node] = most
        return before


def pack_group(lengths: list[int], room: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one group, and its number of sequences."""
    pieces, rests, used = [], [], 0
    for d, n in enumerate(lengths):
        full = n // room
        pieces += [(d, k * room, room, used + k, 0) for k in range(full)]
        used += full
        if n % room:
            rests.append((n % room, d, full * room))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree, filled = Tournament(len(rests), room), 0
    for size, d, start in rests:
        place = tree.first_fit(size)
        pieces.append((d, start, size, used + place, room - tree.take(place, size)))
        filled = max(filled, place + 1)
    return pieces, used + filled


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = 1024,
    end_id: int = 0,
    group_tokens: int = 4_000_000,
    id_column: str = "doc_id",
    text: str = "text",
    seed: int = 0,
    task_bytes: int = 1 << 24,
) -> DataFrame:
    """One row per piece: id, start, length, ``tokens`` (little-endian), doc_tokens, sequence_id, offset."""
    schema = T.StructType([docs.schema[id_column]])
    for name in ("start", "length"):
        schema.add(name, T.LongType())
    schema.add("tokens", T.BinaryType())
    for name in ("doc_tokens", "sequence_id", "offset"):
        schema.add(name, T.LongType())
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    tasks = max(1, -(-size // task_bytes))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, group = TokenBytes(tokenizer_path), []
        base, held, done = TaskContext.get().partitionId() << 32, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            pieces, used = pack_group([len(t) // 4 for _, t in group], max_tokens)
            for at in range(0, len(pieces), 1024):
                some = pieces[at : at + 1024]
                columns = [
                    pa.array([group[p[0]][0] for p in some], ids),
                    *(pa.array([p[i] for p in some], pa.int64()) for i in (1, 2)),
                    pa.array([group[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p in some], pa.binary()),
                    pa.array([len(group[p[0]][1]) // 4 for p in some], pa.int64()),
                    pa.array([base + done + p[3] for p in some], pa.int64()),
                    pa.array([p[4] for p in some], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            done += used
            group.clear()

        ids = None
        for batch in batches:
            ids = batch.schema.field(id_column).type
            for part in slices(batch, text):
                for key, value in zip(part.column(id_column).to_pylist(), part.column(text).to_pylist()):
                    tokens = tokenize(value or "") + end
                    group.append((key, tokens))
                    held += len(tokens) // 4
                    if held >= group_tokens:
                        yield from flush()
                        held = 0
        if group:
            yield from flush()

    dealt = F.xxhash64(F.lit(seed), id_column, text, F.monotonically_increasing_id())
    return docs.select(id_column, text).repartition(tasks, dealt).mapInArrow(run, schema)
