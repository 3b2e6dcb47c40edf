"""Spelling variants: words one edit apart, and the frequent form a rare one stands for.

1. Words are counted once: each task counts the runs of its documents and sends
   one row per word and slice of texts; Spark adds them up.
2. Candidates come from blocked Gram matrices. A word is a vector of letter
   counts. One edited code point changes the squared distance of two vectors by
   at most 2, and the length by at most 1. Words are blocked by length and by how
   many letters of each of ``CLASSES`` they hold; an edit moves such a count by at
   most one, so a block's words meet each other and those of adjacent blocks
   (``STEPS``). A block's words are one group of a cogroup, cut into sub-blocks of
   about ``block_words``; the adjacent words are the other, in parts of as many times
   ``NEIGHBOURS``. Inside, both are ordered by the counts of ``FINE`` classes, and for
   each pair of adjacent runs a NumPy product gives all inner products, hence squared
   distances; pairs at more than 2 are dropped.
3. The pairs left are verified by comparing the words place by place.
4. Each word takes its most frequent near word as form if that is at least
   ``ratio`` times as frequent. Counts grow by that factor along the forms, so
   chains are as short as the logarithm of the largest count; the last word of a
   chain is found by doubling steps over a written table.

Null and empty texts hold no words, a null id counts as the empty string,
repeated rows count again, other columns are not read, an empty table gives no
rows. Equal counts are ordered by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import slices
from glossaria.sources.shared import materialize

# Letters are a-z and U+00C0 to U+00FF, A-Z are lower-cased.
FIRST_ACCENT, ACCENTS = 0xC0, 64
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(FIRST_ACCENT + i) for i in range(ACCENTS))
# Letters whose counts part the blocks; what is in none of them counts in the length alone.
CLASSES = ("eaoi", "nrstl")
FINE = ("e", "a", "o", "i", "n", "r", "s", "t", "l", "d", "h", "c", "u", "m")
FINE_ROWS = 8  # words of a run on average, at least; else fewer classes are taken
NEIGHBOURS = 8
CELLS = 1 << 22  # entries of one product
CHECKED = 1 << 18  # pairs verified at a time


def word_pattern(least: int) -> re.Pattern:
    return re.compile(f"[a-zÀ-ÿ]{{{least},}}")


def document_words(pattern: re.Pattern, doc: bytes, text: bytes, least: int, every: int) -> Counter:
    """Counts of a document's words, some with a code point deleted by the hash of document and word."""
    found, seed = Counter(), zlib.crc32(doc + b":")
    # bytes.lower() changes A-Z alone
    for word, n in Counter(pattern.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(word.encode(), seed)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        found[word] += n
    return found


def word_counts(
    docs: DataFrame, least: int = 7, minimum: int = 2, every: int = 31, id_column: str = "doc_id", text: str = "text",
    held_words: int = 300_000,
) -> DataFrame:
    """``(word, n)`` of words of at least ``least`` code points that occur ``minimum`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = word_pattern(least), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            held.clear()
            for at in range(0, len(words), 1 << 14):
                part = slice(at, at + (1 << 14))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[part], pa.string()), pa.array(counts[part], pa.int64())], names=["word", "n"]
                )

        for batch in batches:
            for some in slices(batch, "text"):
                for doc, value in zip(some.column("doc").to_pylist(), some.column("text").to_pylist()):
                    if value:
                        held.update(document_words(pattern, doc or b"", value, least, every))
                    if len(held) > held_words:
                        yield from flush()
        yield from flush()

    rows = docs.select(F.col(id_column).cast("string").cast("binary").alias("doc"), F.col(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= minimum)


def letters_of(words: list[str]) -> np.ndarray:
    """Number of each letter of all words in ``LETTERS``, one after the other."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 128, points - ord("a"), points - FIRST_ACCENT + 26).astype(np.uint8)


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word."""
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * len(LETTERS) + letters_of(words), minlength=len(words) * len(LETTERS)).reshape(-1, len(LETTERS))
    # sums of products of up to 2**24 are exact in single precision
    return counts.astype(np.float32 if counts.size == 0 or int((counts**2).sum(axis=1).max()) < 1 << 22 else np.float64)


def half_norms(counts: np.ndarray) -> np.ndarray:
    return (counts * counts).sum(axis=1) / 2


def close_counts(left: np.ndarray, right: np.ndarray, left_half: np.ndarray, right_half: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right`` whose squared distance, taken from the Gram matrix, is at most ``most``."""
    # |x - y|^2 <= most, as x.y - |y|^2 / 2 >= (|x|^2 - most) / 2
    product = left @ right.T
    product -= right_half
    return np.divmod(np.flatnonzero(product >= (left_half - most / 2)[:, None]), len(right))


def swaps(classes: int) -> list[tuple[int, ...]]:
    """Changes of the counts of classes by one replaced letter, one of each opposite two."""
    unit = [tuple(int(i == k) for i in range(classes)) for k in range(classes)] + [(0,) * classes]
    return sorted({tuple(x - y for x, y in zip(unit[p], unit[q])) for p in range(classes + 1) for q in range(p + 1, classes + 1)})


def inserts(classes: int) -> list[tuple[int, ...]]:
    """Changes of the counts by one inserted letter."""
    return [tuple(int(i == k) for i in range(classes)) for k in range(classes)] + [(0,) * classes]


# Changes of (length, counts by class) that one edit makes, one of each opposite two, none first.
STEPS = [(0,) * (len(CLASSES) + 1), *((0, *s) for s in swaps(len(CLASSES))), *((1, *s) for s in inserts(len(CLASSES)))]


class Runs:
    """Words of one length in the order of their fine counts, which a linear hash stands for."""

    FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5) % (1 << 64) | 1 for i in range(len(FINE))], np.uint64)

    def __init__(self, words: list[str], counts: np.ndarray, classes: int):
        self.classes = classes
        fine = np.zeros((len(words), classes), np.int64)
        for k, group in enumerate(FINE[:classes]):
            fine[:, k] = counts[:, [LETTERS.index(c) for c in group]].sum(axis=1)
        hashed = self.hash(fine)
        self.order = np.argsort(hashed, kind="stable")
        self.keys, self.first = np.unique(hashed[self.order], return_index=True)
        self.last = np.append(self.first[1:], len(words))
        self.counts = counts[self.order]
        self.half = half_norms(self.counts)

    def hash(self, fine: np.ndarray) -> np.ndarray:
        return (fine.astype(np.uint64) * self.FACTORS[: self.classes]).sum(axis=1, dtype=np.uint64)

    def meet(self, other: Runs, changes: list[tuple[int, ...]]):
        """Yield numbers of own words and of ``other``'s whose counts are close, for runs that differ by one of the changes."""
        for change in changes:
            wanted = self.keys + self.hash(np.array([change], np.int64).reshape(1, self.classes))[0]
            at = np.minimum(np.searchsorted(other.keys, wanted), len(other.keys) - 1)
            for k in np.flatnonzero(other.keys[at] == wanted):
                a, b = slice(self.first[k], self.last[k]), slice(other.first[at[k]], other.last[at[k]])
                step = max(1, CELLS // (b.stop - b.start))
                for start in range(a.start, a.stop, step):
                    part = slice(start, min(start + step, a.stop))
                    i, j = close_counts(self.counts[part], other.counts[b], self.half[part], other.half[b])
                    i += start
                    j += b.start
                    if other is self and not any(change):
                        i, j = i[i < j], j[i < j]
                    yield self.order[i], other.order[j]


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one replaced letter, or one inserted into the left one."""
    same = left == right[:, : left.shape[1]]
    if left.shape[1] == right.shape[1]:
        return same.sum(axis=1) == left.shape[1] - 1
    moved = left == right[:, 1:]
    led = np.where(same.all(axis=1), left.shape[1], np.argmin(same, axis=1))
    followed = np.where(moved.all(axis=1), left.shape[1], np.argmin(moved[:, ::-1], axis=1))
    return led + followed >= left.shape[1]


def near_pairs(words: list[str], others: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words and of ``others`` (the words themselves, if None) that are one edit apart.

    Words have one length; the others too, the same or one more.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if not words or (others is not None and not others):
        return found[0]
    counts = letter_counts(words)
    classes = len(FINE)
    while classes and len(words) < FINE_ROWS * len(Runs(words, counts, classes).keys):
        classes -= 2
    own = Runs(words, counts, classes)
    rows = letters_of(words).reshape(len(words), -1)
    if others is None:
        other, other_rows, changes = own, rows, [(0,) * classes, *swaps(classes)]
    else:
        other, other_rows = Runs(others, letter_counts(others), classes), letters_of(others).reshape(len(others), -1)
        both = swaps(classes)
        changes = [(0,) * classes, *both, *(tuple(-x for x in s) for s in both)]
        if len(others[0]) > len(words[0]):
            changes = inserts(classes)
    held, n = [], 0

    def verified() -> None:
        i, j = (np.concatenate(x) for x in zip(*held))
        held.clear()
        most = max(1, CHECKED * 16 // rows.shape[1])
        for at in range(0, len(i), most):
            p, q = i[at : at + most], j[at : at + most]
            right = one_edit(rows[p], other_rows[q])
            found.append((p[right], q[right]))

    for pair in own.meet(other, changes):
        held.append(pair)
        n += len(pair[0])
        if n >= CHECKED:
            verified()
            n = 0
    if held:
        verified()
    return tuple(np.concatenate(x) for x in zip(*found))


def block_key() -> Column:
    length = F.char_length("word")
    classes = [length - F.char_length(F.translate("word", c, "")) for c in CLASSES]
    return F.array(length, *classes)


def near_words(words: DataFrame, block_words: int = 1 << 14) -> DataFrame:
    """Pairs of words one edit apart, both ways: ``(word, n, near, near_n)``."""
    keyed = materialize(words.select("word", "n", block_key().alias("key")), "words")
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "word-blocks")
    shifts = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in STEPS])).alias("shift")

    # sub-blocks of a block, and parts of all words that its own ones meet
    met = sizes.select("size", "key", shifts).select("size", F.zip_with("key", "shift", lambda k, x: k - x).alias("met"))
    around = met.groupBy("met").agg(F.sum("size").alias("around"))
    cut = lambda c, most: F.ceil(F.col(c) / F.lit(most)).cast("int")
    cells = sizes.join(around, F.col("key") == F.col("met")).select(
        F.col("key").alias("cell_key"), F.monotonically_increasing_id().alias("cell"),
        cut("size", block_words).alias("subs"), cut("around", block_words * NEIGHBOURS).alias("parts"),
    )
    cells = materialize(cells, "word-cells")
    spread = lambda by: F.pmod(F.xxhash64("word"), F.col(by)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = keyed.join(cells, F.col("key") == F.col("cell_key")).select("word", "n", "cell", spread("subs").alias("sub"), every("parts").alias("part"))
    # a word meets the blocks a step before its own, and, as its own block's neighbour, the sub-blocks before its own
    shifted = keyed.select("word", "n", "key", shifts).select("word", "n", "key", F.zip_with("key", "shift", lambda k, x: k - x).alias("met"))
    guests = shifted.join(cells, F.col("met") == F.col("cell_key")).select(
        "word", "n", "cell", every("subs").alias("sub"), spread("parts").alias("part"),
        F.when(F.col("met") == F.col("key"), spread("subs")).alias("own_sub"),
    )
    guests = guests.where(F.col("own_sub").isNull() | (F.col("sub") < F.col("own_sub"))).drop("own_sub")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, n = left.column("word").to_pylist(), left.column("n").to_numpy()
        b, m = right.column("word").to_pylist(), right.column("n").to_numpy()
        columns = [[], [], [], []]

        def add(x: list[str], xn: np.ndarray, y: list[str], yn: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> None:
            i, j = pairs
            first, second = [x[k] for k in i], [y[k] for k in j]
            for column, values in zip(columns, (first + second, [*xn[i], *yn[j]], second + first, [*yn[j], *xn[i]])):
                column += values

        if a:
            if key[2].as_py() == 0:
                add(a, n, a, n, near_pairs(a, None))
            size = np.array([len(w) for w in b], np.int64)
            for length in (len(a[0]), len(a[0]) + 1):
                at = np.flatnonzero(size == length)
                others = [b[k] for k in at]
                add(a, n, others, m[at], near_pairs(a, others))
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], names=["word", "n", "near", "near_n"])

    group = ["cell", "sub", "part"]
    # fresh names: both sides of the cogroup come from one table
    guests = guests.select(*[F.col(c).alias(c) for c in guests.columns])
    return members.groupBy(*group).cogroup(guests.groupBy(*group)).applyInArrow(meet, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the end of each chain, by doubling steps."""
    chains = materialize(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = chains.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = materialize(moved, "chains")
        chains = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return chains


def variants(
    docs: DataFrame, least: int = 7, minimum: int = 2, every: int = 31, ratio: int = 10, block_words: int = 1 << 14,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = materialize(word_counts(docs, least, minimum, every, id_column, text), "word-counts")
    best = F.struct((-F.col("near_n")).alias("order"), "near")
    near = near_words(words, block_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    joined = words.join(near, "word", "left")
    frequent = -F.col("best.order") >= F.col("n") * ratio
    found = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.order")).alias("form_n"),
    )
    found = materialize(found, "forms")
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


# The same rows in DuckDB: crc32 from its polynomial, near words from equal remainders after a deletion.
ORACLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS step FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
),
doc_runs AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc, run),
hashed AS (
  SELECT run, n, xor(list_reduce(
      list_prepend(4294967295, list_transform(
        range(1, strlen(doc || ':' || run) + 1),
        lambda i: CAST('0x' || substr(hex(encode(doc || ':' || run)), 2 * i - 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM doc_runs, crc_table
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION
  SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest
),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs
),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
    CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
