"""Toxic spans by a linear-chain conditional random field, and document scores.

Tokens are runs of letters and digits. The chain has two states (clean, toxic);
a token's emission is the sum of the weights of its word and of its leading
bytes, so unseen inflections of a stem get the weight of the stem. Only
document labels are given: tokens of toxic training documents are labelled
toxic where their word or stem occurs in far more toxic than clean documents,
all others clean; the field is fitted to these tokens of all training documents. Marginals from
the forward-backward recursion are summed up per document, and a logistic
regression on the sums gives the score.

Model fitting reads a bounded sample of labelled rows (``max_toxic``,
``max_clean``), drawn by hash. Scoring covers every row and every token.

Null and empty texts have no tokens and get the score of an empty document.
Without labels of both kinds every score is the share of toxic labels (0 if
there are none). Repeated rows are scored one by one. Other columns pass
through; a column named like an output is replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.llm.common import fit_logistic, map_texts, sigmoid

TOKEN = re.compile(r"[^\W_]+")
BITS = 18
STEMS = range(2, 11)
BLOCK = 256
CACHED_WORDS = 500_000
CHAIN_TOKENS = 300_000
OUTPUTS = T.StructType(
    [
        T.StructField("toxicity", T.DoubleType()),
        T.StructField(
            "toxic_spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("probability", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


@dataclass
class ToxicityModel:
    """Weights by feature hash, transition scores and the document regression."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(5))


def features(word: str) -> list[int]:
    """Hashes of the word and of its leading bytes."""
    raw = word.lower().encode()
    mask, out = (1 << BITS) - 1, [zlib.crc32(raw, 7) & ((1 << BITS) - 1)]
    stem = zlib.crc32(raw[: STEMS.start])
    for k in STEMS:
        if k >= len(raw):
            break
        out.append(stem & mask)
        stem = zlib.crc32(raw[k : k + 1], stem)
    return out


class Emissions(dict):
    """Word -> emission score; words are looked up again once the table is full."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        score = self[word] = float(self.weights[features(word)].sum())
        return score


def steps(emission: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> list[np.ndarray]:
    """Entries of the step matrices of all chains, laid out in columns of blocks.

    A chain's first step does not depend on the state before it, so the chains
    of many documents form one long chain.
    """
    n = len(emission)
    width = -(-n // BLOCK)
    odds = np.exp(np.clip(emission, -20, 20))
    t = np.exp(transitions - transitions.max())
    m = [np.full(n, t[0, 0]), t[0, 1] * odds, np.full(n, t[1, 0]), t[1, 1] * odds]
    m[0][starts], m[2][starts] = 1.0, 1.0
    m[1][starts], m[3][starts] = odds[starts], odds[starts]
    out = []
    for entry, identity in zip(m, (1.0, 0.0, 0.0, 1.0)):
        padded = np.full(width * BLOCK, identity)
        padded[:n] = entry
        out.append(np.ascontiguousarray(padded.reshape(width, BLOCK).T))
    return out


def forward_backward(emission: np.ndarray, starts: np.ndarray, transitions: np.ndarray):
    """Probability of the toxic state per token; also the sums of pair probabilities.

    The products over blocks of steps are formed for all blocks at once; a short
    loop over blocks then gives the vectors that enter and leave each block.
    """
    n = len(emission)
    if n == 0:
        return np.zeros(0), np.zeros((2, 2))
    a, b, c, d = steps(emission, starts, transitions)
    width = a.shape[1]
    p = [np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)]
    for k in range(BLOCK):
        q = [p[0] * a[k] + p[1] * c[k], p[0] * b[k] + p[1] * d[k], p[2] * a[k] + p[3] * c[k], p[2] * b[k] + p[3] * d[k]]
        total = q[0] + q[1] + q[2] + q[3]
        p = [x / total for x in q]
    product = np.stack(p, 1).tolist()
    entering, leaving = np.empty((width, 2)), np.empty((width, 2))
    x, y = 0.5, 0.5
    for i, (pa_, pb, pc_, pd) in enumerate(product):
        entering[i] = x, y
        x, y = x * pa_ + y * pc_, x * pb + y * pd
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for i in range(width - 1, -1, -1):
        leaving[i] = x, y
        pa_, pb, pc_, pd = product[i]
        x, y = pa_ * x + pb * y, pc_ * x + pd * y
        x, y = x / (x + y), y / (x + y)
    before = np.empty((BLOCK, width))  # share of the toxic state before each step
    f1 = entering[:, 1]
    after = np.empty((BLOCK, width))
    for k in range(BLOCK):
        before[k] = f1
        u, v = (1 - f1) * a[k] + f1 * c[k], (1 - f1) * b[k] + f1 * d[k]
        f1 = v / (u + v)
        after[k] = f1
    g1 = leaving[:, 1]
    behind = np.empty((BLOCK, width))
    for k in range(BLOCK - 1, -1, -1):
        behind[k] = g1
        u, v = a[k] * (1 - g1) + b[k] * g1, c[k] * (1 - g1) + d[k] * g1
        g1 = v / (u + v)
    toxic = after * behind
    marginal = (toxic / (toxic + (1 - after) * (1 - behind))).T.reshape(-1)[:n]
    pairs = [(1 - before) * a * (1 - behind), (1 - before) * b * behind, before * c * (1 - behind), before * d * behind]
    total = pairs[0] + pairs[1] + pairs[2] + pairs[3]
    inner = np.ones(n, bool)
    inner[starts] = False
    sums = [float((x / total).T.reshape(-1)[:n][inner].sum()) for x in pairs]
    return marginal, np.array(sums).reshape(2, 2)


def document_inputs(marginal: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Regression inputs per document from its tokens' marginals."""
    out = np.zeros((len(counts), 5))
    out[:, 0] = 1.0
    full = np.flatnonzero(counts)
    if len(full):
        first = (np.cumsum(counts) - counts)[full]
        total, most = np.add.reduceat(marginal, first), np.maximum.reduceat(marginal, first)
        out[full, 1], out[full, 2] = np.log1p(total), most
        out[full, 3], out[full, 4] = np.sqrt(total / counts[full]), np.log1p(counts[full]) / 10
    return out


def fit_rows(texts: list[str], toxic: list[int], prior: float, rounds: int = 60) -> ToxicityModel:
    """Fit on labelled texts; ``prior`` is the share of toxic labels before the draw."""
    model = ToxicityModel()
    rows = list(dict.fromkeys(zip(texts, toxic)))
    y = np.array([t for _, t in rows], np.int64)
    if len(rows) == 0 or y.min() == y.max():
        model.document[0] = np.log((prior + 1e-9) / (1 - prior + 1e-9))
        return model
    words: dict[str, int] = {}
    ids = [np.array([words.setdefault(w, len(words)) for w in TOKEN.findall(t)], np.int32) for t, _ in rows]
    found, size = array("i"), np.zeros(len(words), np.int64)
    for k, w in enumerate(words):
        own = features(w)
        found.extend(own)
        size[k] = len(own)
    flat = np.frombuffer(found, np.int32).astype(np.int64) if len(found) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size

    def of_words(distinct: np.ndarray) -> np.ndarray:
        take = np.repeat(first[distinct] - np.cumsum(size[distinct]) + size[distinct], size[distinct])
        return flat[take + np.arange(len(take))]

    # documents with each feature, by label
    seen = np.zeros((2, 1 << BITS))
    for i, label in zip(ids, y):
        if len(i):
            seen[label, np.unique(of_words(np.unique(i)))] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    lower = odds - 1.645 * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    marked = np.zeros(len(words), bool)
    if len(words):
        marked = np.maximum.reduceat(lower[flat], first) > 2.0

    # token labels; the field is fitted to all rows, chains of some documents at a time bound the memory
    counts = np.array([len(i) for i in ids])
    part = np.cumsum(counts) // CHAIN_TOKENS
    parts = list(pairwise([*np.flatnonzero(np.diff(part, prepend=-1)), len(ids)]))
    if len(words):
        chains, pair = [], np.zeros((2, 2))
        for i, j in parts:
            count = counts[i:j]
            token = np.concatenate(ids[i:j])
            if not len(token):
                continue
            starts = (np.cumsum(count) - count)[count > 0]
            target = marked[token] & np.repeat(y[i:j] == 1, count)
            inner = np.ones(len(token), bool)
            inner[starts] = False
            np.add.at(pair, (np.roll(target, 1)[inner].astype(int), target[inner].astype(int)), 1)
            chains.append((token, starts, target))
        w, t = np.zeros(1 << BITS), np.zeros((2, 2))
        bias, speed, tspeed, bspeed = -4.0, np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
        for _ in range(rounds):
            emission = np.add.reduceat(w[flat], first) + bias
            by_word, sums = np.zeros(len(words)), np.zeros((2, 2))
            for token, starts, target in chains:
                marginal, own = forward_backward(emission[token], starts, t)
                by_word += np.bincount(token, target - marginal, len(words))
                sums += own
            gradient = np.bincount(flat, np.repeat(by_word, size), 1 << BITS) - 0.05 * w
            speed += gradient**2
            w += 0.5 * gradient / np.sqrt(speed)
            tgrad, bgrad = pair - sums - 0.05 * t, by_word.sum()
            tspeed, bspeed = tspeed + tgrad**2, bspeed + bgrad**2
            t += 0.2 * tgrad / np.sqrt(tspeed)
            bias += 0.2 * bgrad / np.sqrt(bspeed)
        model.weights, model.bias, model.transitions = w.astype(np.float32), float(bias), t

    emission = np.add.reduceat(model.weights[flat], first) if len(words) else np.zeros(0)
    marginal = np.concatenate([chain(emission[np.concatenate(ids[i:j])], counts[i:j], model) for i, j in parts])
    share = np.array([prior, 1 - prior])
    weight = np.where(y == 1, share[0] / n1, share[1] / n0) * len(y)
    model.document = fit_logistic(document_inputs(marginal, counts), y.astype(float), weight)
    return model


def chain(emission: np.ndarray, counts: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """Marginals of the tokens of many documents."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    return forward_backward(emission + model.bias, starts, model.transitions)[0]


def scorer(model: ToxicityModel):
    """Function from texts to scores and spans."""
    emissions = Emissions(model.weights)
    lookup = emissions.__getitem__

    def score(texts: list[str]):
        scores = [list(map(lookup, TOKEN.findall(t))) for t in texts]
        counts = np.array([len(s) for s in scores], np.int64)
        marginal = chain(np.array([x for s in scores for x in s], float), counts, model)
        value = sigmoid(document_inputs(marginal, counts) @ model.document)
        ends, spans = np.cumsum(counts), []
        for text, end, count in zip(texts, ends, counts):
            p, found = marginal[end - count : end], []
            if count and p.max() > 0.5:
                hot = p > 0.5
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hot, [False]])))
                place = [m.span() for m in TOKEN.finditer(text)]
                for i, j in zip(edges[::2], edges[1::2]):
                    found.append((place[i][0], place[j - 1][1], float(p[i:j].max())))
            spans.append(found)
        return pa.array(value), pa.array([[dict(zip(("start", "end", "probability"), s)) for s in f] for f in spans], SPANS)

    return score


def fit(
    documents: DataFrame,
    labels: DataFrame,
    max_toxic: int = 2000,
    max_clean: int = 4000,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> ToxicityModel:
    """Fit on at most ``max_toxic + max_clean`` labelled rows, drawn by a hash of their id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(id_column, label).distinct()
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    draw = F.xxhash64(F.lit("toxicity"), F.col(id_column))
    parts = [known.where(F.col(label) == v).orderBy(draw, id_column).limit(m) for v, m in ((1, max_toxic), (0, max_clean))]
    drawn = parts[0].unionByName(parts[1]).collect()
    spark = documents.sparkSession
    chosen = spark.createDataFrame(drawn, known.schema)
    rows = documents.select(id_column, text).join(F.broadcast(chosen), id_column).collect()
    rows.sort(key=lambda r: (r[id_column], r[text] or ""))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_rows([r[text] or "" for r in rows], [r[label] for r in rows], prior)


def score(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Append ``toxicity`` (0 to 1) and ``toxic_spans`` (character offsets) to every row."""
    return map_texts(documents, text, OUTPUTS, lambda: scorer(model))
