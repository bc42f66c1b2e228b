"""Quality classifier: a generalised additive model with pairwise interactions.

Method: each feature of a text is cut into bins; boosted shallow trees, one feature after another in many cycles, learn a
lookup table for each feature, and then for the pairs of features that explain most of what is left.  A text's score is the
logistic of a sum of table entries, so scoring is one vectorised addition for each table.

Only rows with crc32(doc_id as text) mod 4 other than 2 teach the model, at most ``max_rows`` of them (a bounded sample,
taken in the order of a hash of doc_id; the sample's features are all that reaches the driver).  Features come from the
text alone.

Defined results: null and empty texts have features of zero and get a score like any other; labels with null doc_id or
quality teach nothing; without labels of both kinds every score is the share of label 1 (0.5 without labels); repeated
labels count as often as they occur; equal texts get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Block, blocks, byte_tables, column, mix, scan, windows

FEATURES = ["log_words", "mean_word_bytes", "symbols", "upper", "exclamations", "digits", "repeated_words", "distinct_words", "short_words", "stops", "non_ascii", "longest_word", "log_line_words", "doubled_symbols"]
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.7
PAIR_BINS = 8


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def repeated_words(block: Block, k: int = 3) -> np.ndarray:
    """Which words lie in a k-word window that occurs twice or more in the same document."""
    doc = block.words()[2]
    at, h = windows(block.word_hashes(), doc, k)
    key = mix(h + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    change = np.zeros(len(doc) + k + 1, dtype=np.int32)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + k, -1)
    return np.cumsum(change)[: len(doc)] > 0


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    block = Block(texts)
    b, n = block.bytes, block.n
    starts, ends, doc = block.words()
    size = ends - starts
    words = block.count(doc).astype(float)
    some = np.maximum(words, 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[b])))
        return (total[block.ends] - total[block.starts]).astype(float)

    def of(chars: bytes) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[list(chars)] = True
        return table

    symbols, upper, lower = of(b"#*$%&|<>"), of(bytes(range(65, 91))), of(bytes(range(97, 123)))
    letters = np.maximum(share(upper) + share(lower), 1)
    spread = np.maximum(share(~byte_tables()["space"]), 1)
    key = mix(block.word_hashes() + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    first = np.ones(len(key), dtype=bool)
    first[order[1:]] = key[order][1:] != key[order][:-1]
    doubled = np.zeros(len(b), dtype=bool)
    doubled[1:] = (b[1:] == b[:-1]) & ~byte_tables()["space"][b[1:]] & ~(upper | lower)[b[1:]] & (b[1:] < 128)
    total = np.concatenate(([0], np.cumsum(doubled)))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size.astype(float))
    out = [
        np.log1p(words),
        block.count(doc, size.astype(float)) / some,
        share(symbols) / spread,
        share(upper) / letters,
        share(of(b"!")) / spread,
        share(of(b"0123456789")) / spread,
        block.count(doc, repeated_words(block).astype(float)) / some,
        block.count(doc, first.astype(float)) / some,
        block.count(doc, (size == 1).astype(float)) / some,
        share(of(b".,;:?")) / spread,
        share(np.arange(256) >= 128) / spread,
        np.log1p(longest),
        np.log1p(words / (share(of(b"\n")) + 1)),
        (total[block.ends] - total[block.starts]) / spread,
    ]
    return np.nan_to_num(np.stack(out, axis=1))


@dataclass
class Gam:
    """Cut points and lookup tables (log-odds) of single features and of pairs."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.single, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float = 4.0) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins: the best split of any leaf, until there are ``leaves`` of them."""
    g, h = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))
    edges = [0, len(grad)]
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(edges) <= leaves:
        best, cut = 1e-9, 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mid = np.arange(a + 1, b)
            if len(mid):
                gain = gain_of(a, mid) + gain_of(mid, b) - gain_of(a, b)
                gain[(h[mid] - h[a] < least * 0.01) | (h[b] - h[mid] < least * 0.01)] = 0
                if gain.max() > best:
                    best, cut = gain.max(), int(mid[gain.argmax()])
        if not cut:
            break
        edges = sorted([*edges, cut])
    out = np.empty(len(grad))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def cross_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Best tree of one cut on each axis of a grid of bins: its four leaves' Newton steps, and its gain."""
    g = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = g[1:-1, 1:-1], h[1:-1, 1:-1]
    parts_g = [a, g[1:-1, -1:] - a, g[-1:, 1:-1] - a, g[-1, -1] - g[1:-1, -1:] - g[-1:, 1:-1] + a]
    parts_h = [b, h[1:-1, -1:] - b, h[-1:, 1:-1] - b, h[-1, -1] - h[1:-1, -1:] - h[-1:, 1:-1] + b]
    gain = sum(x * x / (y + 1.0) for x, y in zip(parts_g, parts_h, strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = [x[i, j] / (y[i, j] + 1.0) for x, y in zip(parts_g, parts_h, strict=True)]
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain.max() - g[-1, -1] ** 2 / (h[-1, -1] + 1.0))


def train(x: np.ndarray, y: np.ndarray, cycles: int = 150, rate: float = 0.15, bins: int = 32, n_pairs: int = 4, pair_cycles: int = 40) -> Gam:
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.empty(0) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(y) else np.empty(0) for c in x.T]
    gam = Gam(cuts, coarse, [np.zeros(len(c) + 1) for c in cuts], [], base)
    if not len(y) or y.min() == y.max():
        return gam
    place = [np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)]
    rough = [np.searchsorted(c, v, side="right") for c, v in zip(coarse, x.T, strict=True)]
    total = np.full(len(y), base)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    for _ in range(cycles):
        for j, at in enumerate(place):
            p = sigmoid(total)
            size = len(cuts[j]) + 1
            step = rate * tree(np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size), leaves=3)
            gam.single[j] += step
            total += step[at]
    grids = {}
    for i in range(x.shape[1]):
        for j in range(i):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            if min(shape) > 1:
                grids[i, j] = (rough[i] * shape[1] + rough[j], shape)

    def grid(i: int, j: int) -> tuple[np.ndarray, float]:
        at, shape = grids[i, j]
        p = sigmoid(total)
        return cross_tree(np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape))

    gains = {k: grid(*k)[1] for k in grids}
    chosen = sorted(gains, key=gains.get, reverse=True)[:n_pairs]
    tables = {k: np.zeros(grids[k][1]) for k in chosen}
    for _ in range(pair_cycles):
        for k in chosen:
            step = rate * grid(*k)[0]
            tables[k] += step
            total += step.ravel()[grids[k][0]]
    gam.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return gam


def sample_labels(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` usable labels outside the held-out fold, in the order of a hash of doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    return usable.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Gam:
    """Trains on at most ``max_rows`` labelled rows; the sample has that bound, so it is broadcast to the documents' scan."""
    chosen = F.broadcast(sample_labels(labels, label, max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(chosen, "_id").select("_id", "_y", "text")

    def kernel(batch, texts):
        return {"id": column(batch, "_id"), "y": column(batch, "_y"), "x": list(features(texts))}

    # Repeated rows of one doc_id cannot widen the sample beyond its bound.
    got = scan(rows, "id long, y int, x array<double>", kernel).orderBy(F.xxhash64("id"), "id", "y", "x").limit(max_rows).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return train(x, got.column("y").to_numpy().astype(float))


def keep_good(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``; only texts pass through Python."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})
        return pd.Series(np.concatenate([model.score(features(part)) for _, part in blocks([batch])] or [np.empty(0)]))

    return docs.where(score(F.col("text").cast("string")) >= threshold)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def kernel(batch, texts):
        return {"doc_id": column(batch, "doc_id"), "score": model.score(features(texts))}

    scored = scan(rows, "doc_id long, score double", kernel)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
