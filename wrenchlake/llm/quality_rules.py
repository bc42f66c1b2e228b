"""Quality rules: hashed word and character n-gram logistic regression, calibrated, scored against fixed thresholds.

Base rules count words, characters, symbols, repeated lines and repeated words of every whole text.  The model adds a
probability of good quality: words, word pairs and runs of four UTF-8 bytes are hashed into ``BUCKETS`` weights; each family's
weights are averaged over the text.  Weights are learned by logistic regression on labelled quality rows, and two further
parameters (Platt scaling) calibrate the probability on labelled rows that the weights have not seen.

At most ``max_rows`` labelled rows teach the model, each with at most 2 * BUCKETS counts (a bounded sample in the order of a
hash of doc_id); rows with crc32(doc_id as text) mod 4 of 2 never do, and those of 1 calibrate.

Defined results: null text counts as empty; a text under 50 words fails the base rules; labels with null doc_id or quality
teach nothing; without labels of both kinds the model lets every text pass; equal texts get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_gam import repeated_words, sample_labels
from .text import Block, byte_tables, column, mix, range_hash, scan

BITS = 17
BUCKETS = 1 << BITS
CHARS = 4
MAX_TRAIN_ROWS = 3_000
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEEP_PROBABILITY = 0.5


def base_counts(block: Block, texts: list[bytes]) -> dict[str, np.ndarray]:
    starts, ends, doc = block.words()
    first_byte = (block.bytes & 0xC0) != 0x80
    total = np.concatenate(([0], np.cumsum(first_byte & ~byte_tables()["space"][block.bytes])))
    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    symbols = np.concatenate(([0], np.cumsum(symbol[block.bytes])))
    repeated_lines = np.zeros(block.n, dtype=np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\v\f\r")]
        repeated_lines[i] = len(lines) - len(set(lines))
    return {
        "n_words": block.count(doc).astype(np.int64),
        "word_chars": (total[block.ends] - total[block.starts]).astype(np.int64),
        "n_symbols": (symbols[block.ends] - symbols[block.starts]).astype(np.int64),
        "n_dup_lines": repeated_lines,
        "n_repeat_words": block.count(doc, repeated_words(block)).astype(np.int64),
    }


def hashed(block: Block) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Buckets and documents of the word features (words and word pairs), and of the character features
    (runs of CHARS characters)."""
    doc, words = block.words()[2], block.word_hashes()
    shift = np.uint64(64 - BITS)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = mix(words[pair] * np.uint64(3) + words[pair + 1]) >> shift
    first, of = characters(block)
    at = np.flatnonzero(of[:-CHARS] == of[CHARS:]) if len(of) > CHARS else np.empty(0, np.int64)
    chars = range_hash(byte_tables()["value"][block.bytes], first[at], first[at + CHARS]) >> shift
    return (np.concatenate((words >> shift, pairs)).astype(np.int64), np.concatenate((doc, doc[pair]))), (chars.astype(np.int64), of[at])


def characters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """First byte and document of each character (code point); the space behind a document is its last one."""
    first = np.flatnonzero((block.bytes & 0xC0) != 0x80)
    return first, np.searchsorted(block.starts, first, side="right") - 1


@dataclass
class NgramModel:
    """Weights of word and character buckets, and the calibration's slope and offset; without weights all texts pass."""

    words: np.ndarray | None
    chars: np.ndarray | None
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, block: Block) -> np.ndarray:
        out = np.zeros(block.n)
        for (at, doc), w in zip(hashed(block), (self.words, self.chars), strict=True):
            out += block.count(doc, w[at]) / np.maximum(block.count(doc), 1)
        return out

    def probability(self, block: Block) -> np.ndarray:
        if self.words is None:
            return np.ones(block.n)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(block) + self.offset, -30, 30)))


def regress(at: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression by full-batch Adam steps on rows given as (bucket, row, value); the last weight is the bias."""
    n, size = len(y), 2 * BUCKETS + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for t in range(1, epochs + 1):
        z = np.bincount(doc, w[at] * x, n) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(at, e[doc] * x, size) + decay * w / n
        g[-1] = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate raw scores, by Newton steps on Platt's smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    a = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        a += np.clip(step, -5, 5)
    return float(a[0]), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> NgramModel:
    chosen = F.broadcast(sample_labels(labels, label, max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(chosen, "_id").select("_id", "_y", "text")

    def kernel(batch, texts):
        block = Block(texts)
        at, value = [[] for _ in texts], [[] for _ in texts]
        for family, (bucket, doc) in enumerate(hashed(block)):
            key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
            for i in range(len(texts)):
                own = slice(cut[i], cut[i + 1])
                at[i].append((key[own] % BUCKETS + family * BUCKETS).astype(np.int32))
                value[i].append((n[own] / max(n[own].sum(), 1)).astype(np.float32))
        return {"id": column(batch, "_id"), "y": column(batch, "_y"), "at": [np.concatenate(a).tobytes() for a in at], "x": [np.concatenate(v).tobytes() for v in value]}

    got = scan(rows, "id long, y int, at binary, x binary", kernel).withColumn("fold", F.crc32(F.col("id").cast("string")) % 4)
    got = got.orderBy(F.xxhash64("id"), "id", "y", "at", "x").limit(max_rows).toArrow()
    y, fold = got.column("y").to_numpy().astype(float), got.column("fold").to_numpy()
    if not len(y) or y.min() == y.max():
        return NgramModel(None, None)
    at = [np.frombuffer(a, dtype=np.int32) for a in got.column("at").to_pylist()]
    x = [np.frombuffer(a, dtype=np.float32) for a in got.column("x").to_pylist()]
    learn = fold != 1 if 0 < y[fold != 1].sum() < (fold != 1).sum() else np.ones(len(y), dtype=bool)
    flat = lambda parts: np.concatenate([p for p, k in zip(parts, learn, strict=True) if k])
    doc = np.repeat(np.arange(int(learn.sum())), [len(a) for a, k in zip(at, learn, strict=True) if k])
    w = regress(flat(at), doc, flat(x), y[learn])
    rest = ~learn if 0 < y[~learn].sum() < (~learn).sum() else learn
    z = np.array([float(w[a] @ b) for a, b, k in zip(at, x, rest, strict=True) if k])
    slope, offset = platt(z, y[rest])
    return NgramModel(w[:BUCKETS].astype(np.float32), w[BUCKETS:-1].astype(np.float32), slope, offset)


def quality_rules(docs: DataFrame, model: NgramModel, keep: float = KEEP_PROBABILITY) -> DataFrame:
    """doc_id, counts, base_failed, probability and kept of each document."""

    def kernel(batch, texts):
        block = Block(texts)
        return {"doc_id": column(batch, "doc_id"), **base_counts(block, texts), "probability": model.probability(block)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scan(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double", kernel)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
