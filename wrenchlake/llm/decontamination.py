"""Benchmark decontamination by spaced seeds: finds benchmark passages in documents, also where words were replaced.

Method: fixed masks pick some words of a span and ignore the others; the hashes of what they pick are joined between
benchmark items and documents, and around each hit the words on the same diagonal (document place less item place) are
compared one by one.  Equal stretches of all items are one class: joined and compared once, and put at their places in the
items only where they match; so a beginning that thousands of items share costs what one costs until then.  A stretch of ``min_words`` words (all words of a shorter item) with at most ``SUBSTITUTIONS``
substitutions, wherever they are, belongs to an overlap; stretches that touch are one overlap, which is reported without
substitutions at its ends.  A stretch under 13 words may have fewer substitutions in proportion: one from 7 words on, none
below.  With the default masks every such stretch is hit.

The join runs inside the documents' scan, so no document hash is shuffled.  Items of the same words are one item, named by
their smallest item_id.  An item over ``PIECE`` words is cut into pieces that share ``SHARED`` words; each piece knows its
place in the item and the item's whole length, so thresholds are the item's and overlaps of neighbouring pieces become one.
Pieces are dealt to blocks by running sums, at most ``BLOCK_WORDS`` words a block whatever the benchmark's size; the documents
are scanned once for each block.

Defined results: A-Z is lower-cased; null or blank items match nothing; null text counts as empty; repeated items are reported
by their smallest item_id (null if none has one; ``item_classes`` tells who is who), repeated rows alike; rows with null
doc_id are reported with null doc_id; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import KEYS
from .store import stored
from .text import Block, blocks, column, mix, ranges, unused, windows

MIN_WORDS = 13
SUBSTITUTIONS = 2
#: Words of an exact part that a mask picks at most, and pairs or rows that are looked at together.
WEIGHT = 16
TOGETHER = 1 << 19
BLOCK_WORDS = 1_000_000
PIECE = 50_000
SHARED = 1_000


def allowed(size: int) -> int:
    """Substitutions in a stretch of ``size`` words."""
    return min(SUBSTITUTIONS, SUBSTITUTIONS * size // MIN_WORDS)


def masks(size: int) -> list[str]:
    """Fixed masks for stretches of ``size`` words.  Without the substitutions at its ends a stretch is shorter by their number,
    begins and ends with equal words, and has the others inside; of as many parts and one more, one is free of them.  A mask
    picks both ends and one part."""
    out = []
    for cut in range(allowed(size) + 1):
        n, parts = size - cut, allowed(size) - cut + 1
        ends = [1 + (n - 2) * i // parts for i in range(parts + 1)]
        for a, b in zip(ends, ends[1:], strict=False):
            out.append("".join("1" if i in (0, n - 1) or a <= i < min(b, a + WEIGHT) else "0" for i in range(n)))
    return out


MASKS = masks(MIN_WORDS)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of what the mask picks at each place (the last places, where the span does not fit, are left out)."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1" and n > 0:
            out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
    return mix(out)


class Stretches:
    """The stretches of ``length`` words in the pieces of window size ``size``.  Those of equal words with equal room beside them
    are one class, so what many items share is verified once; classes that always follow one another are a chain."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, of: np.ndarray, size: int, length: int):
        self.size, self.length, self.cut = size, length, size - length
        at, h = windows(words, doc, length)
        piece = doc[at]
        left, right = np.minimum(at - first[piece], self.cut), np.minimum(last[piece] - at - length, self.cut)
        kept = of[piece] & (left + right >= self.cut)
        at, code = at[kept], (left * (SUBSTITUTIONS + 1) + right)[kept]
        key = mix(h[kept] + code.astype(np.uint64))
        _, rep, of_key, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        # Classes go by their first place; a class's places follow one another.
        by = np.argsort(rep)
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        of_place = rank[of_key]
        order = np.argsort(of_place, kind="stable")
        self.places, self.n = at[order], n[by]
        self.starts = np.cumsum(self.n) - self.n
        self.rep, self.left, self.right = at[rep[by]], left[kept][rep[by]], right[kept][rep[by]]
        self.span = len(words) + 1
        self.key = of_place[order] * self.span + self.places
        self.head = np.arange(len(by))
        if len(by):
            classes = np.full(len(words) + 1, -1, dtype=np.int64)
            classes[at] = of_place
            following = np.where(np.append(doc, -1)[self.places + 1] == doc[self.places], classes[self.places + 1], -1)
            low, high = np.minimum.reduceat(following, self.starts), np.maximum.reduceat(following, self.starts)
            linked = (low == high) & (low >= 0) & (self.n[low] == self.n)
            opens = np.concatenate(([True], ~linked[:-1]))
            self.head = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        self.bits = min(23, 5 + len(by).bit_length())
        self.tables = []
        for mask in masks(size):
            if len(mask) == length and len(by):
                seeds = seed_hashes(words, mask)[self.rep]
                order = np.argsort(seeds, kind="stable")
                held = np.zeros(1 << self.bits, dtype=bool)
                held[(seeds >> np.uint64(64 - self.bits)).astype(np.int64)] = True
                self.tables.append((mask, seeds[order], order, held))

    def matches(self, own: np.ndarray, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, class) of the documents' stretches that equal a class of the pieces' words ``own`` but for the substitutions."""
        pairs = [np.empty(0, np.int64)]
        for mask, seeds, classes, held in self.tables:
            h = seed_hashes(words, mask)
            if not len(h):
                continue
            at = np.flatnonzero(held[(h >> np.uint64(64 - self.bits)).astype(np.int64)] & (doc[: len(h)] == doc[len(mask) - 1 :][: len(h)]))
            lo, hi = np.searchsorted(seeds, h[at]), np.searchsorted(seeds, h[at], side="right")
            ends = np.cumsum(hi - lo)
            total = int(ends[-1]) if len(ends) else 0
            for x in range(0, total, TOGETHER):
                number = np.arange(x, min(x + TOGETHER, total))
                i = np.searchsorted(ends, number, side="right")
                c, s = classes[hi[i] - (ends[i] - number)], at[i]
                wrong = np.zeros(len(s), dtype=np.int64)
                for j in range(self.length):
                    differs = words[s + j] != own[self.rep[c] + j]
                    wrong += differs * (SUBSTITUTIONS + 1 if j in (0, self.length - 1) else 1)
                # What is equal throughout is found as stretches of the shortest length.
                good = (wrong <= allowed(self.size) - self.cut) & ((wrong > 0) | (self.cut == allowed(self.size)))
                pairs.append(s[good] * len(self.rep) + c[good])
        found = np.unique(np.concatenate(pairs))
        return found // max(len(self.rep), 1), found % max(len(self.rep), 1)

    def stretches(self, own: np.ndarray, words: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows of (document, head of the chain, its place, start and end of the windows, first and last + 1 equal word)."""
        s, c = self.matches(own, words, doc)
        d = doc[s]
        # A window may reach beyond the equal words at both ends where piece and document have room.
        least = np.maximum(0, self.cut - np.minimum(self.right[c], last[d] - s - self.length))
        most = np.minimum(self.left[c], s - first[d])
        s, c, d, least, most = (x[least <= most] for x in (s, c, d, least, most))
        head = self.head[c]
        rows = np.stack([d, head, s - (self.rep[c] - self.rep[head]), s - most, s - least + self.size, s, s + self.length], axis=1)
        return joined(rows, 3)


def joined(rows: np.ndarray, keys: int) -> np.ndarray:
    """Rows of ``keys`` keys, window start and end, first and last + 1 word, with those of one key whose windows touch made one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows[:, keys::-1].T)]
    opens = np.concatenate(([True], (rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)))
    group, step = np.cumsum(opens), int(rows[:, keys + 1].max() - rows[:, keys].min()) + 1
    reach = np.maximum.accumulate(rows[:, keys + 1] + group * step)
    opens[1:] |= rows[1:, keys] + group[1:] * step > reach[:-1]
    at = np.flatnonzero(opens)
    columns = [np.maximum.reduceat(rows[:, keys + 1], at), np.minimum.reduceat(rows[:, keys + 2], at), np.maximum.reduceat(rows[:, keys + 3], at)]
    return np.column_stack([rows[at, : keys + 1], *columns])


class Seeds:
    """A block of pieces of benchmark items (item, first word in the item, words of the whole item, text): their words' hashes,
    and the stretches that overlaps consist of, by the hashes of what the masks pick."""

    def __init__(self, pieces: list[tuple[int, int, int, bytes]]):
        block = Block([t for *_, t in pieces], lower=True)
        self.doc = block.words()[2]
        self.words = block.word_hashes()
        self.items, self.offsets, self.whole = (np.array([p[i] for p in pieces], dtype=np.int64) for i in range(3))
        self.first = np.searchsorted(self.doc, np.arange(block.n))
        self.last = np.searchsorted(self.doc, np.arange(block.n), side="right")
        self.tables: dict[int, list[Stretches]] = {}

    def stretches(self, min_words: int) -> list[Stretches]:
        if min_words not in self.tables:
            sizes = np.minimum(self.whole, min_words)
            made = [(int(n), n - cut) for n in np.unique(sizes[sizes > 0]).tolist() for cut in range(allowed(n) + 1)]
            self.tables[min_words] = [Stretches(self.words, self.doc, self.first, self.last, sizes == n, n, length) for n, length in made]
        return self.tables[min_words]

    def parts(self, words: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int):
        """What ``overlaps`` returns, in parts of about ``TOGETHER`` rows."""
        every = [(t, t.stretches(self.words, words, doc, first, last)) for t in self.stretches(min_words)]
        every = [(t, rows) for t, rows in every if len(rows)]
        weight = sum((np.bincount(rows[:, 0], weights=t.n[rows[:, 1]], minlength=len(first)) for t, rows in every), np.zeros(len(first)))
        part = ((np.cumsum(weight) - weight) // TOGETHER).astype(np.int64)
        for i in np.unique(part[weight > 0]):
            chosen = [(t, rows[part[rows[:, 0]] == i]) for t, rows in every]
            # A document that meets more places than one part holds takes the pieces by turns.
            turns = -(-int(weight[part == i].sum()) // (2 * TOGETHER))
            bounds = self.first[np.linspace(0, len(self.first), turns + 1).astype(np.int64)[1:-1]].tolist()
            for lo, hi in zip([0, *bounds], [*bounds, len(self.words)], strict=True):
                got = joined(np.concatenate([self.placed(t, rows, lo, hi) for t, rows in chosen]), 3)
                d, piece, start = got[:, 0], got[:, 1], got[:, 2]
                yield np.column_stack([d, self.items[piece], start - first[d] - self.offsets[piece], got[:, 5] - first[d], got[:, 6] - first[d]])

    def placed(self, table: Stretches, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Stretches at each of their places from ``lo`` to ``hi``: (document, piece, diagonal start in the block's words, ...)."""
        a, b = (np.searchsorted(table.key, rows[:, 1] * table.span + x) for x in (lo, hi))
        each = np.repeat(rows, b - a, axis=0)
        place = table.places[ranges(a, b)]
        piece = self.doc[place]
        return np.column_stack([each[:, 0], piece, each[:, 2] - (place - self.first[piece]), each[:, 3:]])

    def overlaps(self, words: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int) -> np.ndarray:
        """(document, item, diagonal, first and last + 1 word in the document) of each overlap.  The diagonal is the document
        word that faces the item's first word, so it is the same for all pieces of an item."""
        return np.concatenate([np.empty((0, 5), np.int64), *self.parts(words, doc, first, last, min_words)])


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """item_id, w (words, A-Z lower-cased) and the item's key of each item with a word; items of the same words share a key."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.regexp_extract_all(low, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    return words.where("size(w) > 0").withColumn("item", F.xxhash64("w"))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """item_id and same_as, the smallest item_id with the same words, of each item with a word."""
    rows = benchmark_words(benchmark).select("item_id", "item")
    return rows.join(rows.groupBy("item").agg(F.min("item_id").alias("same_as")), "item").select("item_id", "same_as")


def item_blocks(benchmark: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(item, item_id) of the distinct items, and their pieces (item, at, whole, text) in blocks of BLOCK_WORDS words at most."""
    distinct = benchmark_words(benchmark).groupBy("item").agg(F.min("item_id").alias("item_id"), F.first("w").alias("w"))
    at = F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - SHARED - 1, F.lit(0)) / PIECE).cast("int"))
    cut = distinct.select("item", "item_id", "w", F.explode(at).alias("i")).withColumn("part", F.slice("w", F.col("i") * PIECE + 1, PIECE + SHARED))
    pieces = stored(cut.select("item", "item_id", (F.col("i") * PIECE).alias("at"), F.size("w").alias("whole"), F.size("part").alias("n"), F.array_join("part", " ").alias("text")), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    # Buckets of about half a block, by a hash of distinct pieces; what a bucket holds beyond a block opens further ones.
    bucket = F.pmod(F.xxhash64("item", "at"), F.lit(max(1, -(-2 * total // BLOCK_WORDS)))).cast("int")
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("item", "at")) - F.col("n")
    dealt = stored(pieces.withColumn("bucket", bucket).withColumn("slot", F.floor(before / (BLOCK_WORDS - PIECE - SHARED)).cast("int")), "blocks")
    blocks = sorted(tuple(r) for r in dealt.select("bucket", "slot").distinct().collect())
    return dealt.where("at = 0").select("item", "item_id"), [dealt.where((F.col("bucket") == b) & (F.col("slot") == s)).select("item", "at", "whole", "text") for b, s in blocks]


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, item_id, first, last) of each overlap: a row's keys, the item, and the words it covers (last excluded)."""
    if not 0 < min_words <= SHARED:
        raise ValueError(f"min_words must be from 1 to {SHARED}")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), F.col("text").cast("string").alias("text"))
    context = rows.sparkSession.sparkContext
    found = rows.sparkSession.createDataFrame([], OVERLAPS)
    names, blocks = item_blocks(benchmark)
    for block in blocks:
        got = block.orderBy("item", "at").toArrow()
        texts = [t.encode() for t in got.column("text").to_pylist()]
        pieces = list(zip(got.column("item").to_pylist(), got.column("at").to_pylist(), got.column("whole").to_pylist(), texts, strict=True))
        found = found.union(rows.mapInArrow(overlap_rows(context.broadcast(pieces), min_words), OVERLAPS))
    # Overlaps that touch on one diagonal are one: those of neighbouring pieces of a long item, and those of equal rows.
    diagonal = Window.partitionBy(*KEYS, "item", "diagonal").orderBy("first", "last")
    reach = F.max("last").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first") <= reach, 0).otherwise(1)
    each = stored(found.distinct(), "found").withColumn("opens", opens).withColumn("run", F.sum("opens").over(diagonal))
    merged = each.groupBy(*KEYS, "item", "diagonal", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.join(names, "item").select(*KEYS, "item_id", "first", "last")


OVERLAPS = "k1 long, k2 long, item long, diagonal int, first int, last int"


def overlap_rows(seeds, min_words: int):
    """Partitions of rows to their overlaps, handed on in parts, however many there are."""

    def run(batches):
        held = None
        for batch, texts in blocks(batches):
            held = held or Seeds(seeds.value)
            block = Block(texts, lower=True)
            doc = block.words()[2]
            first, last = np.searchsorted(doc, np.arange(block.n)), np.searchsorted(doc, np.arange(block.n), side="right")
            k1, k2 = column(batch, "k1").to_numpy(), column(batch, "k2").to_numpy()
            for found in held.parts(block.word_hashes(), doc, first, last, min_words):
                d, item, *rest = found.T
                yield pa.RecordBatch.from_pydict({"k1": k1[d], "k2": k2[d], "item": item} | {c: x.astype(np.int32) for c, x in zip(("diagonal", "first", "last"), rest, strict=True)})

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), n_items and longest (words of the longest overlap) of each document."""
    found = overlaps(docs, benchmark, min_words).groupBy(*KEYS).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("last") - F.col("first")).cast("long").alias("longest"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"))
    none = F.array().cast("array<long>")
    return rows.join(stored(found, "overlaps"), KEYS, "left").select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("longest", F.lit(0)).alias("longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item."""
    a, b = unused(docs, "k1"), unused(docs, "k2")
    found = stored(overlaps(docs, benchmark, min_words).select(*KEYS).distinct(), "contaminated").toDF(a, b)
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) == F.col(a)) & (F.xxhash64("text") == F.col(b))
    return docs.join(found, same, "left_anti")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
