"""Passages that occur more than once: the windows of a fixed length whose content starts anywhere else too.

Shared by substring dedup over words (op5) and suffix-array dedup over bytes (op3).  Moving every window of the corpus
would cost many times its size, so three exact reductions come first:

1. Anchors.  Each window picks the unit (byte or word) in it whose following ``gram`` units have the smallest hash.  Equal
   windows pick the same place, so a window can only repeat if the gram at its anchor does.  There is about one anchor for
   each ``(length - gram) / 2`` units; anchors whose gram is unique go.
2. Contexts.  An anchor's context holds all windows that picked it.  If the context occurs twice, all of them repeat, and
   they are settled without being moved.
3. What is left - anchors at the edges of repeated passages - is compared window by window, together with one
   representative of each settled context of the same gram.

Rows are keyed by doc_id and a hash of the text, so null and repeated doc_ids work: equal rows settle each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .text import Block, byte_tables, column, mix, range_hash, ranges, scan, unused, window_minima

KEYS = ["k1", "k2"]
SETTLED, COMPARE = 1, 2
RUN_BITS = 20


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), F.col("text").cast("string").alias("text"))


class Units:
    """A block as a sequence of units: hash values, and where each document's units start and end."""

    def __init__(self, texts: list[bytes], unit: str):
        self.block = Block(texts)
        if unit == "byte":
            self.values = byte_tables()["value"][self.block.bytes]
            self.starts, self.ends = self.block.starts, self.block.ends
        else:
            self.values = self.block.word_hashes()
            doc = self.block.words()[2]
            self.starts = np.searchsorted(doc, np.arange(self.block.n))
            self.ends = np.searchsorted(doc, np.arange(self.block.n), side="right")

    def anchors(self, length: int, gram: int) -> dict[str, np.ndarray]:
        """Of each anchor: place, document, and first and last window (by start) that picked it."""
        windows = ranges(self.starts, self.ends - length + 1)
        width = length - gram + 1
        if not len(windows):
            none = np.empty(0, np.int64)
            return {"at": none, "doc": none, "first": none, "last": none, "cls": none.astype(np.uint64)}
        n = len(self.values) - gram + 1
        grams = range_hash(self.values, np.arange(n), np.arange(n) + gram)
        picked = window_minima(grams, windows, width)
        edge = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
        last = np.concatenate((edge[1:], [len(picked)])) - 1
        at = picked[edge]
        return {"at": at, "doc": np.searchsorted(self.starts, at, side="right") - 1, "first": windows[edge], "last": windows[last], "cls": grams[at]}


def find_anchors(docs: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """(k1, k2, pos, cls, ctx) of each anchor of each row of ``keyed()`` documents."""

    def kernel(batch, texts):
        units = Units(texts, unit)
        a = units.anchors(length, gram)
        at, doc = a["at"], a["doc"]
        left = np.maximum(at - (length - gram), units.starts[doc])
        right = np.minimum(at + length, units.ends[doc])
        ctx = mix(range_hash(units.values, left, right) + (at - left).astype(np.uint64))
        return {
            "k1": column(batch, "k1").to_numpy()[doc],
            "k2": column(batch, "k2").to_numpy()[doc],
            "pos": (at - units.starts[doc]).astype(np.int32),
            "cls": a["cls"].view(np.int64),
            "ctx": ctx.view(np.int64),
        }

    return scan(docs, "k1 long, k2 long, pos int, cls long, ctx long", kernel)


def marked_documents(docs: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """Documents that hold an anchor whose gram repeats: k1, k2, text and marks (pos * 4 + SETTLED and COMPARE bits)."""
    anchors = find_anchors(docs, unit, length, gram)
    again = stored(anchors.groupBy("cls").count().where("count > 1").select("cls"), "again")
    alike = stored(anchors.join(again, "cls"), "anchors")
    # Stored, so that each join below has a plain shuffle on either side, which adaptive execution splits where a key is hot.
    contexts = stored(alike.groupBy("cls", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("rep")), "contexts")
    kinds = stored(contexts.groupBy("cls").agg(F.count("*").alias("kinds")), "kinds")
    roles = (
        alike.join(contexts, ["cls", "ctx"])
        .join(kinds, "cls")
        .withColumn("settled", F.col("n") > 1)
        .withColumn("compare", (F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("k1", "k2", "pos") == F.col("rep"))))
    )
    marks = (
        roles.select(*KEYS, (F.col("pos").cast("long") * 4 + F.col("settled").cast("long") * SETTLED + F.col("compare").cast("long") * COMPARE).alias("mark"))
        .groupBy(*KEYS)
        .agg(F.collect_set("mark").alias("marks"))
    )
    return stored(docs.join(marks, KEYS), "marked")


def marked_windows(batch, units: Units, length: int, gram: int, bit: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The anchors of a block, and which of them carry ``bit`` in the rows' marks."""
    a = units.anchors(length, gram)
    marks = column(batch, "marks")
    flat = marks.flatten().to_numpy()
    doc = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
    flat, doc = flat[(flat & bit) > 0], doc[(flat & bit) > 0]
    return a, np.isin(a["at"], units.starts[doc] + (flat >> 2))


def compared_windows(marked: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """(hash, k1, k2, start) of each window that must be compared."""

    def kernel(batch, texts):
        units = Units(texts, unit)
        a, wanted = marked_windows(batch, units, length, gram, COMPARE)
        first, last, doc = (a[k][wanted] for k in ("first", "last", "doc"))
        windows, doc = ranges(first, last + 1), np.repeat(doc, last + 1 - first)
        return {
            "hash": range_hash(units.values, windows, windows + length).view(np.int64),
            "k1": column(batch, "k1").to_numpy()[doc],
            "k2": column(batch, "k2").to_numpy()[doc],
            "start": (windows - units.starts[doc]).astype(np.int32),
        }

    return scan(marked, "hash long, k1 long, k2 long, start int", kernel)


def repeated_by_count(windows: DataFrame) -> DataFrame:
    """(k1, k2, start) of the windows whose hash is counted twice or more; rows without k1 count, but get no answer."""
    again = stored(windows.groupBy("hash").count().where("count > 1").select("hash"), "again")
    return windows.where("k1 IS NOT NULL").join(again, "hash").select(*KEYS, "start")


def covered(batch, units: Units, length: int, gram: int) -> np.ndarray:
    """Which units of a block lie in a repeated window, from the rows' marks and the runs found by comparison."""
    a, settled = marked_windows(batch, units, length, gram, SETTLED)
    change = np.zeros(len(units.values) + length + 1, dtype=np.int64)
    np.add.at(change, a["first"][settled], 1)
    np.add.at(change, a["last"][settled] + length, -1)
    runs = column(batch, "runs")
    flat = runs.flatten().to_numpy()
    at = np.repeat(units.starts, np.diff(runs.offsets.to_numpy())) + (flat >> RUN_BITS)
    np.add.at(change, at, 1)
    np.add.at(change, at + (flat & ((1 << RUN_BITS) - 1)) - 1 + length, -1)
    return np.cumsum(change)[: len(units.values)] > 0


def with_runs(marked: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds to documents the runs (k1, k2, start, n) of windows found by comparison, each as one long."""
    packed = F.shiftleft(F.col("start").cast("long"), RUN_BITS) + F.col("n")
    found = runs.groupBy(*KEYS).agg(F.collect_set(packed).alias("runs"))
    return marked.join(found, KEYS, "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<long>")))


def replace_texts(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``changed`` (k1, k2, text) in place of their own."""
    a, b, new = (unused(docs, n) for n in ("k1", "k2", "new_text"))
    own = docs.withColumns({a: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), b: F.xxhash64("text")})
    out = own.join(changed.toDF(a, b, new), [a, b], "left").withColumn("text", F.coalesce(new, "text"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
