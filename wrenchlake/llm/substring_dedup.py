"""Substring dedup: every word that lies in a passage of ``length`` words which also starts anywhere else is removed.

Method: Rabin-Karp hashes of the fixed-length word windows, counted in Spark; windows counted twice or more merge into
maximal removal intervals.  Windows that cannot repeat, or surely do, are settled before the count (see ``repeats``).

Defined results: null text counts as empty; documents shorter than ``length`` words never change; equal rows (also with
equal or null doc_id) are repeats of each other and lose all their windows; overlapping windows of one document count;
empty tables give empty tables; further columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import KEYS, Units, compared_windows, covered, keyed, marked_documents, repeated_by_count, replace_texts, with_runs
from .text import column, scan

GRAM = 10


def kept_words(docs: DataFrame, length: int = 35) -> DataFrame:
    """(k1, k2, n_removed, kept) of the documents that may lose words; kept: the remaining words joined by one space."""
    gram = min(GRAM, length)
    marked = marked_documents(keyed(docs), "word", length, gram)
    runs = repeated_by_count(compared_windows(marked, "word", length, gram)).withColumn("n", F.lit(1))

    def kernel(batch, texts):
        units = Units(texts, "word")
        gone = covered(batch, units, length, gram)
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[units.ends] - total[units.starts]
        kept = []
        for text, lo, hi, n in zip(texts, units.starts, units.ends, removed, strict=True):
            words = text.split()
            kept.append(b" ".join(w for w, g in zip(words, gone[lo:hi], strict=True) if not g) if n else b" ".join(words))
        return {"k1": column(batch, "k1"), "k2": column(batch, "k2"), "n_removed": removed.astype(np.int64), "kept": kept}

    return scan(with_runs(marked, runs), "k1 long, k2 long, n_removed long, kept binary", kernel)


def substring_dedup(docs: DataFrame, length: int = 35) -> DataFrame:
    """The same rows and columns; texts that hold a repeated passage become their remaining words, joined by one space."""
    kept = kept_words(docs, length).where("n_removed > 0").dropDuplicates(KEYS)
    return replace_texts(docs, kept.select(*KEYS, F.col("kept").cast("string")))


def word_digests(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_words and the digest of the words joined by one space."""

    def kernel(batch, texts):
        words = [t.split() for t in texts]
        return {
            "doc_id": column(batch, "doc_id"),
            "k1": column(batch, "k1"),
            "k2": column(batch, "k2"),
            "n_words": np.fromiter(map(len, words), dtype=np.int64, count=len(words)),
            "all_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), F.col("text").cast("string").alias("text"))
    return scan(rows, "doc_id long, k1 long, k2 long, n_words long, all_sha256 string", kernel)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = kept_words(docs).where("n_removed > 0").dropDuplicates(KEYS).select(*KEYS, "n_removed", F.sha2("kept", 256).alias("sha"))
    return word_digests(docs).join(kept, KEYS, "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("sha", "all_sha256").alias("kept_sha256"))
