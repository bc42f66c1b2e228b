"""Suffix-array dedup over bytes: every byte covered by a ``length``-byte string that also starts anywhere else goes.

Method: suffixes are range-partitioned by their leading bytes with sampled splitters and read in that order in buckets of
``BUCKET`` suffixes, so a bucket's memory does not depend on the data's size.  Each bucket sorts its suffixes locally by
multikey quicksort (eight bytes a step) and reads repeats off neighbouring common prefixes; strings of the class at either end
of a bucket are compared across the boundary.

Only suffixes at anchors are sorted (see ``repeats``): each window belongs to one anchor, ``d`` bytes after its start, so it
repeats if another suffix shares ``length - d`` bytes and the ``d`` bytes before are equal too.  For each ``d`` the sorted
order splits into runs with such a common prefix, and equal left parts within a run are repeats.

Hot classes (suffixes with the same first ``GRAM`` bytes, say one passage in a third of all documents) are spread over many
buckets by a salt in the range key; their windows are then compared by hash across buckets, so no task holds a class.

Defined results: null text counts as empty; texts shorter than ``length`` never change; equal rows lose all bytes if they
are long enough; matches never cross documents; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import COMPARE, KEYS, Units, covered, keyed, marked_documents, marked_windows, repeated_by_count, replace_texts, with_runs
from .store import stored
from .text import BASE, byte_tables, column, mix, powers, ranges, scan

GRAM = 80
LEAD = 32
BUCKET = 16_384
EDGE_ROWS = 1_024
SUFFIX = "cls long, salt long, left binary, right binary, k1 long, k2 long, pos int, dmin int, dmax int"
FOUND = "core long, hashes array<long>, starts array<int>, k1 long, k2 long, start int, n int"
#: So many neighbouring windows of a suffix go together between buckets, under the hash of what they share, their core.
SEGMENT = 16


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[start:end] as an Arrow array."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts, ends)])])


def suffixes(marked: DataFrame, length: int) -> DataFrame:
    """One row for each suffix to sort: up to ``length`` bytes from the anchor on, the bytes before it that its windows
    need, and the least and greatest distance from a window's start to the anchor."""

    def kernel(batch, texts):
        units = Units(texts, "byte")
        a, wanted = marked_windows(batch, units, length, GRAM, COMPARE)
        at, first, last, doc, cls = (a[k][wanted] for k in ("at", "first", "last", "doc", "cls"))
        k1, k2 = column(batch, "k1").to_numpy()[doc], column(batch, "k2").to_numpy()[doc]
        pos = at - units.starts[doc]
        return {
            "cls": cls.view(np.int64),
            "salt": mix(k1.view(np.uint64) ^ mix(k2.view(np.uint64) + pos.astype(np.uint64))).view(np.int64),
            "left": pieces(units.block.bytes, first, at),
            "right": pieces(units.block.bytes, at, np.minimum(at + length, units.ends[doc])),
            "k1": k1,
            "k2": k2,
            "pos": pos.astype(np.int32),
            "dmin": (at - last).astype(np.int32),
            "dmax": (at - first).astype(np.int32),
        }

    return scan(marked, SUFFIX, kernel)


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """Order of fixed-width byte rows: multikey quicksort with eight bytes a key; only rows still tied are sorted on."""
    n, width = rows.shape
    keys = rows.view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable") if n else np.empty(0, np.int64)
    rank = np.zeros(n, dtype=np.int64)  # group of each place in the order
    for k in range(width // 8):
        if k:
            size = np.bincount(rank, minlength=1)
            tied = np.flatnonzero(size[rank] > 1)
            if not len(tied):
                break
            sub = order[tied]
            by = np.lexsort((keys[sub, k], rank[tied]))
            order[tied] = sub[by]
        value = keys[order, k]
        new = np.concatenate(([True], (rank[1:] != rank[:-1]) | (value[1:] != value[:-1]))) if n else np.empty(0, bool)
        rank = np.cumsum(new) - 1
    return order


def padded(parts: pa.Array, width: int, ahead: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of one width, with zeros behind (or ahead of) them, and their sizes."""
    _, offsets, data = parts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[parts.offset : parts.offset + len(parts) + 1]
    sizes = np.diff(offsets)
    out = np.zeros((len(parts), width), dtype=np.uint8)
    place = np.arange(width)
    if sizes.any():
        used = place >= width - sizes[:, None] if ahead else place < sizes[:, None]
        out[used] = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return out, sizes


def window_hashes(text: np.ndarray, length: int, n: int) -> np.ndarray:
    """[row, i]: hash of text[row, i : i + length] for i < n."""
    p, inverse = powers(text.shape[1] + 1)
    total = np.zeros((len(text), text.shape[1] + 1), dtype=np.uint64)
    np.cumsum(byte_tables()["value"][text] * p[:-1], axis=1, out=total[:, 1:])
    return mix((total[:, length : length + n] - total[:, :n]) * inverse[:n] + np.uint64(length))


def resolve_bucket(table: pa.Table, length: int) -> tuple[dict, list[pa.Table]]:
    """Of one bucket's suffixes, in the order of the range key: runs of windows that repeat within it, and the windows that a
    neighbouring bucket may share, in segments.  A run is its first start and its number of windows."""
    cls, k1, k2, pos, dmin, dmax = (table.column(c).to_numpy() for c in ("cls", "k1", "k2", "pos", "dmin", "dmax"))
    ends = [cls[0], cls[-1]]
    reach = length - GRAM
    rows, sizes = padded(table.column("right").combine_chunks(), -(-length // 8) * 8)
    left = padded(table.column("left").combine_chunks(), reach, ahead=True)[0]
    order = multikey_sort(rows)
    rows, sizes, left, cls, k1, k2, pos, dmin, dmax = (x[order] for x in (rows, sizes, left, cls, k1, k2, pos, dmin, dmax))
    n, most = len(rows), int(dmax.max()) + 1
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    del differ
    edge = np.flatnonzero(np.isin(cls, ends))
    known = np.zeros((len(edge), most), dtype=bool)
    before, factor = np.zeros(n, dtype=np.uint64), np.uint64(1)  # hash of the d bytes before each anchor
    since = np.full(n, -1)  # least d of the run that each suffix is in
    found = []

    def close(which: np.ndarray, d: int) -> None:
        found.append((which, pos[which] - d + 1, d - since[which]))

    for d in range(most):
        if d:
            before += byte_tables()["value"][left[:, reach - d]] * factor
            factor = np.uint64(int(factor) * BASE & 0xFFFFFFFFFFFFFFFF)
        has = np.flatnonzero((dmin <= d) & (d <= dmax))
        run = np.concatenate(([0], np.cumsum(common < length - d))).astype(np.uint64)
        key = mix(before[has] + mix(run[has] + np.uint64(1)))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(n, dtype=bool)
        twice[has[by[1:][same]]] = True
        twice[has[by[:-1][same]]] = True
        close(np.flatnonzero((since >= 0) & ~twice), d)
        since = np.where(twice, np.where(since >= 0, since, d), -1)
        known[:, d] = twice[edge]
    close(np.flatnonzero(since >= 0), most)
    which, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
    inner = {"k1": k1[which], "k2": k2[which], "start": start.astype(np.int32), "n": count.astype(np.int32)}
    # The classes with the least and greatest range key may go on in the next bucket.  Windows that repeat here only need to be
    # known there, once; the others also wait for an answer.
    known_pairs, open_ = [np.empty((2, 0), np.uint64)], []
    for i in range(0, len(edge), EDGE_ROWS):
        some = edge[i : i + EDGE_ROWS]
        text = np.concatenate((left[some], rows[some]), axis=1)
        hashes = window_hashes(text, length, reach + 1)[:, ::-1]
        cores = window_hashes(text, length - SEGMENT + 1, reach + 1)[:, ::-1][:, ::SEGMENT]
        d = np.arange(most)
        own = (dmin[some, None] <= d) & (d <= dmax[some, None])
        at, far = np.nonzero(own & known[i : i + EDGE_ROWS])
        known_pairs.append(np.stack((cores[at, far // SEGMENT], hashes[at, far])))
        at, far = np.nonzero(own & ~known[i : i + EDGE_ROWS])
        open_.append((cores[at, far // SEGMENT], hashes[at, far], some[at], far))
    core, hashes = np.unique(np.concatenate(known_pairs, axis=1), axis=1)
    said = grouped(core, core, hashes)
    if open_:
        core, hashes, at, far = (np.concatenate(x) for x in zip(*open_, strict=True))
        asked = grouped(at * most + far // SEGMENT, core, hashes, k1[at], k2[at], pos[at] - far)
    else:
        asked = said[:0]
    return inner, [said, asked]


def grouped(by: np.ndarray, core: np.ndarray, hashes: np.ndarray, *facts: np.ndarray) -> pa.Table:
    """Rows (core, hashes, starts, k1, k2) of neighbours with one value of ``by``; without facts k1, k2 and starts are null."""
    first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))[: len(by)])
    offsets = pa.array(np.append(first, len(by)).astype(np.int32))
    none = pa.nulls(len(first), pa.int64())
    k1, k2, starts = facts if facts else (None, None, None)
    return pa.table(
        {
            "core": pa.array(core[first].view(np.int64)),
            "hashes": pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64))),
            "starts": pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32))) if facts else pa.nulls(len(first), pa.list_(pa.int32())),
            "k1": pa.array(k1[first]) if facts else none,
            "k2": pa.array(k2[first]) if facts else none,
        }
    )


def suffix_repeats(marked: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, n) of runs of compared windows that repeat, found in range-partitioned, locally sorted suffix buckets."""

    def resolved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = resolve_bucket(pa.Table.from_batches(held), length)
        n = len(inner["k1"])
        yield pa.RecordBatch.from_pydict({"core": pa.nulls(n, pa.int64()), "hashes": pa.nulls(n, pa.list_(pa.int64())), "starts": pa.nulls(n, pa.list_(pa.int32())), **inner})
        for table in outer:
            for batch in table.append_column("start", pa.nulls(len(table), pa.int32())).append_column("n", pa.nulls(len(table), pa.int32())).to_batches():
                yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, BUCKET):
                part = batch.slice(i, BUCKET)
                if held and size + part.num_rows > BUCKET:
                    yield from resolved(held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield from resolved(held)

    range_key = ["lead", "cls", "salt"]
    buckets = suffixes(marked, length).withColumn("lead", F.substring("right", 1, LEAD)).repartitionByRange(*range_key).sortWithinPartitions(*range_key)
    both = stored(buckets.drop("lead", "salt").mapInArrow(run, FOUND), "suffixes")
    # Between buckets only segments whose core occurs twice are opened, and their windows compared.
    outer = both.where("core IS NOT NULL")
    again = stored(outer.groupBy("core").count().where("count > 1").select("core"), "cores")
    windows = outer.join(again, "core").select("k1", "k2", "starts", F.posexplode("hashes").alias("i", "hash")).select("hash", *KEYS, F.get("starts", F.col("i")).alias("start"))
    inner = both.where("core IS NULL").select(*KEYS, "start", "n")
    return inner.union(repeated_by_count(windows).withColumn("n", F.lit(1)))


def kept_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept) of the documents that may lose bytes; kept: the remaining bytes."""
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM} bytes")
    marked = marked_documents(keyed(docs), "byte", length, GRAM)
    runs = suffix_repeats(marked, length)

    def kernel(batch, texts):
        units = Units(texts, "byte")
        gone = covered(batch, units, length, GRAM)
        kept, removed, spans = [], [], []
        for text, lo, hi in zip(texts, units.starts, units.ends, strict=True):
            own = gone[lo:hi]
            removed.append(int(own.sum()))
            spans.append(int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1)))
            kept.append(np.frombuffer(text, dtype=np.uint8)[~own].tobytes() if removed[-1] else text)
        return {"k1": column(batch, "k1"), "k2": column(batch, "k2"), "n_removed": removed, "n_spans": spans, "kept": kept}

    return scan(with_runs(marked, runs), "k1 long, k2 long, n_removed long, n_spans long, kept binary", kernel)


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """The same rows and columns; texts with repeated strings become their remaining bytes, cut characters dropped."""
    kept = kept_bytes(docs, length).where("n_removed > 0").dropDuplicates(KEYS)

    def kernel(batch, texts):
        return {"k1": column(batch, "k1"), "k2": column(batch, "k2"), "text": [t.decode("utf-8", "ignore") for t in texts]}

    return replace_texts(docs, scan(kept, "k1 long, k2 long, text string", kernel, text="kept"))


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = kept_bytes(docs).where("n_removed > 0").dropDuplicates(KEYS).select(*KEYS, "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("all_sha256"))
    zero = F.lit(0).cast("long")
    return own.join(kept, KEYS, "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "all_sha256").alias("kept_sha256"))
