"""Vectors as integers, and queries streamed against them in blocks.

Searches compare a stated set of queries with all rows.  Rows are dealt into groups of bounded size by a hash of their row
number; queries are packed into blocks, and every block visits every group.  A task holds one group at a time and lets the
query blocks pass one by one: rows move once, and neither side is ever held whole or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Bytes of the integers (as doubles) that a group holds, and how many rows at most; queries in a block on average.
GROUP_BYTES, GROUP_ROWS, QUERY_BLOCK = 8 << 20, 1 << 14, 128
#: Sums of doubles below this are exact.
EXACT = float(1 << 53)
QUERY_EVERY = 100


def integers(rows: DataFrame, scale: int, label: Column | None = None) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part; v: floor(scale * component), held at the bounds of 64 bits.

    ``row`` numbers the rows, so that equal vec_ids, and repeated rows, stay rows of their own; it is stored with them."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    out = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.lit(0).cast("long") if label is None else label.cast("long")
    out = out.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    return out.where("label IS NOT NULL")


def is_query() -> Column:
    return F.col("vec_id") % QUERY_EVERY == 0


class Rows:
    """Rows (or queries) as arrays: row, vec_id, label, x (a row each, filled up with zeros), and other fields on demand."""

    def __init__(self, items: pa.StructArray, width: int):
        self.items, self.width = items, width
        self.row, self.vec_id, self.label = (items.field(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
        self.x = self.matrix("v", width)

    def matrix(self, field: str, width: int) -> np.ndarray:
        lists = self.items.field(field)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(sizes), width), dtype=flat.dtype)
        ends = np.cumsum(sizes)
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
        return out


def are_small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products of two integer matrices, and the sums made of them, are exact as doubles."""
    if not (a.size and b.size):
        return True
    return float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] < EXACT / 128


def products(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of all rows of two integer matrices: doubles, or Python's integers if they are not ``small``."""
    kind = float if small else object
    return a.astype(kind) @ b.astype(kind).T


def held(scores: np.ndarray) -> np.ndarray:
    """Scores at the bounds of 64 bits."""
    return np.clip(scores, -(2**63), 2**63 - 1) if scores.dtype == object else scores


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of the k highest allowed scores of each query; ties to the earlier column."""
    k = min(k, scores.shape[1])
    if not k or not len(scores):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if scores.dtype == object or float(np.abs(scores).max()) * scores.shape[1] >= EXACT:
        found = [(q, c) for q in range(len(scores)) for c in sorted(np.flatnonzero(allowed[q]), key=lambda c, q=q: (-scores[q, c], c))[:k]]
        return tuple(np.array(found, dtype=np.int64).reshape(-1, 2).T)
    order = np.where(allowed, scores * scores.shape[1] - np.arange(scores.shape[1]), -np.inf)
    top = np.argpartition(-order, k - 1, axis=1)[:, :k]
    q, at = np.nonzero(np.isfinite(np.take_along_axis(order, top, axis=1)))
    return q, top[q, at]


def whole(scores: np.ndarray) -> pa.Array:
    return pa.array(scores.astype(np.int64), pa.int64())


class Search:
    """Rows of ``integers`` (stored), dealt into groups, and their queries."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.n, self.n_queries, widest = rows.agg(F.count("*"), F.count_if(is_query()), F.max(F.size("v"))).first()
        self.width = -(-max(widest or 1, 1) // 16) * 16
        cores = rows.sparkSession.sparkContext.defaultParallelism
        most = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * self.width)))
        self.groups = max(-(-self.n // most), min(2 * cores, -(-self.n // 1024)), 1)

    def queries(self) -> DataFrame:
        return self.rows.where(is_query())

    def against(self, queries: DataFrame, kernel: Callable[[Rows, Rows], dict], schema: str) -> DataFrame:
        """What ``kernel(group, block of queries)`` returns for each pair of them.  Rows of a group are ordered by vec_id.

        ``queries`` has the columns of the rows, and more if the kernel needs them."""
        width, n_blocks = self.width, max(1, -(-self.n_queries // QUERY_BLOCK))
        fields = queries.columns
        own = [F.col(c) if c in self.rows.columns else F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in fields]
        one = self.rows.select(F.pmod(F.xxhash64("row"), F.lit(self.groups)).cast("int").alias("part"), F.lit(-1).alias("block"), F.col("vec_id").alias("at"), F.array(F.struct(*own)).alias("items"))
        packed = queries.groupBy(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct(*fields)).alias("items"))
        visits = packed.select(F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("part"), "block", F.lit(0).cast("long").alias("at"), "items")
        dealt = one.unionByName(visits).repartition(self.groups, "part").sortWithinPartitions("part", "block", "at").select("part", "block", "items")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, group = None, [], None
            for batch in batches:
                parts, blocks = (batch.column(i).to_numpy() for i in (0, 1))
                lists = batch.column(2)
                cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(blocks) != 0)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                    if hi <= lo:
                        continue
                    if parts[lo] != part:
                        part, held, group = parts[lo], [], None
                    if blocks[lo] < 0:
                        held.append(lists.slice(lo, hi - lo).flatten())
                    elif held:
                        if group is None:
                            group = Rows(pa.concat_arrays(held), width)
                        out = kernel(group, Rows(lists.slice(lo, hi - lo).flatten(), width))
                        yield pa.RecordBatch.from_pydict(out)

        return dealt.mapInArrow(run, schema)


def open_search(rows: DataFrame, scale: int, label: Column | None = None) -> Search:
    return Search(stored(integers(rows, scale, label), "vectors"))
