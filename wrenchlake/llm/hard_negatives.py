"""Hard negatives by segment summary filtering.

For each segment of a vector its mean and deviation are stored.  Over a segment of n components the product of two vectors is
n times the product of their means, plus or minus at most n times the product of their deviations (Cauchy-Schwarz), so the sums
over all segments bound a score from both sides.  Bounds are made with few long segments first and refined with shorter ones
for the pairs that are still open; only what is open then is scored exactly.

Two passes of anchors over all rows (see ``vectors``): the first finds each anchor's positives among the rows of its label, the
second the negatives below each positive.  In both, an anchor's k-th best lower bound within a group closes every pair whose
upper bound is less.  A group returns at most k rows for each anchor, or for each anchor and positive.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component take no part; a vector of fewer
components than another counts as filled up with zeros; a row is not its own positive, but another row of the same vec_id or
content can be; each anchor row counts on its own; ties go to the smaller vec_id; components and scores are held at the bounds of
64 bits; an anchor without another row of its label, or a positive with a negative score, has no rows; an empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .vectors import Rows, Search, are_small, best, held, integers, products, whole

SCALE = 256
#: Components of a segment, level by level; the widths of groups are multiples of the first.
SEGMENTS = (16, 4)
POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80
#: Rounding of the stored summaries, relative to the product of two vectors' lengths.
ROUNDING = 1e-9


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds means and deviations: a value for each segment, all levels one after another, times the root of the segment's length."""
    for batch in batches:
        lists = batch.column(3)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        width = -(-max(int(sizes.max(initial=1)), 1) // SEGMENTS[0]) * SEGMENTS[0]
        x = np.zeros((len(sizes), width))
        starts = np.cumsum(sizes) - sizes
        x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(starts, sizes)] = values
        for name, of in (("means", np.mean), ("devs", np.std)):
            cols = np.concatenate([of(x.reshape(len(x), -1, n), axis=2) * np.sqrt(n) for n in SEGMENTS], axis=1)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * cols.shape[1]
            batch = batch.append_column(name, pa.ListArray.from_arrays(pa.array(offsets), pa.array(cols.ravel())))
        yield batch


def prepared(rows: Rows) -> Rows:
    """Takes a row's summaries apart by level, once for each group and block."""
    if not hasattr(rows, "summary"):
        parts = []
        for field in ("means", "devs"):
            lists = rows.items.field(field)
            each = [np.zeros((len(rows.row), rows.width // n)) for n in SEGMENTS]
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):  # vectors of one batch have one number of summaries
                at = np.flatnonzero(sizes == size)
                values = pa.concat_arrays([lists.take(pa.array(at)).flatten()]).to_numpy().reshape(len(at), size)
                width, lo = size * SEGMENTS[0] * SEGMENTS[1] // sum(SEGMENTS), 0
                for level, n in enumerate(SEGMENTS):
                    each[level][at, : width // n] = values[:, lo : lo + width // n]
                    lo += width // n
            parts.append(each)
        rows.summary = list(zip(*parts, strict=True))
        rows.size = np.sqrt((rows.x.astype(float) ** 2).sum(axis=1))
    return rows


def bounds(queries: Rows, qs: np.ndarray, group: Rows, cs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries[qs] and group[cs]."""
    (qm, qd), (gm, gd) = queries.summary[level], group.summary[level]
    middle, spread = qm[qs] @ gm[cs].T, qd[qs] @ gd[cs].T + ROUNDING * np.outer(queries.size[qs], group.size[cs]) + ROUNDING
    return middle - spread, middle + spread


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def refined(queries: Rows, qs: np.ndarray, group: Rows, cs: np.ndarray, open_: np.ndarray, closes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closes pairs level by level, ``closes(lower, upper, open, queries)`` says which, and drops columns that no query needs.
    Returns columns, open pairs and the exact scores of all pairs of those columns."""
    for level in range(len(SEGMENTS)):
        if not len(cs):
            break
        lower, upper = bounds(queries, qs, group, cs, level)
        open_ = open_ & ~closes(lower, upper, open_, qs)
        used = open_.any(axis=0)
        cs, open_ = cs[used], open_[:, used]
    small = are_small(queries.x[qs], group.x[cs])
    return cs, open_, held(products(queries.x[qs], group.x[cs], small))


def positives_of(k: int):
    """The k best rows of each anchor's label in a group."""

    def kernel(group: Rows, queries: Rows) -> dict:
        prepared(group), prepared(queries)
        rows: list[tuple] = []
        by_label, order = np.unique(queries.label, return_inverse=True), np.argsort(group.label, kind="stable")
        labels = group.label[order]

        def closes(lower, upper, open_, qs):
            return upper < kth(np.where(open_, lower, -np.inf), k)[:, None]

        for i, label in enumerate(by_label[0]):
            qs = np.flatnonzero(by_label[1] == i)
            cs = order[np.searchsorted(labels, label) : np.searchsorted(labels, label, side="right")]
            other = queries.row[qs][:, None] != group.row[cs][None, :]
            cs, open_, scores = refined(queries, qs, group, cs, other, closes)
            q, c = best(scores, open_, k)
            rows.append((queries.row[qs[q]], group.vec_id[cs[c]], scores[q, c]))
        row, vec_id, score = ([x[i] for x in rows] for i in range(3))
        return {"row": pa.array(np.concatenate(row), pa.int64()), "positive_id": pa.array(np.concatenate(vec_id), pa.int64()), "positive_score": whole(np.concatenate(score))}

    return kernel


def negatives_of(k: int, least: int):
    """For each positive of each anchor the k best rows of other labels in a group, among those in the positive's range."""

    def kernel(group: Rows, queries: Rows) -> dict:
        prepared(group), prepared(queries)
        n = int(queries.items.field("scores").value_lengths().to_numpy().max())
        given = queries.items.field("scores").value_lengths().to_numpy()
        top = queries.matrix("scores", n)
        last = top[np.arange(len(given)), given - 1].astype(float)  # scores descend
        floor, ceiling = least / 100 * last - ROUNDING * np.abs(last) - ROUNDING, top[:, 0].astype(float) * (1 + ROUNDING)
        qs, cs = np.arange(len(queries.row)), np.arange(len(group.row))
        open_ = (queries.label[:, None] != group.label[None, :]) & (top[:, 0] >= 0)[:, None]
        floor = np.where(last < 0, 0, floor)  # a range below zero is empty, but others of the anchor may not be

        def closes(lower, upper, open_, qs):
            surely = open_ & (lower >= floor[:, None] + 2 * ROUNDING * (1 + np.abs(floor[:, None]))) & (upper <= last[:, None])
            cut = np.maximum(floor, kth(np.where(surely, lower, -np.inf), k))
            return (upper < cut[:, None]) | (lower > ceiling[:, None])

        cs, open_, scores = refined(queries, qs, group, cs, open_, closes)
        out: list[tuple] = []
        for i in range(n):
            p = top[:, i][:, None]
            p = p.astype(object) if scores.dtype == object or np.abs(top).max(initial=0) > 2**46 else p.astype(float)
            inside = open_ & (given > i)[:, None] & (100 * scores <= 100 * p) & (100 * scores >= least * p)
            q, c = best(scores, inside.astype(bool), k)
            out.append((queries.row[q], np.full(len(q), i + 1), group.vec_id[cs[c]], scores[q, c]))
        row, at, vec_id, score = (np.concatenate([x[i] for x in out]) for i in range(4))
        return {"row": pa.array(row, pa.int64()), "n": pa.array(at, pa.int32()), "negative_id": pa.array(vec_id, pa.int64()), "negative_score": whole(score)}

    return kernel


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``rows``: those of ``integers``."""
    summed = rows.select("row", "vec_id", "label", "v").mapInArrow(summaries, "row long, vec_id long, label long, v array<long>, means array<double>, devs array<double>")
    search = Search(stored(summed, "vectors"))
    found = search.against(search.queries(), positives_of(positives), "row long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    found = stored(found.withColumn("n", nth).where(F.col("n") <= positives), "positives")
    scores = found.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    below = search.against(search.queries().join(scores, "row"), negatives_of(negatives, least_percent), "row long, n int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "n").orderBy(F.desc("negative_score"), "negative_id"))
    below = below.withColumn("rank", rank).where(F.col("rank") <= negatives)
    anchors = search.queries().select("row", F.col("vec_id").alias("anchor_id"))
    return below.join(found, ["row", "n"]).join(anchors, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Labels of every seventh vec_id are those of the next class."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), SCALE, label))
