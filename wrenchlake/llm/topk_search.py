"""Exact top-k search by a three-phase uniform threshold.

The components are split into ``LISTS`` ranges; a range gives every row a local score for a query, and a row's score is the sum
of its local scores.

1. Each group of rows gathers, for each query, the rows with the k highest local scores in each list, and scores them.  The
   k-th best of these scores over all groups is a score that k rows have: a safe cutoff.
2. The cutoff goes out with the queries.  A row can only reach it if one of its local scores reaches the cutoff divided by the
   number of lists, so each group collects those entries and no others.
3. Where lists are missing, an entry's score is at most what it has plus the uniform threshold for each missing list; entries
   that still reach the cutoff are resolved exactly, and the k best of each group are ranked over all groups.

Groups return at most k rows a query in each phase, whatever their size.

Defined results: rows with a null vec_id or vector, or a null or non-finite component take no part; a vector of fewer components
than another counts as filled up with zeros, so an empty one scores 0; a row is not its own result, but another row of the same
vec_id or content is; each query row has a ranking of its own; components and scores are held at the bounds of 64 bits; fewer
than k rows give all of them; an empty table, or one without queries, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import Rows, Search, are_small, best, held, open_search, products, whole

LISTS = 2
SCALE = 1024


def local_scores(group: Rows, queries: Rows) -> list[np.ndarray]:
    """The scores of all pairs in each list."""
    step, small = group.width // LISTS, are_small(queries.x, group.x)
    return [products(queries.x[:, i * step : (i + 1) * step], group.x[:, i * step : (i + 1) * step], small) for i in range(LISTS)]


def others(group: Rows, queries: Rows) -> np.ndarray:
    return queries.row[:, None] != group.row[None, :]


def gathered(k: int):
    """Phase 1: the scores of each query's best rows by local score, k at most."""

    def kernel(group: Rows, queries: Rows) -> dict:
        lists, other = local_scores(group, queries), others(group, queries)
        chosen = np.zeros_like(other)
        for scores in lists:
            chosen[best(scores, other, k)] = True
        scores = held(sum(lists[1:], lists[0]))
        q, c = best(scores, chosen, k)
        return {"row": pa.array(queries.row[q], pa.int64()), "score": whole(scores[q, c])}

    return kernel


def resolved(k: int):
    """Phases 2 and 3: of the rows that one list lets reach the cutoff, the k best."""

    def kernel(group: Rows, queries: Rows) -> dict:
        lists, other = local_scores(group, queries), others(group, queries)
        cutoff = queries.items.field("cutoff").fill_null(-(2**63)).to_numpy(zero_copy_only=False)[:, None]
        known = cutoff[:, 0] > -(2**63)
        threshold = cutoff // LISTS + (cutoff % LISTS > 0)
        reached = [x >= threshold for x in lists]
        entry = np.where(known[:, None], np.logical_or.reduce(reached), True) & other
        q, c = np.nonzero(entry)
        at_most = sum(np.where(r[q, c], x[q, c], threshold[q, 0] - 1) for r, x in zip(reached, lists, strict=True))
        open_ = ~known[q] | (at_most >= cutoff[q, 0])
        q, c = q[open_], c[open_]
        scores = held(sum(x[q, c] for x in lists))  # the missing lists' scores come in here
        enough = ~known[q] | (scores >= cutoff[q, 0])
        q, c, scores = q[enough], c[enough], scores[enough]
        order = np.lexsort((c, -scores, q)) if scores.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], c[i])), dtype=np.int64)
        q, c, scores = q[order], c[order], scores[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, c = q[kept], c[kept]
        return {"row": pa.array(queries.row[q], pa.int64()), "query_id": pa.array(queries.vec_id[q], pa.int64()), "vec_id": pa.array(group.vec_id[c], pa.int64()), "score": whole(scores[kept])}

    return kernel


def topk(search: Search, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query."""
    queries = search.queries()
    first = search.against(queries, gathered(k), "row long, score long")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))
    cutoffs = first.withColumn("n", nth).where(F.col("n") <= k).groupBy("row").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    found = search.against(queries.join(cutoffs, "row", "left"), resolved(k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk_search(spark, sf_dir: str) -> DataFrame:
    return topk(open_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), SCALE))
