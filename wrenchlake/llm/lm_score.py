"""LM scoring by masked pseudo-likelihood.

A document's score is the sum of its words' conditional log-probabilities, log P(token | left, right) + log P(word | token,
left, right).

The first part is a bidirectional window network that predicts every token from the token on either side of it.  Tokens are
the ``COMMON`` most frequent words of the corpus (A-Z lower-cased), counted over all documents, and ``SHAPES`` classes for the
rest, by length and by kind (lower case, capitals, beyond ASCII, digits or symbols).  The network is trained in numpy on the
counts of all (left, token, right) triples, which Spark gathers; with V tokens there are at most V**3 of them.

The second part is 0 for the ``COMMON`` words and covers every other word of the corpus: its count in its class, and its
counts beside the hashed words to its left and right, mixed by ``NEAR``.  The word in question is left out of all counts.
Buckets of neighbours grow with the root of the number of distinct words.  These counts stay in Spark: all places of a word
come together by its hash, packed (a few bytes a word), and only sums of documents leave again.

Defined results: null, empty and blank texts have no token, a sum of 0 and a null mean; an empty corpus gives uniform
probabilities; ties in the vocabulary go by the word's hash; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .text import Block, blocks, column, mix, scan

COMMON = 96
SHAPES = 16
EDGE = COMMON + SHAPES
V = EDGE + 1
HIDDEN = 48
EPOCHS = 200
HELD_BLOCKS = 64
#: Weight of a word's counts beside its neighbours, the count that every word has beforehand, and the unit of summed logarithms.
NEAR = 0.5
PRIOR = 0.5
UNIT = 1 << 24


def lowered_hashes(texts: list[bytes]) -> tuple[Block, np.ndarray]:
    block = Block(texts)
    return block, Block(texts, lower=True).word_hashes()


def shapes(block: Block) -> np.ndarray:
    """Class of each word by kind and length."""
    starts, ends, _ = block.words()
    b = block.bytes
    upper, wide = (b >= 65) & (b <= 90), b >= 128
    other = ~wide & ~upper & ~((b >= 97) & (b <= 122)) & ~np.isin(b, list(b".,;:?!'\" \t\n\v\f\r"))
    some = lambda mask: (lambda total: total[ends] > total[starts])(np.concatenate(([0], np.cumsum(mask))))
    kind = np.where(some(other), 3, np.where(some(wide), 2, np.where(some(upper), 1, 0)))
    return 4 * kind + np.digitize(ends - starts, [4, 7, 11])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, shape, n): hash, class and count of every word of the corpus; each task adds up a few blocks before it hands rows on."""

    def distinct(words: np.ndarray, shape: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((shape, words))
        words, shape = words[order], shape[order]
        first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (shape[1:] != shape[:-1])))[: len(words)])
        return words[first], shape[first], np.add.reduceat(n[order], first) if len(first) else n

    def summed(parts: list) -> pa.RecordBatch:
        words, shape, n = distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_pydict({"word": words.view(np.int64), "shape": shape.astype(np.int32), "n": n})

    def run(batches):
        held = []
        for _, texts in blocks(batches):
            block, words = lowered_hashes(texts)
            held.append(distinct(words, shapes(block), np.ones(len(words), dtype=np.int64)))
            if len(held) == HELD_BLOCKS:
                yield summed(held)
                held = []
        if held:
            yield summed(held)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, sorted."""
    return most_frequent(word_counts(docs))


def most_frequent(counts: DataFrame) -> np.ndarray:
    rows = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    return np.sort(rows.column("word").to_numpy().view(np.uint64))


def tokens(texts: list[bytes], common: np.ndarray) -> tuple[Block, np.ndarray]:
    """A token of each word of a block."""
    return hashed_tokens(texts, common)[:2]


def hashed_tokens(texts: list[bytes], common: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray]:
    """A token of each word of a block, and its hash."""
    block, hashes = lowered_hashes(texts)
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    known = common[at] == hashes if len(common) else np.zeros(len(hashes), dtype=bool)
    return block, np.where(known, at, COMMON + shapes(block)), hashes


def neighbours(block: Block, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token before and after each token, EDGE at the ends of documents."""
    doc = block.words()[2]
    left, right = np.full(len(ids), EDGE), np.full(len(ids), EDGE)
    same = np.flatnonzero(doc[1:] == doc[:-1])
    left[same + 1], right[same] = ids[same], ids[same + 1]
    return left, right


def triple_counts(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(code, n): count of each (left * V + right) * V + token in the corpus; each task adds up what it sees first."""

    def run(batches):
        total = np.zeros(V**3, dtype=np.int64)
        for _, texts in blocks(batches):
            block, ids = tokens(texts, common)
            left, right = neighbours(block, ids)
            codes, n = np.unique((left * V + right) * V + ids, return_counts=True)
            total[codes] += n
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": codes, "n": total[codes]})

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train(codes: np.ndarray, n: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02) -> np.ndarray:
    """Log-probabilities [left * V + right, token] of the trained network, by full-batch Adam steps on the counts."""
    context, row = np.unique(codes // V, return_inverse=True)
    counts = np.zeros((len(context), V), dtype=np.float32)
    counts[row, codes % V] = n
    rng = np.random.default_rng(7)
    init = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    p = [init(V, HIDDEN), init(V, HIDDEN), init(HIDDEN, V), np.log(counts.sum(0) + 1).astype(np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    left, right = context // V, context % V
    weight = counts.sum(1, keepdims=True)
    total = max(float(weight.sum()), 1.0)

    def probabilities(l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(p[0][l] + p[1][r])
        z = h @ p[2] + p[3]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    for t in range(1, epochs + 1 if len(context) else 1):
        h, logp = probabilities(left, right)
        error = (np.exp(logp) * weight - counts) / total
        back = (error @ p[2].T) * (1 - h * h)
        grads = [np.zeros_like(p[0]), np.zeros_like(p[1]), h.T @ error, error.sum(0)]
        np.add.at(grads[0], left, back)
        np.add.at(grads[1], right, back)
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    every = np.arange(V * V)
    return probabilities(every // V, every % V)[1].astype(np.float32)


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The corpus' vocabulary and the network's log-probabilities."""
    common = vocabulary(docs)
    got = triple_counts(docs, common).orderBy("code").toArrow()
    return common, train(got.column("code").to_numpy(), got.column("n").to_numpy())


def lm_scores(docs: DataFrame, common: np.ndarray, logp: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum) and mean_log_prob of each document."""
    table = docs.sparkSession.sparkContext.broadcast(logp)

    def kernel(batch, texts):
        block, ids = tokens(texts, common)
        left, right = neighbours(block, ids)
        doc = block.words()[2]
        return {"doc_id": column(batch, "doc_id"), "n_tokens": block.count(doc).astype(np.int64), "log_likelihood": block.count(doc, table.value[left * V + right, ids].astype(np.float64)).astype(float)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scan(rows, "doc_id long, n_tokens long, log_likelihood double", kernel).withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def beside(block: Block, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the word before and after each word, 0 at the ends of documents."""
    doc = block.words()[2]
    bucket = 1 + (mix(hashes) % np.uint64(buckets - 1)).astype(np.int64)
    left, right = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
    same = np.flatnonzero(doc[1:] == doc[:-1])
    left[same + 1], right[same] = bucket[same], bucket[same + 1]
    return left, right


def beside_counts(docs: DataFrame, common: np.ndarray, buckets: int) -> np.ndarray:
    """[side, class, bucket]: how many words of each class stand beside each bucket, over the corpus."""

    def run(batches):
        total = np.zeros(2 * SHAPES * buckets, dtype=np.int64)
        for _, texts in blocks(batches):
            block, ids, hashes = hashed_tokens(texts, common)
            at = np.flatnonzero(ids >= COMMON)
            for side, near in enumerate(beside(block, hashes, buckets)):
                codes, n = np.unique((side * SHAPES + ids[at] - COMMON) * buckets + near[at], return_counts=True)
                total[codes] += n
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": codes, "n": total[codes]})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * SHAPES * buckets, dtype=np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(2, SHAPES, buckets)


def packed_places(rows: DataFrame, common: np.ndarray, buckets: int, parts: int) -> DataFrame:
    """(part, words, n, left, right, doc, keys): places of the words outside ``common``, a row for each part of the words and
    some blocks; each distinct word once with its count, then for each place its neighbours' buckets and its document."""
    small = np.min_scalar_type(buckets - 1)

    def packed(held: list):
        words, left, right = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
        keys = np.concatenate([k for *_, k in held])
        sizes = np.cumsum([0] + [len(k) for *_, k in held])
        doc = np.concatenate([d + first for (_, _, _, d, _), first in zip(held, sizes[:-1], strict=True)])
        part = ((words >> np.uint64(4)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((words, part))
        words, left, right, doc, part = words[order], left[order].astype(small), right[order].astype(small), doc[order], part[order]
        ends = np.searchsorted(part, np.arange(parts + 1))
        for i in range(parts):
            at = slice(ends[i], ends[i + 1])
            if ends[i] == ends[i + 1]:
                continue
            distinct, n = np.unique(words[at], return_counts=True)
            used, of = np.unique(doc[at], return_inverse=True)
            arrays = (distinct, n.astype(np.uint32), left[at], right[at], of.astype(np.uint32) if len(used) > 65536 else of.astype(np.uint16), keys[used])
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32())} | {c: pa.array([a.tobytes()], pa.binary()) for c, a in zip(PACKED, arrays, strict=True)})

    def run(batches):
        held = []
        for batch, texts in blocks(batches):
            block, ids, hashes = hashed_tokens(texts, common)
            left, right = beside(block, hashes, buckets)
            at = np.flatnonzero(ids >= COMMON)
            shape = (ids[at] - COMMON).astype(np.uint64)
            words = (mix(hashes[at] + shape) & ~np.uint64(SHAPES - 1)) | shape
            held.append((words, left[at], right[at], block.words()[2][at], column(batch, "k").to_numpy()))
            if len(held) == HELD_BLOCKS:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return rows.mapInArrow(run, "part int, " + ", ".join(f"{c} binary" for c in PACKED))


PACKED = ("words", "n", "left", "right", "doc", "keys")


def word_sums(docs: DataFrame, common: np.ndarray, distinct: np.ndarray) -> DataFrame:
    """(k, sum): log P(word | token, left, right) of rows' words outside ``common``, in 1 / ``UNIT``, added up for each k.

    A part of the words hands on its documents' sums packed by ranges of k, and a range adds them up.

    ``distinct``: the number of distinct words of each class.
    """
    spark = docs.sparkSession
    buckets = 1 << math.ceil(math.log2(16 * math.sqrt(max(int(distinct.sum()), 1))))
    near = spark.sparkContext.broadcast(beside_counts(docs, common, buckets))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = np.min_scalar_type(buckets - 1)

    firsts = np.array([-(1 << 63) + (i << 64) // parts for i in range(parts)], dtype=np.int64)

    def added(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, of = np.unique(keys, return_inverse=True)
        return keys, np.bincount(of, weights=sums).astype(np.int64)

    def score(table: pa.Table) -> pa.Table:
        got = {c: [] for c in ("word", "left", "right", "key")}
        for row in table.select(PACKED).to_pylist():
            n, left = np.frombuffer(row["n"], np.uint32), np.frombuffer(row["left"], small)
            doc = np.frombuffer(row["doc"], np.uint16 if len(row["doc"]) == 2 * len(left) else np.uint32)
            got["word"].append(np.repeat(np.frombuffer(row["words"], np.uint64), n))
            got["left"].append(left)
            got["right"].append(np.frombuffer(row["right"], small))
            got["key"].append(np.frombuffer(row["keys"], np.int64)[doc])
        words, at, n = np.unique(np.concatenate(got.pop("word")), return_inverse=True, return_counts=True)
        shape = (words & np.uint64(SHAPES - 1)).astype(np.int64)[at]
        total = near.value[0].sum(1)
        alone = (n[at] - 1 + PRIOR) / (total - 1 + PRIOR * distinct)[shape]
        p = (1 - NEAR) * alone
        for side, name in enumerate(("left", "right")):
            bucket = np.concatenate(got.pop(name)).astype(np.int64)
            _, of, both = np.unique(at * buckets + bucket, return_inverse=True, return_counts=True)
            others = near.value[side][shape, bucket] - 1
            p += NEAR / 2 * np.where(others > 0, (both[of] - 1) / np.maximum(others, 1), alone)
        keys, sums = added(np.concatenate(got["key"]), np.rint(np.log(p) * UNIT))
        ends = np.searchsorted(keys, firsts).tolist() + [len(keys)]
        used = [i for i in range(parts) if ends[i] < ends[i + 1]]
        cut = lambda a: pa.array([a[ends[i] : ends[i + 1]].tobytes() for i in used], pa.binary())
        return pa.table({"range": pa.array(used, pa.int32()), "keys": cut(keys), "sums": cut(sums)})

    def combine(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        keys, sums = added(read("keys", np.int64), read("sums", np.int64))
        return pa.table({"k": keys, "sum": sums})

    rows = docs.select(row_key().alias("k"), F.col("text").cast("string").alias("text"))
    return packed_places(rows, common, buckets, parts).groupBy("part").applyInArrow(score, "range int, keys binary, sums binary").groupBy("range").applyInArrow(combine, "k long, sum long")


def row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum) and mean_log_prob of each document, by the network and every word's own counts."""
    counts = stored(word_counts(docs), "words")
    common = most_frequent(counts)
    got = triple_counts(docs, common).orderBy("code").toArrow()
    logp = train(got.column("code").to_numpy(), got.column("n").to_numpy())
    distinct = np.zeros(SHAPES, dtype=np.int64)
    for shape, n in counts.where(~F.col("word").isin(common.view(np.int64).tolist())).groupBy("shape").count().collect():
        distinct[shape] = n
    table = docs.sparkSession.sparkContext.broadcast(logp)

    def kernel(batch, texts):
        block, ids = tokens(texts, common)
        left, right = neighbours(block, ids)
        doc = block.words()[2]
        sums = block.count(doc, np.rint(table.value[left * V + right, ids].astype(np.float64) * UNIT))
        return {"k": column(batch, "k"), "doc_id": column(batch, "doc_id"), "n_tokens": block.count(doc).astype(np.int64), "sum": sums.astype(np.int64), "rows": np.ones(block.n, dtype=np.int64)}

    rows = docs.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    network = scan(rows, "k long, doc_id long, n_tokens long, sum long, rows long", kernel)
    none = F.lit(None).cast("long")
    words = word_sums(docs, common, distinct).select("k", none.alias("doc_id"), none.alias("n_tokens"), "sum", F.lit(0).cast("long").alias("rows"))
    each = network.union(words).groupBy("k").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.sum("sum") / F.sum("rows") / UNIT).alias("log_likelihood"), F.sum("rows").alias("rows"))
    out = each.select("doc_id", "n_tokens", "log_likelihood", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row")).drop("row")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
