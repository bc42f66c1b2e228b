"""Conversation trie, hard negatives and top-k search against brute force, and their defined results for odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import check, connect
from wrenchlake.llm import hard_negatives, prefix_trie, topk_search, vectors
from wrenchlake.llm.queries import ORACLE, QUERIES

NEW = ("op11_conversation_trie", "op12_hard_negatives", "op13_topk_search")


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NEW)
def test_query_equals_duckdb(spark, con, small, name):
    assert check(spark, con, small, QUERIES[name], ORACLE[name])


# --- conversations


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute_trie(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(x)] for c, x in by.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * words
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


def conversations():
    r = random.Random(3)
    says = [None, "", " \t", "yes", "no \v more", "a  b\nc", "  x", "ünï \U0001f600", "w " * 4000]
    rows = []
    for c in [*range(60), *range(200, 223), -1, -20, -35, 2**62, 10**12 + 3]:
        for turn in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn if r.random() < 0.9 else r.choice([None, 0, 1]), r.choice(["user", "user", "assistant", None]), r.choice(says)))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(6)]  # a group of copies
    rows += [(c, t, "user", "long") for c in (400, 401, 421) for t in range(60)]  # deep ones
    rows += rows[:9] + [(None, 1, "user", "lost"), (500, None, None, None)]
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("bound", "per_shard"), [(prefix_trie.BOUND, prefix_trie.PER_SHARD), (0, 1), (3, 4), (60, 10), (150, 40)])
def test_trie_equals_brute_force(spark, bound, per_shard):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(3).withColumns({c: F.lit(1) for c in ("depth", "p1", "n", "words", "root", "length", "digest")})
    got = collections.Counter(tuple(r) for r in prefix_trie.trie(df, bound, per_shard).collect())
    assert got == brute_trie(rows)


def test_ends_of_one_node_in_several_pieces(spark):
    ids = sorted(random.Random(4).sample(range(-40_000, 400_000), 9_000))
    rows = [(c, 0, "user", "same") for c in ids]
    got = collections.Counter(tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, CONV).repartition(4)).collect())
    assert got == brute_trie(rows)


def test_empty_tables_of_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONV)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], CONV)).collect() == []


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    made = prefix_trie.PerfectHash(keys)
    assert sorted(made.slots(keys)) == list(range(5000))
    assert (made.slots(keys + np.uint64(1)) < 5000).all()
    assert len(prefix_trie.PerfectHash(keys[:0]).slots(keys)) == 5000


# --- vectors

EMB = "vec_id long, embedding array<float>, label int"


def floored(vector, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in vector]


def usable(rows, scale):
    out = []
    for v, e, label in rows:
        if v is not None and e is not None and all(x is not None and np.isfinite(np.float32(x)) for x in e):
            out.append((v, floored(e, scale), label))
    return out


def dot(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))


def brute_topk(rows, k=10):
    have, out = usable(rows, 1024), []
    for i, (v, e, _) in enumerate(have):
        if v % 100 == 0:
            best = sorted((-dot(e, f), w) for j, (w, f, _) in enumerate(have) if j != i)[:k]
            out += [(v, n + 1, w, -s) for n, (s, w) in enumerate(best)]
    return collections.Counter(out)


def brute_negatives(rows):
    have, out = [], []
    for v, e, label in usable(rows, 256):
        if label is not None:
            have.append((v, e, (label + 1) % 10 if v % 7 == 0 else label))
    for i, (v, e, label) in enumerate(have):
        if v % 100:
            continue
        scored = sorted((-dot(e, f), w, other) for j, (w, f, other) in enumerate(have) if j != i)
        for s, w, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(v, w, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return collections.Counter(out)


def embeddings(n=900, width=24, copies=200, seed=5):
    r = np.random.default_rng(seed)
    base = r.normal(size=width)
    rows = [(int(i), (base if i % 9 == 0 else r.normal(size=width) + base * (i % 4)).astype(np.float32).tolist(), int(i % 3 if i % 5 else 1)) for i in range(n)]
    rows += [(int(i), base.astype(np.float32).tolist(), int(i % 2)) for i in range(n, n + copies)]
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * width, 1), (1, None, 1), (2, [1.0] * (width - 1) + [None], 1), (3, [nan] * width, 1), (100, [inf] + [0.0] * (width - 1), 1), (4, [-inf] * width, 1), (500, [0.0] * width, None), (5, [2.0] * width, None)]
    odd += [(200, [], 1), (201, [], 2), (6, [3.0] * (width + 9), 2), (300, [3.0] * 5, 2), (400, rows[400][1], rows[400][2]), (400, rows[400][1], 2), (-100, [0.5] * width, -3), (-7, [0.25] * width, -1)]
    return rows + odd + rows[700:705]


def frame(spark, rows):
    return spark.createDataFrame(rows, EMB).repartition(5).withColumns({c: F.lit(7) for c in ("row", "v", "score", "rank", "items", "cutoff", "means", "part")})


def got_topk(spark, rows):
    return collections.Counter(tuple(r) for r in topk_search.topk(vectors.open_search(frame(spark, rows), topk_search.SCALE)).collect())


def got_negatives(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return collections.Counter(tuple(r) for r in hard_negatives.hard_negatives(vectors.integers(frame(spark, rows), hard_negatives.SCALE, label)).collect())


@pytest.mark.parametrize("block", [vectors.QUERY_BLOCK, 2])
def test_searches_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "GROUP_ROWS", 130 * block)
    rows = embeddings()
    assert got_topk(spark, rows) == brute_topk(rows)
    want = brute_negatives([(v, e, label) for v, e, label in rows if label is None or label >= 0])
    assert want and got_negatives(spark, [x for x in rows if x[2] is None or x[2] >= 0]) == want


def test_searches_of_huge_components(spark):
    r = np.random.default_rng(6)
    rows = [(int(i), (r.normal(size=6) * 10.0 ** int(r.integers(0, 9))).astype(np.float32).tolist(), int(i % 2)) for i in range(300)]
    assert got_topk(spark, rows) == brute_topk(rows)
    assert got_negatives(spark, rows) == brute_negatives(rows)
    rows += [(400, [1e30, -1e30], 1), (401, [1e30, 1e30, 1e30], 1), (402, [-1e30], 0)]
    assert len(got_topk(spark, rows)) and got_negatives(spark, rows) is not None


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_searches_of_few_rows(spark, n):
    rows = [(100 * i, [1.0, float(i)], i % 2) for i in range(n)]
    assert got_topk(spark, rows) == brute_topk(rows)
    assert got_negatives(spark, rows) == brute_negatives(rows)
    rows = [(x[0] + 1, *x[1:]) for x in rows]  # no queries
    assert not got_topk(spark, rows) and not got_negatives(spark, rows)


def test_bounds_hold(spark):
    """Every score lies between the bounds of each level."""
    import pyarrow as pa

    x = [floored(e, 256) for _, e, _ in embeddings(500) if e and len(e) == 24 and None not in e and np.isfinite(np.array(e)).all()]
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(x))), "vec_id": list(range(len(x))), "label": [0] * len(x), "v": x}, schema=pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64()))]))
    made = next(hard_negatives.summaries(iter([batch])))
    rows = hard_negatives.prepared(vectors.Rows(pa.StructArray.from_arrays(made.columns, made.schema.names), 32))
    scores, at = rows.x.astype(float) @ rows.x.astype(float).T, np.arange(len(x))
    widths = []
    for level in range(len(hard_negatives.SEGMENTS)):
        lower, upper = hard_negatives.bounds(rows, at, rows, at, level)
        assert (lower <= scores).all() and (scores <= upper).all()
        widths.append((upper - lower).mean())
    assert widths[1] < widths[0]
