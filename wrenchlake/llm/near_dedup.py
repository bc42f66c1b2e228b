"""MinHash near-dedup: links documents whose shingle sets overlap by ``percent`` of their union, and groups what is linked.

Method: a multi-index Hamming join of b-bit signatures.  A set's signature is ``ENTRIES`` minimum hashes of 16 bits, held as
``CHUNKS`` longs of four entries.  Two signatures that differ in at most ``MOST_ERRORS`` = 2 * CHUNKS - 1 entries have, by
pigeonhole, a chunk with one error or none; so each chunk is filed four times, each time without one of its entries, and the
pair meets in one bucket at least.  All pairs under that distance are found; a pair at 85 % misses it with a chance of about
1.3e-8.  Links are confirmed on the full sets.

Equal sets are one node.  Within a bucket each node is compared with the bucket's smallest node and then with its most typical
one (the one with the smallest share of shingles that no other node has).  What that leaves in different components of one
bucket is compared pair by pair, unless the shingles that only one of the two has, or those that the two lack of the typical
node's, already rule the link out; so no link is lost, and members of a group that are linked already do not meet.  Components come from alternating star steps.

Defined results: A-Z is lower-cased; fewer than ``k`` words make one shingle; null, empty and blank texts have no shingle, link
with nothing and are kept; rows with null doc_id have component null and are kept; equal rows share their component, and
``drop_near_duplicates`` leaves one row of each; rows with one doc_id and different texts are judged each by its text, and of
each group the row with the smallest doc_id (of equal ones, the smallest hash of the text) stays; empty tables give empty
tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import components, stored
from .text import Block, column, mix, range_hash, scan, unused, windows

CHUNKS = 12
ENTRIES = 4 * CHUNKS
MOST_ERRORS = 2 * CHUNKS - 1
SIGNATURE = [f"s{i}" for i in range(CHUNKS)]
WORDS = 5
PERCENT = 85
#: Rows that carry sets in an Arrow batch.
SETS_A_BATCH = 256
#: Bits that tell which shingles of a typical set another set lacks.
LOST_BITS = 1024
LOST = [f"l{i}" for i in range(LOST_BITS // 64)]


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    block = Block(texts, lower=True)
    doc, hashes = block.words()[2], block.word_hashes()
    at, h = windows(hashes, doc, k)
    first, last = np.searchsorted(doc, np.arange(block.n)), np.searchsorted(doc, np.arange(block.n), side="right")
    lo, hi = np.searchsorted(doc[at], np.arange(block.n)), np.searchsorted(doc[at], np.arange(block.n), side="right")
    whole = range_hash(hashes, first, last)
    return [np.unique(h[a:b]) if b > a else whole[i : i + 1] if last[i] > first[i] else h[:0] for i, (a, b) in enumerate(zip(lo, hi, strict=True))]


def permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:ENTRIES, None], seeds[ENTRIES:, None] | np.uint64(1)


def signature(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """CHUNKS longs: the low 16 bits of each of ENTRIES minimum hashes."""
    least = np.full(ENTRIES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[None, i : i + 4096] ^ flips) * factors).min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int64)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on order."""
    with np.errstate(over="ignore"):
        return int(mix(shingles).sum().astype(np.int64)), int(mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum().astype(np.int64))


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, k (hash of the text), n_shingles, the set's hash (h1, h2) and its signature."""

    def kernel(batch, texts):
        flips, factors = permutations()
        sets = shingle_sets(texts, k)
        sig = np.stack([signature(s, flips, factors) for s in sets]) if sets else np.empty((0, CHUNKS), np.int64)
        hashes = np.array([set_hash(s) for s in sets], dtype=np.int64).reshape(-1, 2)
        return {"doc_id": column(batch, "doc_id"), "k": column(batch, "k"), "n_shingles": np.array([len(s) for s in sets], dtype=np.int64), "h1": hashes[:, 0], "h2": hashes[:, 1], **{c: sig[:, i] for i, c in enumerate(SIGNATURE)}}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), F.col("text").cast("string").alias("text"))
    return scan(rows, "doc_id long, k long, n_shingles long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in SIGNATURE), kernel)


def differing(a: str, b: str) -> list[Column]:
    """For each chunk of two signatures, a long whose bits 0, 16, 32 and 48 tell which entries differ."""
    out = []
    for c in SIGNATURE:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        out.append(x.bitwiseAND(F.lit(0x0001000100010001)))
    return out


def distance(a: str, b: str) -> Column:
    """Number of entries in which two signatures differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(x) for x in differing(a, b)])


def first_slot(a: str, b: str) -> Column:
    """The first slot under which both signatures are filed alike, so that a pair counts in one of its buckets only."""
    slot = F.lit(-1)
    for i, x in reversed(list(enumerate(differing(a, b)))):
        lane = reduce(lambda rest, m: F.when(x == (1 << 16 * m), m).otherwise(rest), (1, 2, 3), F.lit(0))
        slot = F.when(F.bit_count(x) <= 1, 4 * i + lane).otherwise(slot)
    return slot


def bucket_keys() -> Column:
    """The keys under which a signature is filed: each chunk without one of its four entries."""
    lanes = [~(0xFFFF << (16 * m)) & 0xFFFFFFFFFFFFFFFF for m in range(4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in lanes]
    return F.array(*[F.xxhash64(F.lit(4 * i + m), F.col(c).bitwiseAND(F.lit(signed[m]))) for i, c in enumerate(SIGNATURE) for m in range(4)])


def close(a: str, b: str, percent: int) -> Column:
    """What a linked pair's sizes and signatures satisfy."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (100 * small >= percent * large) & (distance(a, b) <= MOST_ERRORS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose full sets overlap enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sa, sb = column(batch, "sa"), column(batch, "sb")
            keep = []
            for x, y in zip(sa, sb, strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_pydict({"a": column(batch, "a"), "b": column(batch, "b")}).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def stored_few(df: DataFrame, name: str) -> DataFrame:
    """``stored`` of rows that carry whole sets: they pass to Python few at a time, so a batch stays small."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(SETS_A_BATCH))
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the texts of their own documents."""

    def kernel(batch, texts):
        sets = shingle_sets(texts, k)
        hashes = np.array([set_hash(s) for s in sets], dtype=np.int64).reshape(-1, 2)
        return {"id": column(batch, "id"), "h1": hashes[:, 0], "h2": hashes[:, 1], "shingles": [s.tobytes() for s in sets]}

    own = nodes.select("node", "id", "h1", "h2").join(wanted, "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = scan(texts.join(own.select("id").distinct(), "id", "left_semi"), "id long, h1 long, h2 long, shingles binary", kernel)
    return stored(sets.join(own, ["id", "h1", "h2"]).select("node", "shingles").dropDuplicates(["node"]), "sets")


def numbered(sets: DataFrame) -> DataFrame:
    """Adds a node number to the sets (id, h1, h2): the smallest doc_id that has it, or, where other sets have the same one, a
    negative number of its hash."""
    twins = stored(sets.groupBy("id").count().where("count > 1").select("id"), "twins")
    if twins.isEmpty():
        return sets.withColumn("node", F.col("id"))
    named = sets.join(twins.withColumn("twin", F.lit(True)), "id", "left")
    return named.withColumn("node", F.when(F.col("twin"), -1 - F.shiftrightunsigned("h1", 1)).otherwise(F.col("id"))).drop("twin")


def still_open(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, slot, node, part) of the buckets that hold more than one component; part: a node's component."""
    placed = shared.select("key", "slot", "node").join(groups, "node", "left").select("key", "slot", "node", F.coalesce("component", "node").alias("part"))
    mixed = stored(placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key"), "mixed")
    return stored(placed.join(mixed, "key"), "open")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many of its shingles no other of these nodes has; of 32 bits each, so rather too few than too many."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in column(batch, "shingles")]
            node = np.repeat(column(batch, "node").to_numpy(), [len(p) for p in parts])
            yield pa.RecordBatch.from_pydict({"node": node, "h": (np.concatenate(parts or [np.empty(0, np.uint64)]) >> np.uint64(32)).astype(np.uint32).view(np.int32)})

    each = sets.select("node", "shingles").mapInArrow(run, "node long, h int")
    return each.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("own"))


def linkable(a: str, b: str, percent: int) -> Column:
    """Whether two sets can overlap enough, given that neither shares its own shingles with any other."""
    most = F.least(F.col(f"{a}.n_shingles") - F.col(f"{a}.own"), F.col(f"{b}.n_shingles") - F.col(f"{b}.own"))
    return (100 + percent) * most >= percent * (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles"))


def lost_shingles(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b): how many shingles b has that a lacks (outside), and those of a that b lacks as LOST_BITS bits (l0, ...): a
    bit is set if a shingle of its hash is missing, so there are never more bits than missing shingles."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sa, sb = column(batch, "sa"), column(batch, "sb")
            outside, bits = np.zeros(len(sa), dtype=np.int64), np.zeros((len(sa), LOST_BITS), dtype=np.uint8)
            for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                lost = np.setdiff1d(x, y, assume_unique=True)
                outside[i] = len(y) - (len(x) - len(lost))
                bits[i, (mix(lost) % np.uint64(LOST_BITS)).astype(np.int64)] = 1
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": column(batch, "a"), "b": column(batch, "b"), "outside": outside, **{c: words[:, j] for j, c in enumerate(LOST)}})

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, outside long, " + ", ".join(f"{c} long" for c in LOST))


def reachable(a: str, b: str, percent: int) -> Column:
    """Whether two sets can overlap enough, given what each has lost of, and has outside, their bucket's typical set: they share
    at most what neither has lost, and of what lies outside no more than either has beside its own shingles."""
    lost = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{c}").bitwiseOR(F.col(f"{b}.{c}"))) for c in LOST])
    most = F.col(f"{a}.typical_size") - lost + F.least(*[F.greatest(F.col(f"{x}.outside") - F.col(f"{x}.own"), F.lit(0)) for x in (a, b)])
    return (100 + percent) * most >= percent * (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles"))


def joined(links: DataFrame, more: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components after further links, which join whole components: only those go through the rounds again."""
    if more.isEmpty():
        return links, groups
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    upper = stored(components(between).select(F.col("node").alias("component"), F.col("component").alias("top")), "upper")
    lower = groups.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = upper.select(F.col("component").alias("node"), F.col("top").alias("component")).join(groups.select("node"), "node", "left_anti")
    return links.union(more), stored(lower.union(fresh), "groups")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    return placed_documents(docs, percent, k).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def placed_documents(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """doc_id, k (hash of the text), n_shingles, component_id and the component's own number (two components of texts that share
    their smallest doc_id have one component_id) of each document."""
    signed = stored(signatures(docs, k), "signatures")
    sets = stored(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), *[F.min(c).alias(c) for c in ("n_shingles", *SIGNATURE)]),
        "nodes",
    )
    nodes = numbered(sets)
    filed = nodes.select("node", F.posexplode(bucket_keys()).alias("slot", "key"))
    buckets = stored(filed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "buckets")
    shared = stored(filed.join(buckets, "key"), "filed")
    facts = nodes.select("node", "n_shingles", *SIGNATURE)

    def near(pairs: DataFrame, also: Column | None = None) -> DataFrame:
        x, y = facts.alias("x"), facts.alias("y")
        fits = close("x", "y", percent) if also is None else close("x", "y", percent) & also
        return pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & fits).select("a", "b")

    stars = stored(near(shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()), "stars")
    wanted = shared.select("node").distinct()
    sets = full_sets(docs, nodes, wanted, k)
    links = stored_few(confirmed(stars, sets, percent), "confirmed")
    groups = stored(components(links), "groups")

    # Nodes of one bucket that the stars left in different components: first a second star around the bucket's most typical
    # node, then every remaining pair that can still be linked.
    open_ = still_open(shared, groups)
    if not open_.isEmpty():
        facts = stored_few(open_.select("node").distinct().join(facts, "node").join(own_shingles(sets.join(open_.select("node").distinct(), "node", "left_semi")), "node", "left").withColumn("own", F.coalesce("own", F.lit(0))), "facts")
        typical = stored(open_.join(facts.select("node", "own", "n_shingles"), "node").groupBy("key").agg(F.min(F.struct(F.col("own") / F.col("n_shingles"), "node"))["node"].alias("first")), "typical")
        second = near(open_.join(typical, "key").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), linkable("x", "y", percent))
        more = stored_few(confirmed(stored(second, "stars"), sets, percent), "confirmed")
        links, groups = joined(links, more, groups)
        open_ = still_open(shared, groups).join(typical.withColumnRenamed("first", "typical"), "key")
        lost = stored_few(lost_shingles(stored(open_.select(F.col("typical").alias("a"), F.col("node").alias("b")).distinct(), "pairs"), sets), "lost")
        sizes = facts.select(F.col("node").alias("typical"), F.col("n_shingles").alias("typical_size"))
        full = open_.join(facts, "node").join(sizes, "typical").join(lost.withColumnsRenamed({"a": "typical", "b": "node"}), ["typical", "node"])
        full = stored(full, "open")
        x, y = full.alias("x"), full.alias("y")
        can = linkable("x", "y", percent) & reachable("x", "y", percent) & close("x", "y", percent)
        apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")) & can & (F.col("x.slot") == first_slot("x", "y"))
        rest = stored(x.join(y, apart).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "rest")
        links, groups = joined(links, stored_few(confirmed(rest, sets, percent), "confirmed"), groups)

    placed = stored(nodes.select("h1", "h2", "id", "node").join(groups, "node", "left").select("h1", "h2", "id", F.coalesce("component", "node").alias("component")), "placed")
    if placed.where("component < 0").isEmpty():
        placed = placed.withColumn("component_id", F.col("component"))
    else:  # some nodes have no doc_id for a number: components are named after their smallest doc_id
        least = stored(placed.groupBy("component").agg(F.min("id").alias("component_id")), "least")
        placed = placed.join(least, "component")
    out = signed.select("doc_id", "k", "n_shingles", "h1", "h2").join(placed.select("h1", "h2", "component", "component_id"), ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "k", "n_shingles", component.alias("component_id"), "component")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    a, b = unused(docs, "keep"), unused(docs, "keep_text")
    rows = placed_documents(docs, percent, k).where("doc_id IS NOT NULL AND (n_shingles = 0 OR doc_id = component_id)")
    # Of a group, the smallest text of its smallest doc_id; texts without a shingle are groups of their own.
    own = F.when(F.col("n_shingles") == 0, F.col("k"))
    keep = stored(rows.groupBy("component_id", "component", own.alias("own")).agg(F.min("k").alias(b)).select(F.col("component_id").alias(a), b).distinct(), "keep")
    named = docs.where("doc_id IS NOT NULL").withColumn(b, F.xxhash64("text"))
    kept = named.join(keep, (F.col("doc_id").cast("long") == F.col(a)) & (named[b] == keep[b]), "left_semi").dropDuplicates(["doc_id", b]).drop(b)
    return kept.union(docs.where("doc_id IS NULL"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
