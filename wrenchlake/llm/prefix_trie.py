"""The trie of conversations' turn prefixes, as a table of nodes.

A node is a distinct sequence of first turns.  Its digest is the exclusive or of one random 64-bit value for each (place, turn),
twice with different seeds: the digests of all prefixes of a conversation are then a running aggregate, and a parent's digest
is at hand in each row.  Distinct digests are enumerated by one aggregation with partial sums, so a first turn that a third of
all conversations share costs one row a task.

Subtree sums are made shard by shard: a shard holds whole subtrees of bounded size, its nodes sit in flat numpy arrays at the
slots of a minimal perfect hash, each lookup is verified against the digest that the slot holds, and counts are added through
the array of parent slots from the deepest level up.  Nodes with more than ``BOUND`` turns below them are too large for that:
they stay in Spark, take up the sums of the subtrees that hang on them, and add them up by pointer doubling, in rounds that
are logarithmic in the depth of that upper part.

The conversations of a node that end there are hashed in order: ids become text in pieces of ``2 ** RANGE_BITS`` ids, so no
group is larger than that; only nodes of several pieces stream them, in order and with constant memory, through one hash.

Defined results: null conv_id takes no part; null turn comes first; equal turns of one conversation go by role, then by the
MD5 digest of role and text; repeated rows are turns of their own; null role or text is empty; an empty table gives no node.
Other columns are not read.  Digests have 128 bits in all; two different prefixes of equal digest are improbable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .text import column, mix

#: A node with more turns than this below it (each conversation counted) is not put in a shard.
BOUND = 1 << 17
#: Nodes that a shard holds on average.
PER_SHARD = 1 << 16
RANGE_BITS = 12
#: Each conversation takes its first turns from the first conversation of its family.
FAMILY, MOST_SHARED = 20, 3
WORD = "[^ \\t-\\r]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def own_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, n, turn digest, words) of each turn; n counts a conversation's turns from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    out = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.md5(whole)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    at = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return out.select("conv_id", F.row_number().over(at).alias("n"), "digest", "words")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its family's first one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) with the family's first turns in place of their own, and their turns
    (conv_id, depth, digest, words, length)."""
    have = own.groupBy("conv_id").agg(F.count("*").cast("int").alias("have"))
    have = have.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", shared_turns(F.col("conv_id")))
    first = have.select(F.col("conv_id").alias("base"), F.col("have").alias("base_have"))
    convs = have.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_have", F.lit(0))))
    convs = stored(convs.withColumn("length", F.col("taken") + F.greatest(F.col("have") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "length"), "conversations")
    heads = own.where(F.col("n") <= MOST_SHARED).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where("n <= h").select("conv_id", F.col("n").alias("depth"), "digest", "words", "length")
    kept = convs.join(own, "conv_id").where("n > h").select("conv_id", (F.col("taken") + F.col("n") - F.col("h")).alias("depth"), "digest", "words", "length")
    return convs.select("conv_id", "length"), taken.unionByName(kept)


def paths(turns: DataFrame) -> DataFrame:
    """Each turn as a step of its conversation's path: digest (p1, p2) of the prefix that it ends, (q1, q2) of the one before,
    first (r1) of the path, and how many turns follow (left)."""
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.withColumn("t1", F.xxhash64("digest", "depth", F.lit(1))).withColumn("t2", F.xxhash64("digest", "depth", F.lit(2)))
    t = t.withColumn("p1", F.bit_xor("t1").over(so_far)).withColumn("p2", F.bit_xor("t2").over(so_far)).withColumn("r1", F.first("t1").over(so_far))
    return t.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("t1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("q2"), "r1", "words", (F.col("length") - F.col("depth")).alias("left"))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys.  Level after level, keys alone in their cell stay there; a cell's slot is its rank
    among the taken cells.  Other keys get some slot or none, so a lookup must be verified."""

    def __init__(self, keys: np.ndarray):
        self.levels, taken, rest = [], 0, keys
        while len(rest):
            size = 2 * len(rest) + 1
            at = self.cells(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, np.cumsum(alone) - 1 + taken))
            taken += int(alone.sum())
            rest = rest[~alone[at]]

    @staticmethod
    def cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        return (mix(mix(keys[:, 0] ^ seed) + keys[:, 1]) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self.cells(keys[rest], level, size)
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


def digests(table: pa.Table, a: str, b: str, depth: np.ndarray) -> np.ndarray:
    one, two = (table.column(c).to_numpy().view(np.uint64) for c in (a, b))
    return np.stack((one, two + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1)


def subtree_sums(table: pa.Table) -> pa.Table:
    """Sums of one shard's nodes: children, leaves and saved tokens of each node's subtree, and its parent's conv_id (null if
    the parent is not of this shard)."""
    depth = table.column("depth").to_numpy().astype(np.int64)
    keys = digests(table, "p1", "p2", depth)
    hashed = PerfectHash(keys)
    slot, n = hashed.slots(keys), len(keys)
    held = np.empty_like(keys)
    held[slot] = keys
    above = digests(table, "q1", "q2", depth - 1)
    parent_of = hashed.slots(above)
    found = (parent_of >= 0) & (held[parent_of] == above).all(axis=1)

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.empty(n, dtype=np.int64)
        out[slot] = values
        return out

    parent, level = scattered(np.where(found, parent_of, -1)), scattered(depth)
    conv, members, words = (scattered(table.column(c).to_numpy()) for c in ("conv_id", "n_convs", "words"))
    inner = parent >= 0
    children = np.bincount(parent[inner], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * words
    order = np.argsort(-level, kind="stable")
    order = order[inner[order]]
    for each in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        np.add.at(leaves, parent[each], leaves[each])
        np.add.at(saved, parent[each], saved[each])
    out = {c: table.column(c) for c in ("p1", "p2", "q1", "q2", "depth", "conv_id", "n_convs")}
    out |= {"parent_conv_id": pa.array(conv[parent[slot]], mask=parent[slot] < 0), "n_children": pa.array(children[slot]), "n_leaves": pa.array(leaves[slot]), "saved_tokens": pa.array(saved[slot])}
    return pa.table(out)


SUMS = "p1 long, p2 long, q1 long, q2 long, depth int, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def shard_roots(steps: DataFrame, heavy: DataFrame) -> DataFrame:
    """(conv_id, root): the digest of the first step below the heavy part, for conversations whose path begins there."""
    inside = steps.join(heavy.select("p1", "p2"), ["p1", "p2"], "left_semi").groupBy("conv_id").agg((F.max("depth") + 1).alias("depth"))
    return steps.join(inside, ["conv_id", "depth"]).select("conv_id", F.col("p1").alias("root"))


def doubled(top: DataFrame) -> DataFrame:
    """Adds up leaves and saved tokens over the subtrees of the heavy part: after round i each node holds the sums of all
    nodes less than 2**i below it, and points to the node 2**i above it."""
    top = stored(top.withColumns({"a1": F.col("q1"), "a2": F.col("q2")}), "top")
    while not top.where("a1 IS NOT NULL").isEmpty():
        below = top.where("a1 IS NOT NULL").groupBy(F.col("a1").alias("p1"), F.col("a2").alias("p2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        far = top.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("f1"), F.col("a2").alias("f2"))
        more = {"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("s", F.lit(0))}
        top = top.join(below, ["p1", "p2"], "left").withColumns(more).drop("l", "s").join(far, ["a1", "a2"], "left").drop("a1", "a2").withColumnsRenamed({"f1": "a1", "f2": "a2"})
        top = stored(top, "top")
    return top.drop("a1", "a2")


def hashed_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come one after another and in order."""
    node, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for p1, p2, piece in zip(*(column(batch, c).to_pylist() for c in ("p1", "p2", "piece")), strict=True):
            if (p1, p2) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (p1, p2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pa.RecordBatch.from_pydict(dict(zip(("p1", "p2", "sha"), [list(x) for x in zip(*done, strict=True)] or [[], [], []], strict=True)), schema=HASHED)
    if node:
        yield pa.RecordBatch.from_pydict({"p1": [node[0]], "p2": [node[1]], "sha": [state.hexdigest()]}, schema=HASHED)


HASHED = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("sha", pa.string())])


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(p1, p2, sha) of rows (p1, p2, conv_id): the hash of each node's ids, ascending and separated by commas."""
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ends.groupBy("p1", "p2", F.shiftright("conv_id", RANGE_BITS).alias("at")).agg(F.array_join(ids, ",").alias("piece"))
    pieces = stored(pieces, "pieces")
    count = pieces.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.first("piece").alias("piece"))
    one = count.where("n = 1").select("p1", "p2", F.sha2(F.col("piece").cast("binary"), 256).alias("sha"))
    several = pieces.join(count.where("n > 1").select("p1", "p2"), ["p1", "p2"], "left_semi").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "at")
    return one.unionByName(several.select("p1", "p2", "piece").mapInArrow(hashed_in_order, "p1 long, p2 long, sha string"))


def trie(rows: DataFrame, bound: int = BOUND, per_shard: int = PER_SHARD) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 and n_ends."""
    own = stored(own_turns(rows), "turns")
    convs, turns = rebuilt(own)
    steps = stored(paths(turns), "steps")
    nodes = steps.groupBy("p1", "p2", "depth").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("r1").alias("root"), F.max("words").alias("words"), F.sum("left").alias("below")
    )
    nodes = stored(nodes, "nodes")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(0).alias("depth"), "n_convs", "conv_id", none.alias("q1"), none.alias("q2"), F.lit(0).cast("long").alias("words"))
    heavy = nodes.where(F.col("below") > bound)
    light = nodes.where(F.col("below") <= bound)
    total, n_heavy = nodes.agg(F.count("*"), F.count_if(F.col("below") > bound)).first()
    if n_heavy:
        roots = shard_roots(steps, heavy).withColumnRenamed("root", "_root")
        light = light.join(roots, "conv_id", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root")
    n_shards = -(-total // per_shard) or 1
    light = light.withColumn("shard", F.pmod(F.xxhash64("root"), F.lit(n_shards)))
    sums = stored(light.select("shard", "p1", "p2", "q1", "q2", F.col("depth").cast("int").alias("depth"), "conv_id", "n_convs", "words").groupBy("shard").applyInArrow(subtree_sums, SUMS), "sums")

    keys = ["p1", "p2", "q1", "q2", F.col("depth").cast("int").alias("depth"), "conv_id", "n_convs"]
    top = root.select(*keys, "words").unionByName(heavy.select(*keys, "words"))
    hanging = sums.where("parent_conv_id IS NULL").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    inner = heavy.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("hc"))
    top = top.join(hanging, ["p1", "p2"], "left").join(inner, ["p1", "p2"], "left")
    or_none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    top = top.withColumn("n_children", or_none("c") + or_none("hc"))
    top = top.withColumn("n_leaves", or_none("l") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", or_none("s") + (F.col("n_convs") - 1) * F.col("words"))
    top = doubled(top.drop("c", "l", "s", "hc", "words"))

    above = top.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("_above"))
    edge = sums.where("parent_conv_id IS NULL").drop("parent_conv_id").unionByName(top).join(above, ["q1", "q2"], "left").withColumnRenamed("_above", "parent_conv_id")
    columns = ["p1", "p2", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    all_nodes = sums.where("parent_conv_id IS NOT NULL").select(*columns).unionByName(edge.select(*columns))
    zero = F.lit(0).cast("long")
    ends = steps.where("left = 0").select("p1", "p2", "conv_id").unionByName(convs.where("length = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id"))
    out = all_nodes.join(ends_hashed(ends), ["p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
