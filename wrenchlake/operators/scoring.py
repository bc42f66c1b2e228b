"""Scores of all pairs of a question and a chunk in its scope, a chunk at a time.

Chunks are shuffled once, by category and a salt, and the packs of questions that a category is asked by come before the chunks
of each such group.  A task so holds the packs of one group, never its chunks, and looks for all their terms at once in a batch
of chunks (``Needles``), with numpy: a chunk costs its bytes and the terms found in it, not questions times terms searches.  The
functions travel to executors by value; they need numpy and pyarrow.
"""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Questions of one pack, about; sets of packs that a task remembers; parts that the chunks of a category are dealt into, at most.
PACK, PACKS_HELD, SALTS = 256, 64, 64
#: Pairs that are made at once, about, and bytes that are looked through at once.
PAIRS, BLOCK = 500_000, 1 << 16
#: First bytes of a word that are looked up; an odd number that spreads them.
LEAD, SPREAD = 8, np.uint64(0x9E3779B97F4A7C15)
#: Words of so many bytes or more are looked up only where their first bytes are those of any of them.
GATE = 3


def mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * min(size, LEAD)) - 1)


def table_of(leads: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """A table of the hashes of some numbers, and how far to shift for them."""
    bits = max(12, (64 * len(leads) - 1).bit_length())
    table = np.zeros(1 << bits, bool)
    table[((leads * SPREAD) >> np.uint64(64 - bits)).view(np.int64)] = True
    return np.uint64(64 - bits), table


def places_in(codes: np.ndarray, shift: np.uint64, table: np.ndarray) -> np.ndarray:
    """Where numbers may be of those that a table was made of."""
    return np.flatnonzero(table[((codes * SPREAD) >> shift).view(np.int64)])


class Needles:
    """Finds many words, which may hold any bytes, in many texts.

    Words go by the number of their first bytes, up to eight.  At each place of the texts so many bytes are looked up in a table of
    hashes, for longer words only where their first three bytes are found; the few places that pass are compared with the words."""

    def __init__(self, words: list[bytes]):
        self.words, self.sizes = words, np.array([len(w) for w in words], np.int64)
        self.classes = []
        for size in sorted({min(len(w), LEAD) for w in words if w}):
            own = np.array([i for i, w in enumerate(words) if min(len(w), LEAD) == size])
            lead = np.array([int.from_bytes(words[i][:LEAD], "little") for i in own], np.uint64)
            leads, which = np.unique(lead, return_inverse=True)
            by = np.argsort(which, kind="stable")
            self.classes.append((mask(size), *table_of(leads), leads, np.searchsorted(which[by], np.arange(len(leads) + 1)), own[by]))
        self.gate = table_of(np.unique(np.array([int.from_bytes(w[:GATE], "little") for w in words if len(w) >= GATE], np.uint64)))

    def found(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, times), ordered by text and word, of the words that occur in an Arrow array of strings; times as
        str.count has them, without overlaps."""
        starts, data = bytes_of(texts)
        codes = np.ndarray(len(data) - LEAD, "<u8", data, strides=(1,))
        places, words = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        seen: list[list] = [[] for _ in self.classes]
        for lo in range(0, len(codes), BLOCK):
            block = codes[lo : lo + BLOCK].copy()
            begun = places_in(block & mask(GATE), *self.gate)
            some = block[begun]
            for (few, shift, table, *_), held in zip(self.classes, seen, strict=True):
                gated = few >= mask(GATE)
                code = (some if gated else block) & few
                at = places_in(code, shift, table)
                held.append(((begun[at] if gated else at) + lo, code[at]))
        for (_, _, _, leads, first, own), held in zip(self.classes, seen, strict=True):
            at, code = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (places[0], np.empty(0, np.uint64))
            lead = np.minimum(np.searchsorted(leads, code), len(leads) - 1)
            same = leads[lead] == code
            at, lead = at[same], lead[same]
            if first[-1] == len(leads) and self.sizes[own].max() <= LEAD:  # the first bytes are the word
                places.append(at)
                words.append(own[lead])
                continue
            by = np.argsort(lead, kind="stable")
            at, lead = at[by], lead[by]
            for k in np.unique(lead):
                lo, hi = np.searchsorted(lead, [k, k + 1])
                for w in own[first[k] : first[k + 1]]:
                    here, word = at[lo:hi], self.words[w]
                    here = here[here + len(word) <= len(codes)]
                    for o in range(LEAD, len(word), LEAD):
                        here = here[(codes[here + o] & mask(len(word) - o)) == np.uint64(int.from_bytes(word[o : o + LEAD], "little"))]
                    places.append(here)
                    words.append(np.full(len(here), w))
        at, word = np.concatenate(places), np.concatenate(words)
        text = np.searchsorted(starts, at, side="right") - 1
        whole = at + self.sizes[word] <= starts[text + 1]  # no word goes on in the next text
        at, word, text = at[whole], word[whole], text[whole]
        pair = text * max(len(self.words), 1) + word
        by = np.argsort(pair, kind="stable")  # places of a word ascend
        at, pair, word, text = at[by], pair[by], word[by], text[by]
        again = pair[1:] == pair[:-1]
        new = np.flatnonzero(np.concatenate(([True], ~again))[: len(pair)])
        times = np.diff(np.append(new, len(pair)))
        text, one = text[new], word[new]
        over = np.flatnonzero(again & (at[1:] - at[:-1] < self.sizes[word[1:]])) if len(at) else new
        for i in np.unique(np.searchsorted(new, over, side="right") - 1):
            times[i] = data[starts[text[i]] : starts[text[i] + 1]].tobytes().count(self.words[one[i]])
        return text, one, times


def bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of an Arrow array of strings begins and the last ends, and their bytes with some zeros behind."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    out = np.zeros(size + LEAD, np.uint8)
    if size:
        out[:size] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], out


class Pack:
    """Questions that are asked of the same chunks; ``number`` gives each word that is looked for its place in the list."""

    def __init__(self, text: str, number: dict):
        questions = json.loads(text)
        self.ids = [q["query_id"] for q in questions]
        self.bare = np.array([not q["terms"] for q in questions], bool)
        self.asked = [frozenset(q["asked"]) for q in questions]
        self.open: dict = {}
        place = lambda w: number.setdefault(w.encode(), len(number))
        self.terms = [(place(t), i) for i, q in enumerate(questions) for t in q["terms"]]
        self.models = [(place(q["model"]), i) for i, q in enumerate(questions) if q["terms"] and q["model"]]

    def settle(self, words: int) -> None:
        """Lists by word, once all words have their places."""
        self.post, self.named = (by_word(pairs, words) for pairs in (self.terms, self.models))

    def seeing(self, brands: tuple) -> np.ndarray:
        """Whether a chunk of these brands is for each question: those that name none, or one of them."""
        if brands not in self.open:
            self.open[brands] = np.array([not a or not a.isdisjoint(brands) for a in self.asked], bool)
        return self.open[brands]

    def scores(self, static: np.ndarray, text: np.ndarray, word: np.ndarray, points: np.ndarray) -> np.ndarray:
        """[chunk, question]: the score, from a chunk's own part and the words found: (text, word, points)."""
        total = np.zeros(len(static) * len(self.ids))
        for (first, who), worth in ((self.post, points), (self.named, np.full(len(points), 8))):
            times = first[word + 1] - first[word]
            at = np.repeat(first[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
            total += np.bincount(np.repeat(text, times) * len(self.ids) + who[at], np.repeat(worth, times), len(total))
        total = total.astype(np.int32).reshape(len(static), -1) + static[:, None]
        total[:, self.bare] = 1
        return total


def by_word(pairs: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (word, question): where each word's questions begin and end, and the questions."""
    word, who = np.array(pairs, np.int64).reshape(-1, 2).T
    by = np.argsort(word, kind="stable")
    return np.searchsorted(word[by], np.arange(words + 1)), who[by]


class Group:
    """The packs that a group of chunks is asked by, and their words."""

    def __init__(self, texts: tuple):
        number: dict = {}
        self.packs = [Pack(t, number) for t in texts]
        for pack in self.packs:
            pack.settle(len(number))
        self.needles = Needles(list(number))

    def scored(self, rows, best: int | None):
        """(ids, places, scores) of the pairs of each pack with some chunks; of each question only the ``best``, as ``seed_topk`` orders
        them, if that is given."""
        title = rows.column("title_kw").fill_null("").dictionary_encode()
        of_title, in_title, _ = self.needles.found(title.dictionary)
        text, word, times = self.needles.found(rows.column("hay").fill_null(""))
        n = max(len(self.needles.words), 1)
        points = np.where(np.isin(title.indices.to_numpy()[text] * n + word, of_title * n + in_title), 4, 1) + np.minimum(times, 3)
        static = rows.column("signals").to_numpy() - np.where(rows.column("is_index").to_numpy(zero_copy_only=False), 3, 0).astype(np.int32)
        brands = rows.column("brands").fill_null("[]").dictionary_encode()
        sets = [json.loads(b) for b in brands.dictionary.to_pylist()]
        ids = rows.column("id").to_pylist() if best is not None else None
        before = np.empty(len(static), np.int64)  # the place of each chunk in the order of ids
        if ids is not None:
            before[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        for pack in self.packs:
            total = pack.scores(static, text, word, points)
            seen = np.stack([pack.seeing(tuple(b)) for b in sets])[brands.indices.to_numpy()]
            if best is None:
                place, who = np.nonzero(seen)
            else:
                order = np.where(seen, np.maximum(total, 0).astype(np.int64) * len(before) + (len(before) - 1 - before)[:, None], -1)
                top = np.argpartition(-order, best, axis=0)[:best] if len(before) > best else np.broadcast_to(np.arange(len(before))[:, None], order.shape)
                who = np.broadcast_to(np.arange(len(pack.ids)), top.shape)[at := np.take_along_axis(order, top, 0) >= 0]
                place = top[at]
            yield pack.ids, who, place, total[place, who]


def scorer(key, best: int | None):
    """Batches of (_of, _salt, pack, id, document_id, page, is_index, hay, title_kw, brands, signals), with the packs of a group before
    its chunks, to scored pairs; of each batch only the ``best`` of a question if that is given: no other row of the batch can be
    among its best of all."""

    def runs(batch):
        """(start, end) of the rows of one group."""
        of = batch.column("_of").dictionary_encode().indices.fill_null(-1).to_numpy()
        salt = batch.column("_salt").to_numpy()
        cut = np.flatnonzero((of[1:] != of[:-1]) | (salt[1:] != salt[:-1])) + 1
        return zip([0, *cut.tolist()], [*cut.tolist(), len(of)], strict=True)

    def score(batches):
        import pyarrow as pa

        known, group, texts, now = {}, None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi in runs(batch):
                rows = batch.slice(lo, hi - lo)
                mine = (rows.column("_of")[0].as_py(), rows.column("_salt")[0].as_py())
                if mine != now:
                    now, texts, group = mine, [], None
                heads = len(rows) - rows.column("pack").null_count
                texts += rows.column("pack").slice(0, heads).to_pylist()
                if heads:
                    group = None
                if not texts or heads == len(rows):
                    continue
                if group is None:
                    if len(known) >= PACKS_HELD:
                        known.clear()
                    group = known.get(tuple(texts)) or known.setdefault(tuple(texts), Group(tuple(texts)))
                step = max(1, PAIRS // max(len(p.ids) for p in group.packs))
                for at in range(heads, len(rows), step):
                    some = rows.slice(at, step)
                    for ids, who, place, scores in group.scored(some, best):
                        held = some.select(["id", "document_id", "page", "is_index"]).take(pa.array(place))
                        names = ["query_id", *held.schema.names, "score"]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, key).take(pa.array(who)), *held.columns, pa.array(scores, pa.int32())], names=names)

    return score


def packs_of(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(_cat, pack): the questions asked of each of the library's categories, in packs, as JSON.  Questions without a category are asked
    of all."""
    known = chunks.select(F.col("category_id").alias("_cat")).distinct().agg(F.collect_list("_cat")).scalar()
    every = F.concat(known, F.array(F.lit(None).cast("long")))
    asked = stored(questions.select("query_id", "terms", "model", "asked", F.explode(F.coalesce(F.col("cat_ids"), every)).alias("_cat")), "asked")
    n = F.ceil(F.count("*") / F.lit(PACK))
    sizes = asked.groupBy("_cat").agg(n.alias("packs"))
    dealt = asked.alias("a").join(sizes.alias("s"), F.col("a._cat").eqNullSafe(F.col("s._cat"))).select("a.*", F.pmod(F.xxhash64("query_id"), "packs").alias("_pack"))
    one = F.struct("query_id", "terms", "model", "asked")
    return stored(dealt.groupBy("_cat", "_pack").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("pack")).drop("_pack"), "packs")


def scored_pairs(questions: DataFrame, chunks: DataFrame, best: int | None = None) -> DataFrame:
    """query_id, id, document_id, page, is_index and score of every chunk in a question's scope and brand; with ``best``, at least
    all that ``seed_topk`` can choose for so many."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = chunks.sparkSession
    key = questions.schema["query_id"].dataType
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    salts = min(SALTS, parts)
    said = F.lit(None).cast("string").alias("pack")
    rows = chunks.select(F.col("category_id").alias("_of"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_salt"), said, "id", "document_id", "page", "is_index", "hay", "title_kw", F.to_json("brands").alias("brands"), "signals")
    heads = packs_of(questions, chunks).select(F.col("_cat").alias("_of"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), "pack")
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition(parts, "_of", "_salt")
    kept = {f.name: f.dataType.simpleString() for f in chunks.select("id", "document_id", "page", "is_index").schema}
    made = f"query_id {key.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in kept.items()) + ", score int"
    return dealt.sortWithinPartitions("_of", "_salt", F.col("pack").asc_nulls_last()).mapInArrow(scorer(to_arrow_type(key), best), made)
