"""Retrieval by an index of words, for questions that no category or brand narrows down.

The index holds, for each word of the library, the chunks that have it.  A term is a run of letters and digits, so each of its
occurrences lies within one word: matching terms with the dictionary (by their rarest 3-gram) and following the words to their
chunks gives every chunk with any of a question's terms, and all that its score is made of.

A chunk without any term or model match scores its static part (signals, chart) and no more.  So the best k are found without
looking at the rest of the library: the chunks that the words lead to, and, only where the k-th of them does not beat the
largest static part, the head of a list sorted by that part.  Questions whose words lead to more than ``most`` chunks are
scored against the library instead (``retrieve.score_candidates``), which then costs no more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.steps import stored
from .matching import TRAVEL, gram_table, matches
from .retrieve import ranked, score_candidates, seed_topk

#: A word: a run of letters and digits, or any other character that is not white space.
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Questions that lead to more chunks than this are not selective.
MOST = 20_000


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


@dataclass
class WordIndex:
    """words: (word, no, n, titled); dictionary: (word, chunks); grams: (id, gram) of its words; facts: (no, static, and what scoring
    needs of a chunk).  A chunk's number stands for its id."""

    words: DataFrame
    dictionary: DataFrame
    grams: DataFrame
    facts: DataFrame


#: What ``score_candidates`` needs of a chunk.
SCORED = ("id", "document_id", "category_id", "page", "is_index", "hay", "title_kw", "brands", "signals")


def counted(words: Column, titled: Column) -> Column:
    """(word, n, titled) of each distinct one of a chunk's words, as an array: each run of the sorted words is one."""

    def runs(x: Column) -> Column:
        word = lambda i: F.get(x["w"], i)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x["w"]) - 1, F.lit(0))), lambda i: (i == 0) | (word(i) != word(i - 1)))
        entry = lambda s: lambda i, k: F.struct(word(i).alias("word"), (F.coalesce(F.get(s, k + 1), F.size(x["w"])) - i).alias("n"), F.array_contains(x["t"], word(i)).alias("titled"))
        return bound(starts, lambda s: F.transform(s, entry(s)))

    return bound(F.struct(F.sort_array(words).alias("w"), titled.alias("t")), runs)


def build(chunks: DataFrame) -> WordIndex:
    """The index of chunks with their features, of which a copy without the original texts is kept as ``facts``.

    A chunk's words are counted in its own row and sorted within the part of the library that a task reads, so they are neither
    shuffled nor do they carry their chunk's id; the words of a part lie together, and a lookup reads their row groups in each part."""
    static = F.col("signals") - F.when(F.col("is_index"), 3).otherwise(0)
    facts = stored(chunks.select(*SCORED, static.alias("static"), F.monotonically_increasing_id().alias("no")), "facts")
    # The outer form, as Spark would else compute the words once more to see whether there are any.
    said = facts.select("no", F.inline_outer(counted(words_of(F.col("hay")), words_of(F.col("title_kw"))))).where("word IS NOT NULL")
    # A number in two parts of few values each, which a file keeps as places in a list.
    parts = said.select("word", F.shiftright("no", 12).alias("block"), (F.col("no") % 4096).cast("int").alias("at"), "n", "titled")
    words = stored(parts.sortWithinPartitions("word", "block", "at"), "words")
    words = words.select("word", (F.col("block") * 4096 + F.col("at")).alias("no"), "n", "titled")
    dictionary = stored(words.groupBy("word").agg(F.count("*").alias("chunks")), "dictionary")
    grams = gram_table(dictionary.select(F.col("word").alias("id"), F.col("word").alias("text")))
    grams = stored(grams.repartitionByRange("gram").sortWithinPartitions("gram"), "grams")
    return WordIndex(words, dictionary, grams, facts)


def times(needle: Column, c: Column) -> Column:
    """How often the needle occurs, without overlaps."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, needle, F.lit("")))) / F.octet_length(needle)).cast("int")


def longest_word(model: Column) -> Column:
    return F.array_max(F.transform(words_of(model), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def terms_in_dictionary(needles: DataFrame, index: WordIndex) -> DataFrame:
    """(needle, word, times, chunks): the words that hold each needle, and how many chunks have the word."""
    found = matches(index.dictionary.select(F.col("word").alias("id"), F.col("word").alias("text")), needles, index.grams, times=times(F.col("needle"), F.col("text")))
    return found.withColumnRenamed("id", "word").join(index.dictionary, "word").select("needle", "word", "times", "chunks")


def asked_needles(questions: DataFrame) -> DataFrame:
    """(query_id, needle, is_model): the terms of each question and the longest word of its model."""
    model = F.when(F.col("model") != "", F.array(F.struct(longest_word(F.col("model")).alias("needle"), F.lit(True).alias("is_model")))).otherwise(F.array().cast("array<struct<needle:string,is_model:boolean>>"))
    terms = F.transform("terms", lambda t: F.struct(t.alias("needle"), F.lit(False).alias("is_model")))
    return questions.select("query_id", F.inline(F.concat(terms, model)))


def index_hits(questions: DataFrame, asked: DataFrame, held: DataFrame, index: WordIndex) -> DataFrame:
    """(query_id, no, points) of every chunk that has a term of the question, or its model."""
    wanted = stored(held.join(asked.select("needle").distinct(), "needle", "left_semi").select("word", "needle", "times"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= TRAVEL else wanted  # so the index stays where it is
    hits = index.words.join(wanted, "word").groupBy("needle", "no").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.max("titled").alias("titled"))
    hits = stored(hits, "hits")
    points = F.when(F.col("titled"), 4).otherwise(1) + F.least("n", F.lit(3).cast("long"))
    by_term = asked.where("NOT is_model").join(hits, "needle").select("query_id", "no", points.alias("points"))
    models = questions.where("model <> ''").select("query_id", "model")
    by_model = stored(asked.where("is_model").join(hits, "needle").select("query_id", "no").join(models, "query_id"), "models")  # of known size, before texts are read
    by_model = by_model.join(index.facts.select("no", "hay"), "no")
    by_model = by_model.where(F.contains("hay", F.col("model"))).select("query_id", "no", F.lit(8).cast("long").alias("points"))
    return by_term.unionByName(by_model).groupBy("query_id", "no").agg(F.sum("points").alias("points"))


def seeds_by_index(questions: DataFrame, index: WordIndex, k: int = 14, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Seeds, as ``seed_topk`` gives them, of the selective ones among questions of the whole library; and the other questions."""
    asked = stored(asked_needles(questions), "asked")
    held = stored(terms_in_dictionary(asked.select("needle"), index), "held")
    cost = asked.join(held.groupBy("needle").agg(F.sum("chunks").alias("chunks")), "needle", "left").groupBy("query_id").agg(F.sum(F.coalesce("chunks", F.lit(0))).alias("cost"))
    costs = questions.select("query_id").join(cost, "query_id", "left").select("query_id", F.coalesce("cost", F.lit(0)).alias("cost"))
    costs = stored(costs, "costs")
    few = costs.where(F.col("cost") <= most).select("query_id")
    rest = questions.join(costs.where(F.col("cost") > most).select("query_id"), "query_id", "left_semi")
    mine = questions.join(few, "query_id", "left_semi")
    facts, n = index.facts.select("no", "id", "document_id", "page", "is_index", "static"), max(k, 8)
    hits = stored(stored(index_hits(mine, asked.join(few, "query_id", "left_semi"), held, index), "points").join(facts, "no").select("query_id", "id", "document_id", "page", "is_index", (F.col("points") + F.col("static")).alias("score")), "scored")

    # A question whose k-th hit does not beat the largest static part looks at the head of the list by static part, as far as
    # its own hits could push the k-th chunk down; one without terms, or without a positive score, at the first chunks by id.
    largest = facts.agg(F.max("static")).scalar()
    at = hits.where("score > 0").withColumn("n", ranked([F.desc("score"), F.asc("id")])).where(F.col("n") <= n)
    least = at.groupBy("query_id").agg(F.count("*").alias("have"), F.min("score").alias("least"))
    count = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    needy = mine.select("query_id", (F.size("terms") == 0).alias("bare")).join(least, "query_id", "left").join(count, "query_id", "left").na.fill({"hits": 0, "have": 0})
    needy = stored(needy.where((F.col("have") < n) | (F.col("least") <= largest) | F.col("bare")), "needy")
    reach = n + (needy.agg(F.max("hits")).first()[0] or 0)
    line = F.row_number().over(ranked_all([F.desc("static"), F.asc("id")]))
    head = stored(facts.orderBy(F.desc("static"), "id").limit(reach).withColumn("place", line), "head")
    first = stored(facts.orderBy("id").limit(n).withColumn("place", F.row_number().over(ranked_all([F.asc("id")]))), "first")

    def taken(source: DataFrame, up_to: Column) -> DataFrame:
        places = needy.select("query_id", "bare", F.explode(F.sequence(F.lit(1), up_to.cast("int"))).alias("place"))
        return places.join(source, "place").select("query_id", "id", "document_id", "page", "is_index", F.when(F.col("bare"), 1).otherwise(F.col("static")).cast("long").alias("score"))

    more = taken(head, F.col("hits") + n).unionByName(taken(first, F.lit(n))).distinct().join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    bare = needy.where("bare").select("query_id")
    own = hits.join(bare, "query_id", "left_anti").unionByName(hits.join(bare, "query_id", "left_semi").withColumn("score", F.lit(1).cast("long")))
    return seed_topk(own.unionByName(more), k), rest


def ranked_all(order: list[Column]):
    """A window over a few rows that a limit has already bounded."""
    from pyspark.sql import Window

    return Window.orderBy(*order)


def seeds(questions: DataFrame, chunks: DataFrame, index: WordIndex, k: int = 14, most: int = MOST) -> DataFrame:
    """``retrieve.seed_topk`` of all questions: those of the whole library by the index where that is cheaper, all others, which
    a category or a brand narrows down, by an equi-join."""
    free = F.col("cat_ids").isNull() & (F.size("asked") == 0)
    found, rest = seeds_by_index(questions.where(free), index, k, most)
    scanned = score_candidates(questions.where(~free).unionByName(rest), chunks, max(k, 8))
    return found.unionByName(seed_topk(scanned, k), allowMissingColumns=True)
