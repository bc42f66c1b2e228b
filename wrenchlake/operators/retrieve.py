"""Retrieval: for each question, the chunks that answer it best.

A table of questions (query_id, category_id, model_text, symptom) is answered in one go.  Everything that depends on a chunk
alone is computed once (``chunk_features``) and kept as a table, everything that depends on a question alone likewise
(``query_features``); a candidate pair then costs one narrow expression.  Long texts stay out of the shuffles: ranking moves
ids and scores only, and what is chosen is stored before it meets the chunks, so that Spark knows its size beforehand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT, SHARED_CATEGORY, Lexicon
from ..functions.text import any_of, brands_in, expand_terms, is_index_text, named_brands, page_refs, strip, symptom_intents, text, tokenize
from ..sources.steps import stored
from .scoring import scored_pairs


def chunk_features(chunks: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds what scoring needs to chunks: hay, title_kw, signals, is_index, brands.

    Store the result (``sources.steps.stored``): otherwise each step of a retrieval computes it anew for each pair.  Texts are
    lower-cased once, in a step of their own below all that looks at them."""
    rows = chunks.withColumns({"title_kw": F.lower(F.concat_ws(" ", text("title"), text("keywords"))), "_low": F.lower(text("chunk_text"))})
    rows = rows.withColumns({"hay": F.concat_ws(" ", "title_kw", "_low"), "is_index": is_index_text(F.col("_low")), "brands": brands_in(F.col("title_kw"), lexicon)})
    signals = reduce(lambda a, b: a + b, [F.contains("hay", F.lit(s)).cast("int") for s in lexicon.signals], F.lit(0))
    return rows.select(*chunks.columns, "hay", "title_kw", "is_index", "brands", signals.alias("signals"))


def query_features(queries: DataFrame, categories: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds terms, model, asked (brands), intents, symptom_tokens and cat_ids (null without a category) to questions."""
    shared = categories.where(F.col("name") == SHARED_CATEGORY).agg(F.min("id").alias("shared"))
    rows = queries.crossJoin(F.broadcast(shared))
    cats = F.when(F.col("category_id").isNotNull() & (F.col("category_id") != 0), F.array_distinct(F.filter(F.array("category_id", "shared"), lambda x: x.isNotNull())))
    return rows.withColumns(
        {
            "terms": expand_terms(F.col("model_text"), F.col("symptom"), lexicon),
            "model": F.lower(strip(text("model_text"))),
            "asked": named_brands(F.col("model_text"), F.col("symptom"), lexicon=lexicon),
            "intents": symptom_intents(F.col("symptom")),
            "symptom_tokens": F.array_distinct(tokenize(F.col("symptom"))),
            "cat_ids": cats,
        }
    ).drop("shared")


def scoped(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of question and chunk by the question's categories, for questions that have any: an equi-join."""
    named = queries.where("cat_ids IS NOT NULL").withColumn("_cat", F.explode("cat_ids"))
    return named.join(chunks.withColumnRenamed("category_id", "chunk_category"), F.col("_cat") == F.col("chunk_category")).drop("_cat")


def of_every_category(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of questions with all chunks, as an equi-join: each question goes to every category that the library has."""
    known = chunks.select(F.col("category_id").alias("_cat")).distinct().agg(F.collect_list("_cat")).scalar()
    asked = queries.withColumn("_cat", F.explode(F.concat(known, F.array(F.lit(None).cast("long")))))
    return asked.join(chunks.withColumnRenamed("category_id", "chunk_category"), F.col("_cat").eqNullSafe(F.col("chunk_category"))).drop("_cat")


def in_scope(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of question and chunk by category alone; questions without a category pair with every chunk, as they ask."""
    return scoped(queries, chunks).unionByName(of_every_category(queries.where("cat_ids IS NULL"), chunks))


def brand_lock() -> Column:
    """Questions that name brands only see chunks of those brands."""
    return (F.size("asked") == 0) | F.arrays_overlap("asked", "brands")


def candidates(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of question and chunk by category and brand.

    Questions with a category, or else with a brand, find their chunks by an equi-join.  Those with neither are asked of each
    category in turn, which is every chunk; ``word_index`` finds their best chunks without that.
    """
    free = queries.where("cat_ids IS NULL")
    shared = F.array_intersect("asked", "brands")
    owned = chunks.where("size(brands) > 0").withColumnRenamed("category_id", "chunk_category").withColumn("_own", F.explode("brands"))
    by_brand = free.where("size(asked) > 0").withColumn("_brand", F.explode("asked")).join(owned, F.col("_brand") == F.col("_own"))
    by_brand = by_brand.where(F.get(shared, F.lit(0)) == F.col("_brand")).drop("_brand", "_own")  # a pair counts under its first brand
    every = of_every_category(free.where("size(asked) = 0"), chunks)
    return scoped(queries, chunks).where(brand_lock()).unionByName(by_brand).unionByName(every)


def scope_sizes(queries: DataFrame, chunks: DataFrame, pairs=in_scope, by: tuple[str, ...] = ("category_id",)) -> DataFrame:
    """query_id, n and first_id: how many chunks are in each question's scope, and the first of them.

    ``pairs``: ``in_scope`` or ``candidates``; ``by``: what that looks at in a chunk.  Chunks that are alike in this are counted first,
    so no pair of a question and a single chunk is made or sorted."""
    alike = stored(chunks.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "alike")
    return pairs(queries, alike).groupBy("query_id").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


def chunk_score() -> Column:
    """Score of a pair from its features; 1 for a question without terms.

    Most terms do not occur: they cost one search each, and only the others are counted (in bytes, which are at hand)."""
    count = lambda t: ((F.octet_length("hay") - F.octet_length(F.replace("hay", t, F.lit("")))) / F.octet_length(t)).cast("int")
    found = F.filter("terms", lambda t: F.contains("hay", t))
    total = F.aggregate(found, F.lit(0), lambda acc, t: acc + F.when(F.contains("title_kw", t), 4).otherwise(1) + F.least(count(t), F.lit(3)))
    total = total + F.when((F.col("model") != "") & F.contains("hay", F.col("model")), 8).otherwise(0) + F.col("signals") - F.when(F.col("is_index"), 3).otherwise(0)
    return F.when(F.size("terms") == 0, 1).otherwise(total)


def score_candidates(queries: DataFrame, chunks: DataFrame, best: int | None = None) -> DataFrame:
    """query_id, id, document_id, page, is_index and score (``chunk_score``) of every chunk in a question's scope and brand.

    ``best``: for ``seed_topk`` of so many, which then needs no more than the best of each part of the chunks."""
    return scored_pairs(queries, chunks, best)


def ranked(order: list[Column], keys=("query_id",)) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def seed_topk(scored: DataFrame, k: int = 14) -> DataFrame:
    """The best max(k, 8) chunks with a positive score; a question without any keeps its first k chunks as they are
    (fallback).  The window's limit is pushed below the shuffle, so a hot question moves few rows of each task."""
    n = max(k, 8)
    positive = F.when(F.col("score") > 0, F.col("score"))
    top = scored.withColumn("rank", ranked([positive.desc_nulls_last(), F.asc("id")])).where(F.col("rank") <= n)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top.withColumn("fallback", best <= 0).where(F.when(F.col("fallback"), F.col("rank") <= k).otherwise(F.col("score") > 0))


def chart_rows(charts: DataFrame) -> DataFrame:
    """Scored rows of index charts: one for each line (or numbered item) of (query_id, id, chunk_text, intents, symptom_tokens)."""
    line = F.explode(F.split(text("chunk_text"), r"[\n\r]+|(?=\d+\.\s)")).alias("line")
    rows = charts.select("query_id", "id", "intents", "symptom_tokens", line).withColumn("low", F.lower(strip(F.col("line")))).withColumn("pages", page_refs(F.col("line")))
    want = lambda name: F.col(f"intents.{name}")
    has = lambda *values: any_of(F.col("low"), values)
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    cooling = (
        F.when(want("both_modes") & has("all mode"), 12)
        .when(want("ac") & ~want("gas") & has("on ac", "ac -", "ac mode"), 10)
        .when(want("gas") & ~want("ac") & has("on gas", "gas -", "gas mode"), 10)
        .when(has("all mode"), 9)
        .otherwise(6)
    )
    panel = F.when(has("no operation") & has("no panel"), 10).when(has("no operation") & has("has panel"), F.when(want("lights_on"), 8).otherwise(6)).otherwise(0)
    shared = F.size(F.filter("symptom_tokens", lambda t: F.contains(F.col("low"), t) & ~t.isin("the", "and", "for")))
    score = (
        points(want("freeze") & has("freeze"), 10)
        + F.when(want("cool") & has("insufficient cooling"), cooling).otherwise(0)
        + F.when(want("dead") | want("lights_off"), panel).otherwise(0)
        + points(want("lights_on") & has("has panel"), 5)
        + points(want("ac") & ~want("both_modes") & has("no ac", "operates on gas"), 8)
        + points(want("gas") & ~want("both_modes") & has("no gas", "operates on ac"), 8)
        + F.least(shared, F.lit(2))
        - points(want("cool") & ~want("freeze") & has("freeze") & ~has("insufficient"), 6)
        - points(want("lights_on") & has("no panel"), 4)
    )
    counts = (F.length("low") >= 8) & (F.size("pages") > 0)
    spare = any_of(F.lower("line"), ("insufficient cooling", "no operation", "no gas", "no ac"))
    return rows.select("query_id", "id", "pages", F.when(counts, score).alias("score"), spare.alias("spare"))


def best_rows_band(rows: DataFrame) -> DataFrame:
    """Of the rows of a chart that score 6 or more, those within 2 of the best."""
    best = F.max("score").over(Window.partitionBy("query_id", "id"))
    return rows.where("score >= 6").withColumn("best", best).where("score >= best - 2")


def chart_pages(charts: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(query_id, id, pages): the pages that each chart names for the question, with the early pages if there are any."""
    rows = chart_rows(charts).withColumn("good", F.col("score") >= 6)
    best = F.max(F.when(F.col("good"), F.col("score"))).over(Window.partitionBy("query_id", "id"))
    used = rows.withColumn("best", best).where(F.when(F.col("best").isNull(), F.col("spare")).otherwise(F.col("good") & (F.col("score") >= F.col("best") - 2)))
    pages = used.groupBy("query_id", "id").agg(F.array_distinct(F.flatten(F.collect_list("pages"))).alias("pages"))
    early = F.array(*[F.lit(p) for p in lexicon.early_pages])
    return pages.where("size(pages) > 0").withColumn("pages", F.array_distinct(F.concat("pages", early)))


def target_pages(queries: DataFrame, chunks: DataFrame, seeds: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(query_id, target_pages): pages that the charts among the leading seeds name, their own, and those next to the leading hits."""
    lead = seeds.where("rank <= 5 AND NOT fallback")
    charts = lead.where("is_index").join(chunks.select("id", "chunk_text"), "id").join(queries.select("query_id", "intents", "symptom_tokens"), "query_id")
    named = chart_pages(charts, lexicon).select("query_id", F.explode("pages").alias("page"))
    own = lead.where("is_index AND page <> 0").select("query_id", "page")
    near = lead.where("NOT is_index AND rank <= 3 AND page <> 0").select("query_id", F.explode(F.array(F.greatest(F.lit(1), F.col("page") - 1), "page", F.col("page") + 1)).alias("page"))
    return named.union(own).union(near).groupBy("query_id").agg(F.collect_set("page").alias("target_pages"))


def expand_pages(queries: DataFrame, chunks: DataFrame, seeds: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Chunks of the leading seeds' documents on the target pages.

    Documents and pages are sets of their own: a page found in one manual also selects that page of the others.
    """
    lead = seeds.where("rank <= 5 AND NOT fallback")
    pages = target_pages(queries, chunks, seeds, lexicon)
    docs = lead.select("query_id", F.col("document_id").alias("target")).distinct().join(pages, "query_id").join(queries.select("query_id", "cat_ids", "asked", "terms", "model"), "query_id")
    docs = stored(docs, "targets")  # of known size: where it is small it travels, and chunks are not shuffled
    found = docs.join(chunks.withColumnRenamed("category_id", "chunk_category"), F.col("target") == F.col("document_id"))
    scope = F.col("cat_ids").isNull() | F.array_contains("cat_ids", F.col("chunk_category"))
    return found.where(scope & brand_lock() & (F.col("page") != 0) & F.array_contains("target_pages", F.col("page"))).select("query_id", "id", "document_id", "page", "is_index", chunk_score().alias("score"))


def dedup_chunks(rows: DataFrame) -> DataFrame:
    """The first row (by ordinal) of each question, document, page and first 60 characters."""
    return rows.withColumn("_n", ranked([F.asc("ordinal")], ("query_id", "document_id", "page", "head"))).where("_n = 1").drop("_n")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 14, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """query_id, rank, id and score of the k best chunks of each question.

    ``queries`` and ``chunks`` carry their features.  Seeds are the best by score; charts and neighbours among them add
    pages; of what remains after removing repeats, manuals with a leading seed's title gain 3, and one chart at most stays.
    """
    queries = stored(queries, "questions")
    seeds = stored(seed_topk(score_candidates(queries, chunks, max(k, 8)), k), "seeds")  # few rows a question, read four times below
    more = expand_pages(queries, chunks, seeds, lexicon)
    ordinal = lambda later, rank, at: F.struct(F.lit(later).alias("later"), rank.cast("int").alias("rank"), at.alias("at"))
    first = seeds.where("NOT fallback").select("query_id", "id", "document_id", "page", "is_index", "score", ordinal(0, F.col("rank"), F.lit("")).alias("ordinal"))
    later = more.select("query_id", "id", "document_id", "page", "is_index", "score", ordinal(1, F.lit(0), F.col("id").cast("string")).alias("ordinal"))
    facts = chunks.select("id", F.lower(text("title")).alias("title"), F.left(text("chunk_text"), F.lit(60)).alias("head"))
    merged = dedup_chunks(stored(first.union(later), "found").join(facts, "id"))
    lead = seeds.where("rank <= 3 AND NOT fallback").join(facts, "id")
    titles = lead.where("rank = 1 OR title <> ''").groupBy("query_id").agg(F.collect_set("title").alias("titles"))
    total = F.col("score") + F.when(F.array_contains("titles", F.col("title")), 3).otherwise(0)
    rows = merged.join(titles, "query_id").select("query_id", "id", "is_index", "ordinal", total.alias("score"))
    order = [F.desc("score"), F.asc("is_index"), F.asc("ordinal")]
    rows = rows.withColumn("_charts", ranked(order, ("query_id", "is_index"))).where("NOT is_index OR _charts = 1")
    best = rows.withColumn("rank", ranked(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    return stored(best.union(seeds.where("fallback").select("query_id", "rank", "id", "score")), "best")
