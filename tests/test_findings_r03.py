"""What the findings of round 3 named, on small inputs."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from wrenchlake.functions import text as T
from wrenchlake.operators import evidence, matching, retrieve
from wrenchlake.operators.chunks import with_document
from wrenchlake.plans import queries
from wrenchlake.plans.queries import QUERIES
from wrenchlake.sources import chunk_table
from wrenchlake.sources.steps import new_path, spread
from wrenchlake.streaming import streams


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_default_scores_joins_no_notes(spark, small):
    """Each note is scored where it is: only the shared category is joined, by the cross join of one row."""
    plan = plan_of(QUERIES["default_scores"](spark, small))
    assert not re.search("SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", plan)


def test_entries_named_keeps_rows_of_one_id_apart(spark):
    texts = spark.createDataFrame([(1, "norcold and pd"), (1, "norcold and pd"), (1, "suburban"), (2, "nothing"), (3, None)], "id long, text string")
    entries = spark.createDataFrame([("norcold", 0, None), ("suburban", 1, None), ("pd", 2, ["and"])], "entry string, place int, needs array<string>")
    got = sorted((r.id, r.named) for r in matching.entries_named(texts, entries).collect())
    assert got == [(1, ["norcold", "pd"]), (1, ["norcold", "pd"]), (1, ["suburban"])]


SEARCHED = [(1, "blue ring"), (2, "red ring"), (3, None), (4, ""), (5, "ab blue"), (5, "ab blue")]


@pytest.mark.parametrize("travel", [200_000, 0])
def test_searches_of_equal_terms_are_one(spark, monkeypatch, travel):
    """Rows are those of trying each search on each text, whether sets of terms travel or are shuffled; result rows are not shuffled where they travel."""
    monkeypatch.setattr(matching, "TRAVEL", travel)
    needles = [None, " ", "ring blue", " BLUE  ring", "ab", "b a", "ab blue", "nowhere", "zz", "blue zz"] * 3
    texts = spark.createDataFrame(SEARCHED, "id long, text string")
    made = matching.searched(texts, spark.createDataFrame(list(enumerate(needles)), "search_id long, needle string"))
    want = sorted((n, i) for n, s in enumerate(needles) for i, t in SEARCHED if all(w in (t or "") for w in (s or "").lower().split()))
    assert sorted((r.search_id, r.id) for r in made.collect()) == want
    if travel:
        assert "Exchange hashpartitioning(id" not in plan_of(made) and "SortMergeJoin" not in plan_of(made)


@pytest.mark.parametrize("travel", [200_000, 0])
def test_needles_do_not_gather_the_texts_of_a_gram(spark, monkeypatch, travel):
    monkeypatch.setattr(matching, "TRAVEL", travel)
    texts = spark.createDataFrame([(i, f"open {i} done") for i in range(200)], "id long, text string")
    made = matching.matches(texts, spark.createDataFrame([("open",), ("done",), ("7 d",), ("7",)], "needle string"))
    assert sorted((r.id, r.needle) for r in made.collect()) == sorted((i, n) for i in range(200) for n in ("open", "done", "7 d", "7") if n in f"open {i} done")
    assert not travel or "hashpartitioning(gram#" not in plan_of(made)


@pytest.mark.parametrize("best", [None, 2])
def test_chunks_are_scored_as_pairs_are(spark, best):
    """A chunk at a time gives what the expression of a pair gives: terms in parts of words, odd and short terms, repeats, brands."""
    hays = [(i, c, t, b) for i, (c, t, b) in enumerate([(1, "aabab abab", ["x"]), (1, "é-1 ababab ab", []), (None, "", []), (2, "zz 12v abab " * 9, ["y"]), (1, "nothing", ["x", "y"])])]
    chunks = spark.createDataFrame([(f"c{i}", i, c, 1, t, t[:5], i == 3, b, i) for i, c, t, b in hays], "id string, document_id long, category_id long, page int, hay string, title_kw string, is_index boolean, brands array<string>, signals int")
    asked = [(1, [1], ["abab", "ab", "é-1"], "", []), (2, None, ["aba", "v"], "12v", []), (3, None, [], "12v", ["y"]), (4, [1, 2], ["zz"], "ab ab", ["x"]), (5, [7], ["ab"], "", [])]
    questions = spark.createDataFrame(asked, "query_id long, cat_ids array<long>, terms array<string>, model string, asked array<string>")
    got = retrieve.score_candidates(questions, chunks, best)
    want = retrieve.candidates(questions, chunks).select("query_id", "id", "document_id", "page", "is_index", retrieve.chunk_score().alias("score"))
    if best:
        got, want = (retrieve.seed_topk(df, best) for df in (retrieve.score_candidates(questions, chunks, 8), want))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_needles_are_found_as_str_count_finds_them():
    """Words of all lengths in many texts: overlaps, common beginnings, ends of texts, bytes beyond ASCII."""
    import pyarrow as pa

    from wrenchlake.operators.scoring import Needles

    rng = random.Random(3)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "abababababab" * 3, "é" * 30] + ["ab\0", ""]
    words = sorted({t[i : i + n] for t in texts[:60] for n in (1, 2, 3, 5, 8, 9, 13, 20) for i in range(0, 20, 7)} - {""} | {"aa", "abab", "ababababa", "éé", "nowhere in it"})
    text, word, times = Needles([w.encode() for w in words]).found(pa.array(["cut", *texts, "off"]).slice(1, len(texts)))
    want = [(i, j, t.count(w)) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t]
    assert list(zip(text.tolist(), word.tolist(), times.tolist(), strict=True)) == want


def test_packs_do_not_travel_with_each_chunk(spark, small):
    """Chunks are dealt out once and their category's packs come before them: neither is joined to the other."""
    assert "Join" not in plan_of(QUERIES["score_candidates"](spark, small))


def test_an_arrival_is_many_files_of_like_size(spark, small):
    """As many files as shuffle partitions, however few values one key has; equal keys lie in one file, and a stream is still several batches."""
    events = queries.job_events(queries.Views(spark, small))
    kept, held = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        streams.run(queries.as_stream(events, "at", "job_id"), lambda batch, n: held.append([(r.f, r.at, r.job_id) for r in batch.select(F.input_file_name().alias("f"), "at", "job_id").collect()]), new_path(spark, "marks")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    rows = [r for batch in held for r in batch]
    sizes = collections.Counter(f for f, *_ in rows)
    assert len(held) == 4 and len(sizes) == 8 and len(rows) == events.count() and max(sizes.values()) < 2 * len(rows) / 8
    assert len({(f, *k) for f, *k in rows}) == len({tuple(k) for _, *k in rows})


def test_new_documents_are_added_to_a_bucket(spark, tmp_path, monkeypatch):
    """Only a bucket that holds a re-indexed document is written anew; one that many writes hold becomes one again."""
    monkeypatch.setattr(chunk_table, "FAN", 4)
    path = f"{tmp_path}/chunks"
    rows = lambda *docs: spark.createDataFrame([(f"{d}-{n}", d, f"text {n}") for d, n in docs], "id string, document_id long, chunk_text string")
    ids = lambda *docs: spark.createDataFrame([(d,) for d in docs], "document_id long")
    held = lambda: chunk_table.current(spark, path).writes()
    written = lambda w: spark.read.parquet(f"{path}/data/w={w}").count()
    for n in range(3):
        chunk_table.write_chunks(spark, rows((n, n)), ids(n), path, buckets=1)
    assert held() == [1, 2, 3] and written(3) == 1
    chunk_table.write_chunks(spark, rows((1, 9), (8, 9)), ids(1, 8), path, buckets=1)
    assert held() == [4] and written(4) == 4
    for n in range(chunk_table.FAN):
        chunk_table.write_chunks(spark, rows((20 + n, n)), ids(20 + n), path, buckets=1)
        assert len(held()) <= chunk_table.FAN
    assert {r.id for r in chunk_table.read_chunks(spark, path).collect()} == {"0-0", "1-9", "2-2", "8-9"} | {f"{20 + n}-{n}" for n in range(chunk_table.FAN)}


def test_what_is_chosen_brings_no_texts_into_shuffles(spark, small):
    """Chosen pages and ranked chunks are of known, small size: they travel to the chunks, whose texts stay where they are."""
    r = queries.RetrievalViews(queries.Views(spark, small))
    ranking = r.best()
    assert "Exchange" not in plan_of(ranking)
    assert "Exchange" not in plan_of(evidence.hits(ranking, r.c, r.v.library))
    more = plan_of(retrieve.expand_pages(r.q, r.c, retrieve.seed_topk(r.scored()), queries.WORDS))
    assert "BroadcastHashJoin" in more and not re.search("Exchange (hash|range|round)", more)


def test_pages_carry_their_documents_facts(spark, small):
    """Chunks are made where their document is read: no text is shuffled or sorted to meet the library's facts."""
    v = queries.Views(spark, small)
    v._made["documents"] = spark.read.parquet(f"{small}/documents.parquet")
    plan = plan_of(retrieve.chunk_features(v.chunks, queries.WORDS))
    assert not re.search("Exchange|Join|Sort", plan) and "split_part(text" not in plan.replace("split_part(substring_index(text", "")
    old = with_document(v.page_chunks, v.library)
    assert v.chunks.schema.names == old.schema.names and v.chunks.exceptAll(old).isEmpty() and old.exceptAll(v.chunks).isEmpty() and not old.isEmpty()


@pytest.mark.parametrize("again", [False, True])
def test_chunks_of_odd_documents(spark, small, again):
    """Null ids and texts, blank pages, long ones, and an id that occurs twice, whose chunks meet the facts of each of its rows."""
    odd = [(1, "title one\nbody " + "word " * 400, "en", "src3", 9), (5, "\u3000\n \t\nthird é " + "é" * 899 + "\n", None, "src4", 9), (None, "no id\nat all", "en", "src3", 9), (97, None, "fr", "src4", 9), (13, "", "fr", "src4", 9)]
    odd += [(5, "five again\nchart", "de", "src1", 9)] * again
    v = queries.Views(spark, small)
    v._made["documents"] = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    want = with_document(v.page_chunks, v.library)
    assert v.one_row_a_document() is not again
    assert sorted(map(str, v.chunks.collect())) == sorted(map(str, want.collect())) and want.count() > 4


def test_page_references_are_counted_only_where_a_text_says_page(spark):
    """As a branch, which Spark does not compute beforehand for each text."""
    texts = ["symptom and cause " * 6, "symptom cause page 1 page 2 " * 4, "no gas page 1 page 2 page 3 page 4 " * 4, "section & page", "SECTION & PAGE " * 8, None, ""]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(T.is_index_chart(F.col("t")).alias("i"))
    assert [r.i for r in made.collect()] == [False, True, True, False, True, False, False]
    assert re.search(r"Project \[CASE WHEN Contains\(lower\(coalesce\(t#\d+, \)\), page\) THEN", plan_of(made))


def test_a_file_for_each_core_is_not_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(cores * 10).repartition(cores).write.parquet(f"{tmp_path}/many")
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert "Exchange" not in plan_of(spread(spark.read.parquet(f"{tmp_path}/many"))) and "Exchange" in plan_of(spread(spark.read.parquet(f"{tmp_path}/one")))


def test_texts_are_lower_cased_once(spark):
    rows = spark.createDataFrame([("a", 1, 2, "ÉTÉ", 1, "Symptom CAUSE page 1 Page 02 " * 4 + "ΣΑΣ", None), ("b", 1, None, None, 1, None, "LANG-EN")], "id string, document_id long, category_id long, title string, page int, chunk_text string, keywords string")
    made = retrieve.chunk_features(rows, queries.WORDS)
    assert plan_of(made).count("lower(coalesce(chunk_text") <= 1
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "keywords", "chunk_text")]))
    assert made.where(F.col("hay") != whole).isEmpty() and [(x.id, x.is_index, x.brands) for x in made.orderBy("id").collect()] == [("a", True, []), ("b", False, ["lang-en"])]


def test_scopes_are_counted_without_pairs_of_chunks(spark):
    """Counts and first ids are those of the pairs, null categories, brands and questions without either included; only kinds of chunks are paired."""
    kinds = [(1, []), (1, ["x"]), (2, ["x", "y"]), (None, ["y"]), (None, []), (3, ["z"])]
    chunks = spark.createDataFrame([(f"{i:03d}", *kinds[i % 6 if i % 5 else 0]) for i in range(120)], "id string, category_id long, brands array<string>")
    asked = [(1, [1], []), (2, None, []), (3, None, ["y", "x"]), (4, [2, 1], ["x"]), (5, [9], []), (6, [1, 3], ["y"])]
    questions = spark.createDataFrame(asked, "query_id long, cat_ids array<long>, asked array<string>")
    for pairs, by in ((retrieve.in_scope, ("category_id",)), (retrieve.candidates, ("category_id", "brands"))):
        want = pairs(questions, chunks).groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        got = retrieve.scope_sizes(questions, chunks, pairs, by)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["category_scope", "brand_lock"])
def test_no_pair_of_a_question_and_a_chunk_is_made(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan and "chunk_text" not in plan


def test_notes_of_one_file_are_looked_through_by_all_cores(spark, small):
    """The rows of a small file are dealt out before they are matched, and none are gathered by what they hold."""
    made = QUERIES["open_by_markers"](spark, small)
    plan = plan_of(made)
    assert "RoundRobinPartitioning" in plan and "hashpartitioning(gram" not in plan and made.count() == spark.read.parquet(f"{small}/part.parquet").count()
