"""Seeds by the word index equal those of a scan of the whole library, for odd questions and chunks too."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import CHUNK, QUESTION
from wrenchlake.operators import retrieve, word_index
from wrenchlake.sources.steps import stored

CHART = "Symptom and cause. Section & page\n1. insufficient cooling all modes page 12\n2. freezes page 30" + " " * 80


@pytest.fixture(scope="module")
def library(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(2, 7))) for _ in range(300)] + ["RM2652", "é-1", "volt", "check ", "inspect", "x.y", "12v"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randint(0, n)))
    rows = [(i, i // 5, r.choice([1, 2, 9, None]), r.choice([None, "", text(3), "norcold"]), i % 5, r.choice([CHART, text(60), text(60), text(5), None, ""]), r.choice([None, text(2), "dometic"])) for i in range(300)]
    return stored(retrieve.chunk_features(spark.createDataFrame(rows, CHUNK).repartition(4)), "features"), words


def asked(spark, words):
    r = random.Random(2)
    symptoms = [None, "", "zzzzzz", "qqq zzz", "ab", "volt", "x.y", *[" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(30)]]
    models = [None, "", " ", "RM2652", "é-1", "12v x.y", "nowhere at all", "ab", "-", *words[:6]]
    rows = [(i, r.choice([None, 0, None, 1, 3]), r.choice(models), s) for i, s in enumerate(symptoms * 3)]
    rows += [(900 + i, None, m, "qqq") for i, m in enumerate(models)] + [(990, None, "norcold", "volt"), (991, 2, None, None)]
    cats = spark.createDataFrame([(1, "Refrigerators"), (9, "TSB / Recall")], "id long, name string")
    return stored(retrieve.query_features(spark.createDataFrame(rows, QUESTION), cats), "questions")


@pytest.mark.parametrize(("k", "most"), [(14, 10**9), (3, 10**9), (40, 10**9), (14, 200), (14, -1)])
def test_index_equals_scan(spark, library, k, most):
    chunks, words = library
    q = asked(spark, words)
    columns = ["query_id", "rank", "id", "document_id", "page", "is_index", "score", "fallback"]
    want = retrieve.seed_topk(retrieve.score_candidates(q, chunks), k).select(columns)
    got = word_index.seeds(q, chunks, word_index.build(chunks), k, most).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_nested_loop_over_chunks(spark, library):
    chunks, words = library
    q = asked(spark, words)
    for df in (retrieve.seed_topk(retrieve.score_candidates(q, chunks)), retrieve.in_scope(q, chunks)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_library_and_no_questions(spark, library):
    chunks, words = library
    index, q = word_index.build(chunks), asked(spark, words)
    assert word_index.seeds(q.limit(0), chunks, index).collect() == []
    assert word_index.seeds(q, chunks.limit(0), word_index.build(chunks.limit(0))).where(F.col("query_id") >= 0).collect() == []
