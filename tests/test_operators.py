import datetime as dt

from pyspark.sql import functions as F

from wrenchlake.operators import chunks, compliance, evidence, jobs, retrieve

CHUNK = "id long, document_id long, category_id long, title string, page int, chunk_text string, keywords string"
QUESTION = "query_id long, category_id long, model_text string, symptom string"


def answer(spark, rows, questions, k=14):
    cats = spark.createDataFrame([(1, "Refrigerators"), (9, "TSB / Recall")], "id long, name string")
    c = retrieve.chunk_features(spark.createDataFrame(rows, CHUNK))
    q = retrieve.query_features(spark.createDataFrame(questions, QUESTION), cats)
    got = retrieve.retrieve(q, c, k).orderBy("query_id", "rank").collect()
    return {n: [r.id for r in got if r.query_id == n] for n in {x[0] for x in questions}}


CHART = "Symptom and cause. Section & page\n1. insufficient cooling all modes page 12\n2. freezes page 30" + " " * 80
ROWS = [
    (1, 10, 1, "Norcold N", 1, CHART, "norcold"),
    (2, 10, 1, "Norcold N", 12, "measure the heating element", "norcold"),
    (3, 10, 1, "Norcold N", 30, "defrost", "norcold"),
    (4, 20, 1, "Dometic D", 1, "cooling unit check the burner cooling", "dometic"),
    (5, 30, 9, "Bulletin", 1, "norcold cooling notice", "norcold"),
    (6, 40, 2, "Norcold other", 1, "norcold cooling", "norcold"),
]


def test_brand_lock_and_scope(spark):
    got = answer(spark, ROWS, [(1, 1, "Norcold", "not cooling"), (2, 1, "Furrion", "not cooling"), (3, None, "", "cooling")])
    assert got[2] == []
    assert 4 not in got[1] and 6 not in got[1] and {1, 2, 5} <= set(got[1])
    assert {4, 5, 6} <= set(got[3])


def test_one_chart_and_k(spark):
    rows = [*ROWS, (7, 10, 1, "Norcold N", 2, CHART + "again", "norcold")]
    got = answer(spark, rows, [(1, 1, "Norcold", "not cooling")], 3)[1]
    assert len(got) <= 3 and len({1, 7} & set(got)) <= 1


def test_chart_rows_name_pages(spark):
    q = spark.createDataFrame([(1, "not cooling on gas and electric")], "query_id long, symptom string")
    from wrenchlake.functions import text as T

    rows = q.select("query_id", T.symptom_intents(F.col("symptom")).alias("intents"), T.tokenize(F.col("symptom")).alias("symptom_tokens")).crossJoin(spark.createDataFrame([(1, CHART)], "id long, chunk_text string"))
    assert sorted(retrieve.chart_pages(rows).first().pages) == [6, 7, 9, 10, 12]


def test_fallback_returns_first_chunks_as_they_are(spark):
    rows = [(i, 1, 1, "t", 1, CHART, "") for i in (5, 4, 3)]
    assert answer(spark, rows, [(1, 1, "", "zzz qqq")], 2)[1] == [3, 4]


def test_batch_equals_single(spark):
    questions = [(1, 1, "Norcold", "not cooling"), (2, 1, "", "burner"), (3, None, "", "cooling element")]
    together = answer(spark, ROWS, questions)
    for q in questions:
        assert answer(spark, ROWS, [q])[q[0]] == together[q[0]]


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(answer(spark, ROWS, [(1, 1, "Norcold", "not cooling"), (3, None, "", "cooling")]))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_topk_limits_groups_before_the_shuffle(spark):
    scored = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id"), F.lit(1).alias("score"))
    plan = retrieve.seed_topk(scored, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_progress(spark):
    users = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id long, full_name string, is_active boolean")
    meetings = spark.createDataFrame([(i, f"m{i}") for i in range(16)], "id long, title string")
    acks = spark.createDataFrame([(1, 0, 1, dt.datetime(2024, 1, 1))], "id long, meeting_id long, user_id long, signed_at timestamp_ntz")
    assert [r.progress for r in compliance.safety_progress(users, meetings, acks).orderBy("id").collect()] == [6.2, 0.0]
    assert compliance.safety_progress(users, meetings.limit(0), acks).first().progress == 100.0
    twice = acks.union(acks.withColumn("id", F.lit(2).cast("long")))
    row = compliance.safety_progress(users, meetings.where("id < 2"), twice).orderBy("id").first()
    assert (row.progress, row.progress_distinct) == (100.0, 50.0)
    missing = compliance.missing_acks(users, meetings, acks).count()
    assert missing + acks.select("user_id", "meeting_id").distinct().count() == 2 * 16


def test_purge(spark):
    at = dt.datetime(2024, 1, 31)
    chats = spark.createDataFrame([(1, None), (2, at), (3, at - dt.timedelta(seconds=1))], "id long, updated_date timestamp_ntz")
    messages = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "chat_id long, id long")
    kept, left = jobs.purge_expired_chats(chats, messages, F.lit(at).cast("timestamp_ntz"))
    assert {r.id for r in kept.collect()} == {1, 2} == {r.chat_id for r in left.collect()}


def test_coach_head_counts_system_turns(spark):
    turns = [(1, 0, "system", "s")] + [(1, i, "assistant", f"a{i}") for i in range(1, 6)] + [(1, 9, "user", "u")]
    got = jobs.coach_head(spark.createDataFrame(turns, "chat_id long, id long, role string, content string")).orderBy("n").collect()
    assert [r.content for r in got] == ["s", "a1", "a2", "a3"]


def test_merge_excerpts(spark):
    rows = [(1, r, 5, "t", 2, text, False, "p", "pdf") for r, text in ((1, "a" * 2000), (2, "a" * 10), (3, "b" * 1000))]
    df = spark.createDataFrame(rows, "query_id long, rank int, document_id long, title string, page int, chunk_text string, is_index boolean, file_path string, file_type string")
    got = evidence.merge_excerpts(df).first().excerpt
    # The first chunk is longer than the first cut, so it is added again; what is contained is skipped.
    assert got == ("a" * 1800 + "\n\n" + "a" * 2000)[:2500]


def test_merge_excerpts_adds_what_is_new(spark):
    rows = [(1, r, 5, f"t{r}", 2, text, False, f"p{r}", "pdf") for r, text in ((3, "cc"), (1, "aa bb"), (2, "bb"), (4, "dd"), (5, ""))] + [(1, 6, 5, "t", 3, "bb", False, None, "pdf")]
    df = spark.createDataFrame(rows, "query_id long, rank int, document_id long, title string, page int, chunk_text string, is_index boolean, file_path string, file_type string")
    got = {r.page: r for r in evidence.merge_excerpts(df).collect()}
    assert got[2].excerpt == "aa bb\n\ncc\n\ndd" and (got[2].rank, got[2].title, got[2].file_path) == (1, "t1", "p1")
    assert got[3].excerpt == "bb" and got[3].file_path is None


def test_chunk_ids_are_unique_and_in_order(spark):
    places = [(1, 1, 0), (1, 9_999, 9_999), (1, 10_000, 0), (1, 10_000, 10_000), (1, 10_001, 0), (2, 1, 0), (9_000_000_000_000_000_000, 1, 0)]
    made = spark.createDataFrame([(d, p, n, "t") for d, p, n in places], "document_id long, page int, chunk_no int, chunk_text string")
    facts = spark.createDataFrame([(d, 1, "t", "k") for d in {x[0] for x in places}], "id long, category_id long, title string, keywords string")
    rows = chunks.with_document(made, facts).orderBy("id").collect()
    assert len({r.id for r in rows}) == len(places)
    assert [(r.document_id, r.page) for r in rows] == [x[:2] for x in places]


def test_blank_message_asks_for_one(spark):
    turns = spark.createDataFrame([(1, " \n\t"), (2, None), (3, "x")], "query_id long, message string")
    none = spark.createDataFrame([], "query_id long, rank int, title string, page int, chunk_text string")
    got = {r.query_id: r.reply for r in evidence.offline_chat_reply(turns, none).collect()}
    assert got[1] == got[2] == "Type a symptom or question first." and got[3].startswith("AI is offline")


def test_questions_with_a_brand_need_no_nested_loop(spark):
    cats = spark.createDataFrame([(1, "Refrigerators")], "id long, name string")
    c = retrieve.chunk_features(spark.createDataFrame([(str(i), 1, 1, f"{b} guide", 1, "x", f"{b} {b2}") for i, (b, b2) in enumerate([("norcold", "dometic"), ("dometic", ""), ("", "")])], CHUNK.replace("id long, document", "id string, document", 1)))
    q = retrieve.query_features(spark.createDataFrame([(1, None, "dometic norcold", "warm"), (2, None, "", "warm"), (3, 1, "norcold", "warm")], QUESTION), cats)
    got = sorted((r.query_id, r.id) for r in retrieve.candidates(q, c).select("query_id", "id").collect())
    want = sorted((r.query_id, r.id) for r in retrieve.in_scope(q, c).where(retrieve.brand_lock()).select("query_id", "id").collect())
    assert got == want == [(1, "0"), (1, "1"), (2, "0"), (2, "1"), (2, "2"), (3, "0")]


def test_notes_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "c", "m", "cat", "still open", "[]", "p")], "id long, concern string, model_text string, category_name string, findings string, step_log string, plan_text string")
    story = rows.select(jobs.offline_story(F.col("concern"), jobs.job_notes()).alias("s"))
    assert story.first().s.startswith("**CONCERN**\nc\n\n**TESTING PERFORMED**")
    assert story._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


def test_offline_plan_without_hits_names_the_brand(spark):
    q = spark.createDataFrame([(1, "Furrion", "dead", "Slideouts")], "query_id long, model_text string, symptom string, category_name string")
    none = spark.createDataFrame([], "query_id long, rank int, title string, page int, chunk_text string, is_index boolean")
    assert "Named brand/model: furrion" in evidence.offline_plan(q, none).first().plan


def test_index_report_notes(spark):
    docs = spark.createDataFrame([(1, "PDF"), (2, "pptx"), (3, "pdf")], "id long, file_type string")
    made = spark.createDataFrame([(1, 1), (1, 1), (1, 4)], "document_id long, page int")
    got = {r.id: (r.indexed, r.index_note) for r in chunks.index_document_report(docs, made).collect()}
    assert got == {1: (True, "Indexed 3 chunks from 2 pages"), 2: (False, chunks.NOT_PDF), 3: (False, chunks.NO_TEXT)}


def test_missing_acks_of_odd_ids(spark):
    """Null, negative and repeated meeting ids, orphans, repeated and null acknowledgements, as a plain loop has them."""
    users = [(1, True), (2, True), (3, False), (4, True)]
    meetings = [(0, "a"), (63, "b"), (64, "c"), (-1, "d"), (-64, "e"), (5000, "f"), (64, "again"), (None, "no id")]
    acks = [(1, 0), (1, 0), (1, -1), (1, 777), (2, 64), (2, None), (None, 63), (9, 0), (3, 63)]
    frames = (spark.createDataFrame(users, "id long, is_active boolean"), spark.createDataFrame(meetings, "id long, title string"), spark.createDataFrame(acks, "user_id long, meeting_id long"))
    got = sorted(map(str, compliance.missing_acks(*frames).collect()))
    signed = set(acks)
    want = [f"Row(user_id={u}, meeting_id={m}, title={t!r})" for u, on in users if on for m, t in meetings if m is None or (u, m) not in signed]
    assert got == sorted(want)
    plan = compliance.missing_acks(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = spark.createDataFrame([], "id long, title string")
    assert compliance.missing_acks(frames[0], none, frames[2]).collect() == []


def test_visibility_is_held_by_class(spark):
    """Classes hold each row twice at most, however many managers there are, and expand to what each viewer sees."""
    users = spark.createDataFrame([(i, "Manager" if i % 2 else ["Tech", None][i % 4 // 2]) for i in range(40)], "id long, role string")
    rows = spark.createDataFrame([(n, n % 7 if n % 5 else None) for n in range(60)], "id long, user_id long")
    assert jobs.class_rows(rows).count() == 60 + rows.where("user_id IS NOT NULL").count()
    assert jobs.visibility(users).count() == 40
    got = sorted((r.viewer_id, r.id) for r in jobs.visible_to(users, rows).collect())
    assert got == sorted((u.id, r.id) for u in users.collect() for r in rows.collect() if u.role == "Manager" or r.user_id == u.id)
    counts = jobs.seen_by(users, jobs.per_class(rows, F.count("*").alias("n"))).collect()
    assert {r.viewer_id: r.n for r in counts} == {u: sum(x == u for x, _ in got) for u, _ in got}
