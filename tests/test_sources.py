import json

import pytest
from pyspark.sql import functions as F

from wrenchlake.operators import catalog, jobs
from wrenchlake.operators.chunks import chunk_pages, with_document
from wrenchlake.plans.queries import turns
from wrenchlake.plans.testviews import Views
from wrenchlake.sources import chunk_table, files, snapshot, steps, tables, tiers
from wrenchlake.streaming import streams


def test_load_and_upgrade(spark, tmp_path):
    old = spark.createDataFrame([(1, 2, "t")], "id long, category_id long, title string")
    old.write.parquet(f"{tmp_path}/d")
    loaded = tables.load_table(spark, "documents", f"{tmp_path}/d")
    assert loaded.schema == tables.schema("documents") and loaded.first().indexed is None
    row = tables.upgrade_schema(old, "documents").first()
    assert row.indexed is False and row.index_note is None


def test_list_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.pdf").write_bytes(b"x")
    assert files.files_under(spark, str(tmp_path)).count() == 1
    keys = spark.createDataFrame([("documents/b",), ("documents/",), ("",), ("other",), ("documents/a",)], "key string")
    assert [r.key for r in files.list_files(keys, "documents/", 2).collect()] == ["documents/a", "documents/b"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshot.publish_snapshot(spark.range(9), path) is None
    for n in (10, 11, 12):
        snapshot.publish_snapshot(spark.range(n), path)
    assert snapshot.versions(spark, path) == [2, 3]
    assert snapshot.recover_snapshot(spark.range(3), path).count() == 12
    assert snapshot.recover_snapshot(spark.range(10), path).count() == 10
    assert snapshot.recover_snapshot(spark.range(3), str(tmp_path / "none")).count() == 3


def test_index_sink_replaces_whole_documents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, document_id long, chunk_text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id long")
    chunk_table.write_chunks(spark, rows((1, 1, "a"), (2, 1, "b"), (3, 2, "c")), ids(1, 2), path)
    chunk_table.write_chunks(spark, rows((4, 1, "d")), ids(1), path)
    assert {(r.id, r.chunk_text) for r in chunk_table.read_chunks(spark, path).collect()} == {(3, "c"), (4, "d")}
    empty = spark.createDataFrame([], "id long, document_id long, chunk_text string")
    chunk_table.write_chunks(spark, empty, ids(2), path)
    assert {r.id for r in chunk_table.read_chunks(spark, path).collect()} == {4}
    chunk_table.write_chunks(spark, empty, ids(1), path)
    assert chunk_table.read_chunks(spark, path).count() == 0
    chunk_table.write_chunks(spark, rows((5, 9, "e")), ids(9), path)
    assert {r.id for r in chunk_table.read_chunks(spark, path).collect()} == {5}


def test_readers_never_see_half_a_write(spark, tmp_path, monkeypatch):
    """While a write is under way, after it has failed, and before it is run again, readers see the version before."""
    path = str(tmp_path / "chunks")
    made = lambda *x: spark.createDataFrame([(i, d, t) for i, d, t in x], "id long, document_id long, chunk_text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id long")
    seen = lambda: {(r.id, r.chunk_text) for r in chunk_table.read_chunks(spark, path).collect()}
    first = [(i, i % 7, f"old {i}") for i in range(70)]
    chunk_table.write_chunks(spark, made(*first), ids(*range(7)), path, buckets=4, batch=0)
    old, begun = seen(), chunk_table.read_chunks(spark, path)
    during = []
    publish = chunk_table.publish

    def broken(*args):
        during.append(seen())
        raise OSError("lost the driver")

    monkeypatch.setattr(chunk_table, "publish", broken)
    again = made((500, 3, "new"), (501, 4, "new"))
    with pytest.raises(OSError, match="lost"):
        chunk_table.write_chunks(spark, again, ids(3, 4, 5), path, batch=1)
    assert during == [old] and seen() == old
    monkeypatch.setattr(chunk_table, "publish", publish)
    assert chunk_table.write_chunks(spark, again, ids(3, 4, 5), path, batch=1)
    want = {(i, t) for i, d, t in first if d not in (3, 4, 5)} | {(500, "new"), (501, "new")}
    assert seen() == want
    assert {(r.id, r.chunk_text) for r in begun.collect()} == old  # a reader that began before the write
    assert not chunk_table.write_chunks(spark, made((9, 9, "twice")), ids(9, 0), path, batch=1)  # the batch is in already
    assert seen() == want
    for n in range(4):
        chunk_table.write_chunks(spark, made((600 + n, n, "x")), ids(n), path, batch=2 + n)
    assert len(snapshot.versions(spark, f"{path}/versions")) == 2 and len(chunk_table.Folder(spark, f"{path}/data").names()) <= 5
    assert {i for i, _ in seen()} == {600, 601, 602, 603, 501} | {i for i, d, _ in first if d == 6}


def test_chunk_table_grows_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunk_table, "ROWS_PER_BUCKET", 100)
    monkeypatch.setattr(chunk_table, "ROWS_PER_FILE", 30)
    path = str(tmp_path / "chunks")
    made = lambda lo, hi: spark.range(lo, hi).select(F.col("id"), (F.col("id") / 5).cast("long").alias("document_id"), F.lit("t").alias("chunk_text"))
    ids = lambda df: df.select("document_id").distinct()
    chunk_table.write_chunks(spark, made(0, 150), ids(made(0, 150)), path)
    assert chunk_table.generations(spark, path) == [2]
    for lo in (100, 400, 900):
        chunk_table.write_chunks(spark, made(lo, lo + 600), ids(made(lo, lo + 600)), path)
    assert chunk_table.generations(spark, path) == [16] or chunk_table.generations(spark, path) == [8]
    out = chunk_table.read_chunks(spark, path)
    assert sorted(r.id for r in out.select("id").collect()) == list(range(1500))
    assert max(len(list(b.glob("*.parquet"))) for b in (tmp_path / "chunks" / "data").glob("w=*/bucket=*")) > 1


def test_stored_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://head:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        steps.shared_folder(Session())


def test_catalog_file_keeps_nulls(spark, tmp_path, small):
    v = Views(spark, small)
    export = catalog.catalog_export(v.library.withColumn("keywords", F.lit(None).cast("string")), v.categories)
    catalog.write_catalog(export, str(tmp_path / "c"), "2024-01-01T00:00:00")
    line = next(x for f in (tmp_path / "c").glob("*.json") for x in f.read_text().splitlines())
    assert json.loads(line)["keywords"] is None and json.loads(line)["exported_at"]


def as_stream(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_equal_batch(spark, tmp_path, small):
    v = Views(spark, small)
    said = turns(v)
    streams.stream_chat_state(as_stream(spark, said, f"{tmp_path}/in"), f"{tmp_path}/out").awaitTermination()
    order = ["chat_id", "user_id", "category_name", "model_text", "updated_date", "messages", "title"]
    got = streams.read_chats(spark, f"{tmp_path}/out").select(order)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.chat_state(said).select(order).collect()))


def test_job_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, 1, "a", "Pass", "", None, "in_progress"), (1, 2, 2, "b", "Fail", "n", "f", "complete"), (2, 3, 1, None, None, None, None, "in_progress")], "job_id long, id long, at long, test string, result string, notes string, findings string, status string")
    streams.stream_job_progress(as_stream(spark, events, f"{tmp_path}/in"), f"{tmp_path}/out").awaitTermination()
    want = jobs.job_progress(events)
    got = sorted(map(tuple, streams.read_jobs(spark, f"{tmp_path}/out").select(want.columns).collect()))
    assert got == sorted(map(tuple, want.collect())) and got[0][1] == 2


TURN = "chat_id long, id long, user_id long, role string, content string, category_name string, model_text string, at long"


def fed(spark, parts, schema, source, stream):
    """Runs a stream after each arrival."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream(spark.readStream.schema(schema).parquet(source)).awaitTermination()


def test_partial_tables_are_merged_in_tiers(spark, tmp_path, monkeypatch):
    """Tiers stay short, nothing counts twice while a merge is under way or a batch is run again, and results are the batch form's."""
    monkeypatch.setattr(tiers, "FAN", 3)
    turn = lambda chat, i: (chat, i, 7, "user", f"said {i}", "", None, i)
    parts = [[turn(c, 1) for c in range(50)]] + [[turn(n, n + 2)] for n in range(10)]
    root = f"{tmp_path}/out"
    fed(spark, parts, TURN, f"{tmp_path}/in", lambda rows: streams.stream_chat_state(rows, root))
    want = jobs.chat_state(spark.createDataFrame([r for part in parts for r in part], TURN))
    now = lambda: sorted(map(tuple, streams.read_chats(spark, root).select(want.columns).collect()))
    assert now() == sorted(map(tuple, want.collect()))
    assert tiers.live(spark, f"{root}/chats") == [(2, 8), (0, 9), (0, 10)]
    again = streams.chat_parts(spark.createDataFrame(parts[10], TURN))
    tiers.append(again, f"{root}/chats", 10)  # run again
    again.write.parquet(f"{root}/chats/tier=0/v=7")  # what a merge that failed half-way has not dropped yet
    assert now() == sorted(map(tuple, want.collect()))


def test_expired_chats_leave_the_stream(spark, tmp_path, monkeypatch):
    """The stream's chats are those that the batch purge keeps, its table shrinks, and a chat that speaks again begins anew."""
    monkeypatch.setattr(tiers, "FAN", 2)
    day = 24 * 3600
    turn = lambda chat, i, at: (chat, i, 7, "user", f"said {i}", "", None, at)
    parts = [[turn(c, 1, d * day + c) for c in range(20 * d, 20 * d + 20)] for d in range(3)]
    parts += [[turn(900, d, d * day)] for d in range(20, 34)] + [[turn(0, 99, 34 * day)]]
    root = f"{tmp_path}/out"
    counts = []
    for part in parts:
        fed(spark, [part], TURN, f"{tmp_path}/in", lambda rows: streams.stream_chat_state(rows, root, streams.RETENTION))
        counts.append(tiers.read_all(spark, f"{root}/chats").count())
    every = spark.createDataFrame([r for part in parts for r in part], TURN)
    chats = jobs.chat_state(every).withColumnRenamed("chat_id", "id")
    kept = jobs.purge_expired_chats(chats, every, F.lit(34 * day - streams.RETENTION))[0]
    got = {r.chat_id: r for r in streams.read_chats(spark, root, streams.RETENTION).collect()}
    assert set(got) == {r.id for r in kept.collect()} == {0, 900}
    assert got[0].messages == 1 and got[0].title == "said 99"
    assert max(counts) >= 60 and counts[-1] <= 25
    stamped = every.withColumn("at", F.timestamp_seconds("at"))
    parts = streams.added_up(streams.chat_parts(stamped), streams.RETENTION)
    assert {r.chat_id for r in parts.collect()} == {0, 900}


def test_an_event_writes_no_more_as_the_log_grows(spark, tmp_path):
    schema = "job_id long, id long, at long, test string, result string, notes string, findings string, status string"
    event = lambda i: (1, i, i, f"test {i}", "Pass", "x" * 50, None, "in_progress")
    root = f"{tmp_path}/out"
    sizes = []
    for part in ([event(0)], [event(i) for i in range(1, 3000)], [event(3001)], [event(3002)]):
        fed(spark, [part], schema, f"{tmp_path}/in", lambda rows: streams.stream_job_progress(rows, root))
        newest = max(v for _, v in tiers.live(spark, f"{root}/steps"))
        sizes.append(sum(f.stat().st_size for t in ("steps", "jobs") for f in (tmp_path / "out" / t).rglob(f"v={newest}/*.parquet")))
    assert sizes[3] <= 1.2 * sizes[0] and sizes[2] <= 1.2 * sizes[0] < sizes[1]
    row = streams.read_jobs(spark, root).first()
    assert row.steps == 3002 and row.updated_date == 3002


def test_index_stream_equals_batch(spark, tmp_path, small):
    v = Views(spark, small)
    pages = v.lib_pages.repartition(3, "document_id")
    pages.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.stream_index(stream, v.library, f"{tmp_path}/chunks", f"{tmp_path}/cp").awaitTermination()
    want = with_document(chunk_pages(v.lib_pages), v.library)
    got = chunk_table.read_chunks(spark, f"{tmp_path}/chunks").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
