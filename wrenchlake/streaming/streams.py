"""The incremental writes as streams; each equals its batch form over all input.

Chats and jobs are kept as partial results that can be added up: a micro-batch appends what its own rows come to, a row for each
key in it, to a table merged in tiers (``sources.tiers``), and a reader adds up the few partial rows of each key.  So a batch
writes its own keys only, neither a job's log nor the table again, and a batch that is run again after a failure finds its folder
complete or writes it anew.

Chats are kept for a time (``retention``, in the unit of ``at``, seconds for timestamps) after their last turn.  The latest turn
seen is the watermark; a chat falls silent for longer than that and is gone, for readers at once and from the table when its
tier is merged, and a turn that comes later begins it anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import chat_title, text
from ..operators.chunks import chunk_pages, with_document
from ..operators.jobs import step_log
from ..sources.chunk_table import write_chunks
from ..sources.tiers import append, read_all

#: 30 days in seconds.
RETENTION = 30 * 24 * 3600


def run(rows: DataFrame, each, checkpoint: str) -> StreamingQuery:
    """Runs ``each(batch, number)`` over what has arrived."""
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- chats

CHAT_PARTS = {"first": F.min, "said": F.min, "category": F.max, "model": F.max, "since": F.min, "until": F.max, "messages": F.sum}


def chat_parts(turns: DataFrame) -> DataFrame:
    """What turns come to, by chat: (chat_id, first, said, category, model, since, until, messages), which add up."""
    last = lambda c: F.max(F.when(text(c) != "", F.struct("id", F.col(c).alias("v"))))
    said = F.min(F.when(F.col("role") == "user", F.struct("id", text("content").alias("v"))))
    return turns.groupBy("chat_id").agg(F.min(F.struct("id", F.col("user_id").alias("v"))).alias("first"), said.alias("said"), last("category_name").alias("category"), last("model_text").alias("model"), F.min("at").alias("since"), F.max("at").alias("until"), F.count("*").alias("messages"))


def added_up(parts: DataFrame, retention: int | None) -> DataFrame:
    """One part for each chat.  With a retention, parts from before a silence of more than that count no longer, and neither do
    chats whose last turn lies further back than that from the latest turn of all."""
    if retention is not None:
        whole = lambda c: F.col(c).cast("long")
        of_chat = Window.partitionBy("chat_id").orderBy("since", "until")
        before = F.max(whole("until")).over(of_chat.rowsBetween(Window.unboundedPreceding, -1))
        breaks = F.when(whole("since") - before > retention, whole("since"))
        parts = parts.withColumn("_last", F.max(breaks).over(of_chat.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        parts = parts.where(F.col("_last").isNull() | (whole("since") >= F.col("_last"))).drop("_last")
    one = parts.groupBy("chat_id").agg(*[f(c).alias(c) for c, f in CHAT_PARTS.items()])
    if retention is not None:
        watermark = parts.agg(F.max(F.col("until").cast("long"))).scalar()
        one = one.where(F.col("until").isNull() | (F.col("until").cast("long") >= watermark - retention))
    return one


def stream_chat_state(turns: DataFrame, root: str, retention: int | None = None) -> StreamingQuery:
    """Turns (as ``operators.jobs.chat_state`` takes them) into the table of chats that ``read_chats`` reads."""
    each = lambda batch, number: append(chat_parts(batch), f"{root}/chats", number, lambda parts: added_up(parts, retention))
    return run(turns, each, f"{root}/checkpoint")


def read_chats(spark: SparkSession, root: str, retention: int | None = None) -> DataFrame:
    """The chats as ``operators.jobs.chat_state`` gives them, without those that have expired."""
    one = added_up(read_all(spark, f"{root}/chats"), retention)
    return one.select(
        "chat_id", F.col("first.v").alias("user_id"), text(F.col("category.v")).alias("category_name"), text(F.col("model.v")).alias("model_text"),
        F.col("until").alias("updated_date"), "messages", chat_title(F.col("said.v")).alias("title"),
    )


# ---- jobs

JOB_PARTS = {"findings": F.max, "status": F.max, "updated_date": F.max}


def last_of(c: str) -> Column:
    return F.max(F.when(F.col(c).isNotNull(), F.struct("at", "id", F.col(c).alias("v")))).alias(c)


def stream_job_progress(events: DataFrame, root: str) -> StreamingQuery:
    """Step events into a log of steps, which is only ever added to, and a small row of a job's latest values."""

    def each(batch: DataFrame, number: int) -> None:
        append(batch.where("test IS NOT NULL").select("job_id", "at", "id", "test", "result", "notes"), f"{root}/steps", number)
        latest = batch.groupBy("job_id").agg(last_of("findings"), last_of("status"), F.max("at").alias("updated_date"))
        append(latest, f"{root}/jobs", number, jobs_added_up)

    return run(events, each, f"{root}/checkpoint")


def jobs_added_up(parts: DataFrame) -> DataFrame:
    return parts.groupBy("job_id").agg(*[f(c).alias(c) for c, f in JOB_PARTS.items()])


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """The jobs as ``operators.jobs.job_progress`` gives them: the log is put together here, for those who read it."""
    steps = read_all(spark, f"{root}/steps").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "test", "result", "notes"))).alias("_steps"))
    jobs = jobs_added_up(read_all(spark, f"{root}/jobs")).join(steps, "job_id", "left")
    held = F.coalesce("_steps", F.array().cast(steps.schema["_steps"].dataType))
    return jobs.select("job_id", F.size(held).alias("steps"), step_log(held).alias("step_log"), F.col("findings.v").alias("findings"), F.col("status.v").alias("status"), "updated_date")


# ---- chunks


def stream_index(pages: DataFrame, documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Pages (document_id, page, text) become chunks; a micro-batch holds all pages of the documents in it.  Its number goes into
    the table's version, so a micro-batch that is run again after a failure changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        write_chunks(batch.sparkSession, with_document(chunk_pages(batch), documents), batch.select("document_id"), path, batch=number)

    return run(pages, each, checkpoint)
