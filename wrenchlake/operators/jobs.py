"""Jobs and chats: who sees what, the latest and the recent, conversation state, stories, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.text import bound, chat_title, is_open_status, strip, text

# The texts of labels, notes and stories below are fixed values: results must hold them word for word.
STEP = "array<struct<test:string,result:string,notes:string,at:string>>"
SOURCE = "array<struct<document_id:bigint,title:string,page:int,file_path:string,file_type:string,excerpt:string>>"


def with_owner(rows: DataFrame, users: DataFrame, unknown: str = "Unknown") -> DataFrame:
    names = users.select(F.col("id").alias("user_id"), F.col("full_name").alias("owner"))
    return rows.join(names, "user_id", "left").withColumn("owner", F.coalesce("owner", F.lit(unknown)))


def visibility(viewers: DataFrame) -> DataFrame:
    """(viewer_id, sees_all, class_user): the class of rows that each viewer sees.  Managers share one class, that of all rows;
    everyone else sees the class of their own rows.  One row a viewer, so what all managers see is held once."""
    everything = F.col("role").eqNullSafe(F.lit("Manager"))
    return viewers.select(F.col("id").alias("viewer_id"), everything.alias("sees_all"), F.when(~everything, F.col("id")).alias("class_user"))


def class_rows(rows: DataFrame) -> DataFrame:
    """Each row under its classes: that of all rows (class_user null) and that of its owner."""
    return rows.withColumn("sees_all", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("class_user", F.when(~F.col("sees_all"), F.col("user_id"))).where("sees_all OR class_user IS NOT NULL")


def per_class(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates over the rows of each class: (sees_all, class_user, ...)."""
    every = rows.agg(*aggregates).select(F.lit(True).alias("sees_all"), F.lit(None).cast(rows.schema["user_id"].dataType).alias("class_user"), "*")
    own = rows.where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("class_user")).agg(*aggregates).withColumn("sees_all", F.lit(False))
    return every.unionByName(own)


def seen_by(viewers: DataFrame, classes: DataFrame) -> DataFrame:
    """What ``classes`` (a result by class) holds for each viewer."""
    who = visibility(viewers).alias("w")
    same = F.col("w.sees_all").eqNullSafe(F.col("c.sees_all")) & F.col("w.class_user").eqNullSafe(F.col("c.class_user"))
    return who.join(classes.alias("c"), same).select("w.viewer_id", *[f"c.{c}" for c in classes.columns if c not in ("sees_all", "class_user")])


def visible_to(viewers: DataFrame, rows: DataFrame) -> DataFrame:
    """viewer_id with each row that the viewer may see: the classes expanded, for those who ask for the rows themselves.

    The result holds all rows for each manager, so ask for the viewers that are needed; reports work on ``per_class``."""
    return seen_by(viewers, class_rows(rows)).select("viewer_id", *rows.columns)


def latest_job_per_wo(jobs: DataFrame) -> DataFrame:
    """The newest job of each work order; ties go to the larger id."""
    newest = Window.partitionBy("wo_number").orderBy(F.desc("updated_date"), F.desc("id"))
    return jobs.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def latest_job_per_wo_and_class(jobs: DataFrame) -> DataFrame:
    """The newest job of each work order among all jobs, and among each user's own: what a manager and what the user sees."""
    newest = Window.partitionBy("sees_all", "class_user", "wo_number").orderBy(F.desc("updated_date"), F.desc("id"))
    return class_rows(jobs).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def recent(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("updated_date"), F.desc("id")).limit(n)


def recent_per_user(rows: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("updated_date"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def open_jobs(users: DataFrame, jobs: DataFrame) -> DataFrame:
    n = jobs.groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("status") == "in_progress").alias("n"))
    return users.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("open_jobs"))


def open_wo_conflicts(jobs: DataFrame) -> DataFrame:
    """Work orders for which a user has more than one open job."""
    return jobs.where("status = 'in_progress'").groupBy("wo_number", "user_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def blocked_candidates(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs whose user already has the work order open."""
    taken = jobs.where("status = 'in_progress'").select("wo_number", "user_id").distinct()
    return candidates.withColumn("wo_number", strip(F.col("wo_number"))).join(taken, ["wo_number", "user_id"], "left_semi")


def job_label(manager: bool = False) -> Column:
    at = F.coalesce(F.date_format(F.coalesce("updated_date", "created_date"), "yyyy-MM-dd HH:mm"), F.lit(""))
    category = F.coalesce(F.nullif("category_name", F.lit("")), F.lit("—"))
    owner = F.col("owner") if manager else F.lit(None).cast("string")
    return F.concat_ws(" · ", F.concat(F.lit("WO "), "wo_number"), "status", category, at, owner)


def chat_label() -> Column:
    at = F.coalesce(F.date_format(F.coalesce("updated_date", "created_date"), "MMM dd hh:mm a"), F.lit(""))
    return F.concat_ws(" · ", F.left(text("title"), F.lit(60)), F.coalesce(F.nullif("category_name", F.lit("")), F.lit("any")), at)


def source_label() -> Column:
    """A source as plans list it: its title and page."""
    page = F.coalesce(F.nullif("page", F.lit(0)).cast("string"), F.lit("?"))
    return F.concat(F.left(F.coalesce(F.nullif("title", F.lit("")), F.lit("Manual")), F.lit(60)), F.lit(" — p."), page)


def team_line() -> Column:
    """A job as the team page lists it; rows come from ``with_owner`` with "?" for unknown users."""
    parts = [F.concat(F.lit("**WO "), "wo_number", F.lit("**")), F.col("status"), F.col("owner"), F.coalesce("category_name", F.lit("None")), F.left(text("concern"), F.lit(80))]
    return F.concat_ws(" · ", *parts)


def said_by_user(messages: DataFrame) -> DataFrame:
    """(chat_id, said): all that a chat's user has said, once for each chat."""
    return messages.where("role = 'user'").groupBy("chat_id").agg(ordered_join("id", text("content"), " ").alias("said"))


def turn_ends(messages: DataFrame) -> DataFrame:
    """(chat_id, id, end): up to which character of ``said_by_user`` the chat had come with each user turn.  A running sum, so a
    long chat costs a number for each turn, not its text."""
    so_far = Window.partitionBy("chat_id").orderBy("id", text("content")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.where("role = 'user'").select("chat_id", "id", (F.sum(F.length(text("content")) + 1).over(so_far) - 1).cast("int").alias("end"))


def search_text_per_turn(messages: DataFrame) -> DataFrame:
    """For each user turn: the chat's earlier user messages and this one, cut from the chat's text for those who ask for it."""
    rows = turn_ends(messages).join(said_by_user(messages), "chat_id")
    return rows.select("chat_id", "id", strip(F.left("said", F.col("end"))).alias("search_text"))


def first_user_message(messages: DataFrame) -> DataFrame:
    said = F.when((F.col("role") == "user") & (strip(text("content")) != ""), F.struct("id", strip(text("content")).alias("content")))
    return messages.groupBy("chat_id").agg(F.min(said)["content"].alias("concern"))


def coach_head(messages: DataFrame, n: int = 4, length: int = 400) -> DataFrame:
    """The first ``n`` non-empty messages of anyone but the user, cut to ``length``."""
    content = strip(text("content"))
    at = Window.partitionBy("chat_id").orderBy("id")
    head = messages.where((F.col("role") != "user") & (content != "")).withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= n)
    return head.select("chat_id", F.col("_n").alias("n"), F.left(content, F.lit(length)).alias("content"))


def ordered_join(order: str, value: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def transcript(messages: DataFrame) -> DataFrame:
    content = strip(text("content"))
    line = F.concat(F.when(F.coalesce(F.nullif(strip(text("role")), F.lit("")), F.lit("user")) == "user", "Tech: ").otherwise("Guided Diagnostics: "), content)
    return messages.where(content != "").groupBy("chat_id").agg(ordered_join("id", line, "\n\n").alias("transcript"))


def chat_state(turns: DataFrame) -> DataFrame:
    """Chats folded from turns (chat_id, id, user_id, role, content, category_name, model_text, at): title of the first user
    message, last non-empty category and model, time of the last turn, number of messages."""
    last = lambda c: F.max(F.when(text(c) != "", F.struct("id", c)))[c]
    first = F.min(F.when(F.col("role") == "user", F.struct("id", text("content").alias("content"))))["content"]
    folded = turns.groupBy("chat_id").agg(F.min_by("user_id", "id").alias("user_id"), first.alias("message"), text(last("category_name")).alias("category_name"), text(last("model_text")).alias("model_text"), F.max("at").alias("updated_date"), F.count("*").alias("messages"))
    return folded.withColumn("title", chat_title(F.col("message"))).drop("message")


def step_log(steps: Column) -> Column:
    """Steps in order as the JSON that jobs hold."""
    return F.to_json(F.transform(steps, lambda s: F.struct(s["test"].alias("test"), s["result"].alias("result"), s["notes"].alias("notes"))))


def job_progress(events: DataFrame) -> DataFrame:
    """Jobs folded from step events (job_id, id, at, test, result, notes, findings, status)."""
    steps = F.array_sort(F.collect_list(F.when(F.col("test").isNotNull(), F.struct("at", "id", "test", "result", "notes"))))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", "id", c)))[c]
    return events.groupBy("job_id").agg(F.size(steps).alias("steps"), step_log(steps).alias("step_log"), last("findings").alias("findings"), last("status").alias("status"), F.max("at").alias("updated_date"))


def purge_expired_chats(chats: DataFrame, messages: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Chats not updated since the cutoff go with their messages; chats without a date stay."""
    expired = chats.where(F.col("updated_date") < cutoff).select(F.col("id").alias("chat_id"))
    kept = chats.where(F.col("updated_date").isNull() | (F.col("updated_date") >= cutoff))
    return kept, messages.join(expired, "chat_id", "left_anti").select(*messages.columns)


def _array(json: Column, schema: str) -> Column:
    """A JSON array as ``schema``; anything but an array, or a broken one, is empty."""
    parsed = F.from_json(F.when(F.ltrim(text(json)).startswith("["), json), schema)
    return F.coalesce(parsed, F.array().cast(schema))


def parse_steps(json: Column) -> Column:
    return _array(json, STEP)


def parse_sources(json: Column) -> Column:
    return _array(json, SOURCE)


def step_lines(json: Column) -> Column:
    """The story's step lines: ``- test: result (notes)``."""
    line = lambda s: F.concat(F.lit("- "), text(s["test"]), F.lit(": "), text(s["result"]), F.when(text(s["notes"]) != "", F.concat(F.lit(" ("), s["notes"], F.lit(")"))).otherwise(F.lit("")))
    return F.array_join(F.transform(parse_steps(json), line), "\n")


def screen_steps(json: Column) -> Column:
    """Steps as shown, also from other spellings of their keys."""
    rows = _array(json, "array<map<string,string>>")
    pick = lambda s, *keys: F.coalesce(*[F.nullif(F.try_element_at(s, F.lit(k)), F.lit("")) for k in keys])
    return F.transform(rows, lambda s: F.struct(F.coalesce(pick(s, "test", "step", "what", "action"), F.lit("(unnamed step)")).alias("test"), F.coalesce(pick(s, "result", "outcome"), F.lit("—")).alias("result"), F.coalesce(pick(s, "notes", "note"), F.lit("")).alias("notes")))


def labelled(label: str, value: Column, length: int | None = None) -> Column:
    """label + value, or null for a blank value, so that concat_ws leaves it out."""
    return bound(value, lambda v: F.when(text(v) != "", F.concat(F.lit(label), F.left(v, F.lit(length)) if length else v)))


def job_notes() -> Column:
    """A job's notes from its columns; the plan counts as a suggestion only."""
    plan = "NOT PERFORMED unless also listed above — this was only the suggested test plan, do not copy it into CORRECTION:\n"
    parts = [
        labelled("Model/System: ", F.col("model_text")),
        labelled("Category: ", F.col("category_name")),
        labelled("Technician findings and work performed:\n", F.col("findings")),
        labelled("Diagnostic step log:\n", step_lines(F.col("step_log"))),
        labelled(plan, F.col("plan_text"), 800),
    ]
    return strip(F.concat_ws("\n\n", *parts))


def chat_notes(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """chat_id, concern, tech (what the user reported) and notes of each chat."""
    content = strip(text("content"))
    tech = messages.where((F.col("role") == "user") & (content != "")).groupBy("chat_id").agg(ordered_join("id", content, "\n\n").alias("tech"))
    coach = coach_head(messages).groupBy("chat_id").agg(ordered_join("n", F.col("content"), "\n---\n").alias("coach"))
    rows = chats.withColumnRenamed("id", "chat_id").join(tech, "chat_id", "left").join(coach, "chat_id", "left").join(first_user_message(messages), "chat_id", "left")
    told = F.coalesce("tech", F.lit("(none)"))
    advice = "COACH SUGGESTIONS (recommended only — do NOT treat as performed unless the tech later confirmed the result):\n"
    notes = F.concat_ws("\n\n", labelled("Category: ", F.col("category_name")), labelled("Model/System: ", F.col("model_text")), F.concat(F.lit("TECH REPORTED (only these are performed tests / readings / status):\n"), told), labelled(advice, F.col("coach")))
    return rows.select("chat_id", text("concern").alias("concern"), told.alias("tech"), notes.alias("notes"))


def offline_story(concern: Column, notes: Column, status_text: Column | None = None, lexicon: Lexicon = DEFAULT) -> Column:
    """The deterministic write-up: a handoff while the status wording (the notes', unless other text is given) is open, else a
    closed story."""
    if status_text is None:
        return bound(notes, lambda n: offline_story(concern, n, n, lexicon))
    both = F.struct(strip(text(concern)).alias("concern"), strip(text(notes)).alias("notes"), is_open_status(status_text, lexicon).alias("open"))
    return bound(both, lambda x: story_text(x["concern"], x["notes"], x["open"]))


def story_text(concern: Column, notes: Column, still_open: Column) -> Column:
    """The write-up's text; its wording is fixed."""
    or_ = lambda c, default: F.when(c == "", F.lit(default)).otherwise(c)
    seen = or_(notes, "See technician notes.")
    handoff = F.concat(
        F.lit("**CONCERN**\n"), or_(concern, "Customer reported an issue requiring diagnosis."), F.lit("\n\n**TESTING PERFORMED**\n"), seen,
        F.lit("\n\n**STATUS**\nOpen. No repair completed. Next tech: resume from testing performed. Do not treat recommended checks as done."),
    )
    closed = F.concat(
        F.lit("**CONCERN**\n"), or_(concern, "Customer reported an issue requiring diagnosis and repair."), F.lit("\n\n**TESTING / FINDINGS**\n"), seen,
        F.lit("\n\n**CAUSE**\nOnly as stated in the technician notes. If no root cause was recorded, leave unknown.\n\n"),
        F.lit("**CORRECTION**\nOnly repairs the technician recorded. If none were recorded, none were performed."),
    )
    return F.when(still_open, handoff).otherwise(closed)
