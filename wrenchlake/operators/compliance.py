"""Certificates, safety meetings and who has acknowledged them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_users(users: DataFrame) -> DataFrame:
    return users.where("is_active").orderBy("full_name", "id")


def cert_counts(users: DataFrame, certificates: DataFrame) -> DataFrame:
    """Certificates of each user, 0 for none."""
    n = certificates.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return users.select("id", "full_name").join(n, "id", "left").select("id", "full_name", F.coalesce("n", F.lit(0)).alias("certificates"))


def safety_progress(users: DataFrame, meetings: DataFrame, acks: DataFrame) -> DataFrame:
    """progress: acknowledgement rows for 100 meetings, so repeated rows count; progress_distinct: existing meetings only."""
    total = meetings.agg(F.count("*").alias("meetings"))
    rows = acks.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("signed"))
    real = acks.join(meetings.select(F.col("id").alias("meeting_id")), "meeting_id", "left_semi").groupBy(F.col("user_id").alias("id")).agg(F.countDistinct("meeting_id").alias("met"))
    share = lambda c: F.when(F.col("meetings") == 0, 100.0).otherwise(F.bround(100.0 * F.coalesce(c, F.lit(0)) / F.nullif("meetings", F.lit(0)), 1))
    return users.select("id").join(rows, "id", "left").join(real, "id", "left").crossJoin(F.broadcast(total)).select("id", share("signed").alias("progress"), share("met").alias("progress_distinct"))


def bits(ids: Column) -> Column:
    """Aggregate of the ids of one word (``word_of``) as a mask of 64 bits: bit id mod 64 is set."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(ids, F.lit(64)).cast("int")))


def word_of(ids: Column) -> Column:
    return F.shiftright(ids.cast("long"), 6)


def ids_of(word: Column, mask: Column) -> Column:
    """The ids whose bits are set in a mask of 64."""
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("bit_get", mask, b) == 1)
    return F.transform(held, lambda b: word * 64 + b)


def signed_words(acks: DataFrame) -> DataFrame:
    """(user_id, signed): a map from word to the mask of the meetings that a user has signed.  Repeats fall together on the map
    side, and a user's row is an eighth of a byte for each meeting."""
    words = acks.where("user_id IS NOT NULL AND meeting_id IS NOT NULL").groupBy("user_id", word_of(F.col("meeting_id")).alias("word")).agg(bits(F.col("meeting_id")).alias("mask"))
    return words.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("signed"))


def missing_acks(users: DataFrame, meetings: DataFrame, acks: DataFrame) -> DataFrame:
    """(user_id, meeting_id, title) of each active user's meetings without an acknowledgement.

    What a user has signed is taken from the bits of all meetings, and only the bits that are left become rows; users are never
    paired with meetings.  A meeting without an id cannot be signed, so each user misses it; acknowledgements of unknown
    meetings or users count for nothing."""
    held = meetings.where("id IS NOT NULL").groupBy(word_of(F.col("id")).alias("word")).agg(bits(F.col("id")).alias("mask"))
    every = held.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("words")).scalar()
    rows = users.where("is_active").select(F.col("id").alias("user_id")).join(signed_words(acks), "user_id", "left").withColumn("every", every)
    left = F.transform("every", lambda e: F.struct(e["word"].alias("word"), e["mask"].bitwiseAND(F.bitwise_not(F.coalesce(F.try_element_at("signed", e["word"]), F.lit(0).cast("long")))).alias("mask")))
    rows = rows.select("user_id", F.explode(F.filter(left, lambda e: e["mask"] != 0)).alias("e"))
    rows = rows.select("user_id", F.explode(ids_of(F.col("e.word"), F.col("e.mask"))).alias("meeting_id"))
    named = rows.join(meetings.select(F.col("id").alias("meeting_id"), "title"), "meeting_id").select("user_id", "meeting_id", "title")
    unnumbered = meetings.where("id IS NULL").agg(F.collect_list(F.struct(F.col("id").cast("long").alias("meeting_id"), "title"))).scalar()
    odd = users.where("is_active").select(F.col("id").alias("user_id"), F.explode(unnumbered).alias("m")).select("user_id", "m.*")
    return named.unionByName(odd)


def ack_status(users: DataFrame, meetings: DataFrame, acks: DataFrame) -> DataFrame:
    """Each user and meeting with the time of the first acknowledgement row, or null."""
    first = acks.groupBy("user_id", "meeting_id").agg(F.min_by("signed_at", "id").alias("signed_at"))
    pairs = users.select(F.col("id").alias("user_id")).crossJoin(meetings.select(F.col("id").alias("meeting_id")))
    return pairs.join(first, ["user_id", "meeting_id"], "left").select("user_id", "meeting_id", "signed_at")


def missing_ack_text(missing: DataFrame) -> DataFrame:
    """The titles that each user misses, in order of meeting, as one comma list."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("meeting_id", "title"))), lambda x: x["title"])
    return missing.groupBy("user_id").agg(F.array_join(titles, ", ").alias("missing"))


def team_overview(users: DataFrame, certificates: DataFrame, meetings: DataFrame, acks: DataFrame) -> DataFrame:
    """Certificates, progress and missing titles of each active user; shown: the list only where progress is under 100."""
    active = users.where("is_active")
    text = missing_ack_text(missing_acks(users, meetings, acks)).withColumnRenamed("user_id", "id")
    out = cert_counts(active, certificates).join(safety_progress(active, meetings, acks), "id").join(text, "id", "left")
    none = F.coalesce("missing", F.lit(""))
    return out.select("id", "full_name", "certificates", "progress", none.alias("missing"), F.when(F.col("progress") < 100, none).otherwise(F.lit("")).alias("shown"))
