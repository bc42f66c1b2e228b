"""Evidence from ranked chunks: cited sources, excerpts, context blocks and deterministic replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.text import named_brands, strip, text
from ..sources.steps import stored
from .jobs import ordered_join

FIRST, MERGED = 1800, 2500
SYSTEM = "the library"
# The texts of replies and plans below are fixed values: results must hold them word for word.


def hits(ranking: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Ranked chunks with their text and their document's path and type; ``rank`` numbers the excerpts.

    Few rows a question, and some results read them twice, so they are stored.  A stored ``ranking`` keeps the chunks' texts out of shuffles."""
    facts = documents.select(F.col("id").alias("document_id"), "file_path", F.col("file_type").alias("_type"))
    rows = ranking.select("query_id", "rank", "id").join(chunks.select("id", "document_id", "title", "page", "chunk_text", "is_index"), "id").join(facts, "document_id", "left")
    return stored(rows.withColumn("file_type", F.coalesce(F.nullif("_type", F.lit("")), F.lit("pdf"))).drop("_type"), "hits")


def merge_excerpts(rows: DataFrame) -> DataFrame:
    """One excerpt for each question, document and page: the first chunk's start, then each chunk that adds something."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", text("chunk_text").alias("t")))), lambda x: x["t"])
    first = F.min_by(F.struct("title", "file_path", "file_type"), "rank")
    grouped = rows.groupBy("query_id", "document_id", "page").agg(F.min("rank").alias("rank"), first.alias("f"), parts.alias("parts"))
    fold = F.aggregate("parts", F.left(F.col("parts")[0], F.lit(FIRST)), lambda acc, x: F.when((x == "") | F.contains(acc, x), acc).otherwise(F.left(F.concat(acc, F.lit("\n\n"), x), F.lit(MERGED))))
    return grouped.select("query_id", "rank", "document_id", "page", F.col("f.title").alias("title"), F.col("f.file_path").alias("file_path"), F.col("f.file_type").alias("file_type"), fold.alias("excerpt"))


def source_line() -> Column:
    return F.format_string("- %s (page %s)", text("title"), F.col("page").cast("string"))


def source_list(rows: DataFrame) -> DataFrame:
    """sources_text: a line for each chunk; sources_json: the merged sources in rank order, null paths included."""
    lines = rows.groupBy("query_id").agg(ordered_join("rank", source_line(), "\n").alias("sources_text"))
    source = F.struct("document_id", "title", "page", "file_path", "file_type", "excerpt")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))), lambda x: x["s"])
    return lines.join(merge_excerpts(rows).groupBy("query_id").agg(F.to_json(ordered, {"ignoreNullFields": "false"}).alias("sources_json")), "query_id")


def number_excerpts(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.col("rank").alias("excerpt"), "id", F.when(F.col("is_index"), "INDEX CHART").otherwise("PROCEDURE").alias("label"))


def context_block(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("is_index"), "INDEX CHART").otherwise("PROCEDURE")
    part = F.format_string("[EXCERPT %d | %s] Manual: %s | Page: %s\n%s", "rank", label, text("title"), F.col("page").cast("string"), text("chunk_text"))
    return rows.groupBy("query_id").agg(ordered_join("rank", part, "\n\n").alias("context"))


def no_match(model: Column, symptom: Column, lexicon: Lexicon = DEFAULT, system: str = SYSTEM) -> Column:
    asked = named_brands(model, symptom, lexicon=lexicon)
    brand = F.when(
        F.size(asked) > 0,
        F.concat(F.lit("- Named brand/model: "), F.array_join(asked, ", "), F.lit(". Nothing in the library for that brand in this category.\n- Do not use another brand's voltages, ohms, or pin names.\n")),
    ).otherwise(F.lit(""))
    advice = "- Check category selection\n- Try different keywords / model number\n- Ask a manager to upload/index the service manual\n- Scanned PDFs with no text cannot be searched until OCR is added"
    return F.concat(F.lit(f"No matching manual text was found in {system}.\n\n"), brand, F.lit(advice))


def offline_plan(queries: DataFrame, rows: DataFrame, lexicon: Lexicon = DEFAULT, system: str = SYSTEM) -> DataFrame:
    """query_id and plan: header, sources and the first eight excerpts, or the message that nothing matched.

    ``queries``: query_id, category_name, model_text, symptom.  ``system``: what the shop calls its library.
    """
    kind = F.when(F.col("is_index"), "INDEX").otherwise("PROC")
    cut = F.concat(F.left("chunk_text", F.lit(700)), F.when(F.length("chunk_text") > 700, "...").otherwise(""))
    part = F.format_string("**Excerpt %d [%s] — %s p.%s**\n%s\n", F.col("rank"), kind, text("title"), F.col("page").cast("string"), cut)
    body = rows.where("rank <= 8").groupBy("query_id").agg(ordered_join("rank", part, "\n").alias("body"))
    lines = rows.groupBy("query_id").agg(ordered_join("rank", source_line(), "\n").alias("sources"))
    model = F.coalesce(F.nullif("model_text", F.lit("")), F.lit("—"))
    head = F.concat_ws(
        "\n", F.lit("**Guided Diagnostics (AI offline — matching manual excerpts)**"), F.lit(""), F.concat(F.lit("**Category:** "), text("category_name")),
        F.concat(F.lit("**Model/System:** "), model), F.concat(F.lit("**Symptom:** "), text("symptom")), F.lit(""), F.lit("**Sources:**"), F.col("sources"), F.lit(""), F.col("body"),
        F.lit(f"\nOpen the **Source pages** panel in {system} to view/download the actual manual pages (figures, diagrams, LCD layouts)."),
    )
    plan = F.when(F.col("body").isNull(), no_match(F.col("model_text"), F.col("symptom"), lexicon, system)).otherwise(head)
    return queries.join(lines, "query_id", "left").join(body, "query_id", "left").select("query_id", plan.alias("plan"))


def offline_chat_reply(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id and reply of each turn (query_id, message): up to six excerpts, or that nothing matched."""
    part = F.format_string("**%s** p.%s\n%s\n", text("title"), F.col("page").cast("string"), F.left(text("chunk_text"), F.lit(500)))
    body = rows.where("rank <= 6").groupBy("query_id").agg(ordered_join("rank", part, "\n").alias("body"))
    none = "No matching manual text found. Check category / try different wording, or ask a manager to index the manual."
    reply = F.concat_ws("\n", F.lit("AI is offline (Groq not configured). Matching manual excerpts:"), F.lit(""), F.coalesce("body", F.lit(none)))
    blank = strip(text("message")) == ""
    return turns.join(body, "query_id", "left").select("query_id", F.when(blank, "Type a symptom or question first.").otherwise(reply).alias("reply"))
