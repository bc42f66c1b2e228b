"""From pages of text to chunks with document facts, and the upkeep of those chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_texts, is_blank, text

NOT_PDF = "Only PDF files are indexed for guided diagnostics"
NO_TEXT = "No extractable text (scanned PDF may need OCR)"


#: A document's facts that stand beside each of its chunks.
FACTS = ("category_id", "title", "keywords")


def page_source(docs: DataFrame, pages: str = "pages", keep: tuple[str, ...] = ()) -> DataFrame:
    """document_id, page (from 1) and text of each page that is not blank, and the columns to ``keep``; blank pages keep their numbers."""
    return docs.select("document_id", *keep, F.posexplode(pages).alias("at", "text")).where(~is_blank(F.col("text"))).select("document_id", *keep, (F.col("at") + 1).alias("page"), "text")


def chunk_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """document_id, page, chunk_no (from 0) and chunk_text of each page's overlapping windows, and the columns to ``keep``."""
    return pages.select("document_id", *keep, "page", F.posexplode(chunk_texts(F.col("text"))).alias("chunk_no", "chunk_text"))


def chunk_id() -> Column:
    """A chunk's key: document, page and number, padded with zeros, so that keys are unique whatever their size and, for ids from
    0 on, in the order of the library."""
    part = lambda name, width: F.when(F.length(F.col(name).cast("string")) > width, F.col(name).cast("string")).otherwise(F.lpad(F.col(name).cast("string"), width, "0"))
    return F.concat_ws("-", part("document_id", 19), part("page", 10), part("chunk_no", 10))


def with_document(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks as stored: the document's title, keywords and category beside each chunk."""
    return as_stored(chunks.join(documents.select(F.col("id").alias("document_id"), *FACTS), "document_id"))


def as_stored(chunks: DataFrame) -> DataFrame:
    """``with_document`` of chunks that have carried their document's facts since they were pages: no text is shuffled."""
    return chunks.select(chunk_id().alias("id"), "document_id", "category_id", "title", "page", "chunk_text", text("keywords").alias("keywords"))


def propagate_metadata(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's present title and keywords (not its category); orphans keep their own."""
    facts = documents.select(F.col("id").alias("document_id"), F.col("title").alias("_title"), text("keywords").alias("_keywords"), F.lit(True).alias("_known"))
    new = {"title": F.when(F.col("_known"), F.col("_title")).otherwise(F.col("title")), "keywords": F.when(F.col("_known"), F.col("_keywords")).otherwise(F.col("keywords"))}
    return chunks.join(facts, "document_id", "left").withColumns(new).select(*chunks.columns)


def purge_deleted_documents(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    return chunks.join(deleted.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti").select(*chunks.columns)


def index_document_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, indexed and index_note of each document after indexing."""
    made = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    pdf = F.lower(text("file_type")) == "pdf"
    note = F.when(~pdf, NOT_PDF).when(F.col("n").isNull(), NO_TEXT).otherwise(F.format_string("Indexed %d chunks from %d pages", "n", "pages"))
    return documents.select("id", "file_type").join(made, "id", "left").select("id", (pdf & F.col("n").isNotNull()).alias("indexed"), note.alias("index_note"))


def reindex_outcome(report: DataFrame) -> DataFrame:
    """ok and failed documents of a report."""
    return report.agg(F.count_if("indexed").alias("ok"), F.count_if(~F.col("indexed")).alias("failed"))
