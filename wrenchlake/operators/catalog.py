"""The library's catalogue: documents, categories, and stored files against the registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import guess_title, relinked_type, route_of, search_matches, text


def docs_with_category(documents: DataFrame, categories: DataFrame) -> DataFrame:
    """Documents with their category's name, empty where it is missing."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return documents.join(names, "category_id", "left").withColumn("category", text("category"))


def catalog_export(documents: DataFrame, categories: DataFrame) -> DataFrame:
    rows = docs_with_category(documents, categories)
    return rows.select("id", "title", "keywords", "category", "category_id", "file_path", "file_type", F.coalesce("indexed", F.lit(False)).alias("indexed")).orderBy("id")


def write_catalog(export: DataFrame, path: str, exported_at: str) -> None:
    """One JSON object a line; null fields are written too."""
    export.withColumn("exported_at", F.lit(exported_at)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def library_search(documents: DataFrame, needle: Column | str, category_id: int | None = None) -> DataFrame:
    """Documents (of a category) whose title and keywords hold every term; ordered by title."""
    found = documents.where(search_matches(F.lit(needle) if isinstance(needle, str) else needle, F.col("title"), F.col("keywords")))
    return (found if category_id is None else found.where(F.col("category_id") == category_id)).orderBy("title", "id")


def safety_doc_search(documents: DataFrame, needle: str) -> DataFrame:
    return library_search(documents, needle)


def index_status(documents: DataFrame) -> DataFrame:
    shown = F.coalesce(F.nullif("index_note", F.lit("")), F.when(F.coalesce("indexed", F.lit(False)), "indexed").otherwise("not indexed"))
    return documents.select("id", "title", shown.alias("status")).orderBy("title", "id")


def registry_union(*registries: DataFrame) -> DataFrame:
    """Distinct file paths of all registries."""
    return reduce(DataFrame.unionByName, [r.select(F.col("file_path").alias("key")) for r in registries]).where("key IS NOT NULL").distinct()


def unregistered_files(keys: DataFrame, registry: DataFrame) -> DataFrame:
    return keys.join(registry, "key", "left_anti")


def registered_files(keys: DataFrame, registry: DataFrame) -> DataFrame:
    return keys.join(registry, "key", "left_semi")


def relink_plan(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Of each unlinked key: the registry it belongs to, a title and a file type."""
    key = F.col("key")
    return unregistered_files(keys, registry).select("key", route_of(key).alias("route"), guess_title(key).alias("title"), relinked_type(key).alias("file_type"))


def relink_stats(keys: DataFrame, registry: DataFrame) -> DataFrame:
    joined = keys.join(registry.withColumn("known", F.lit(True)), "key", "left")
    return joined.agg(F.count("*").alias("listed"), F.count_if(F.col("known").isNull()).alias("unlinked"), F.count_if(F.col("known").isNotNull()).alias("linked"))


def deletable_categories(categories: DataFrame, documents: DataFrame) -> DataFrame:
    return categories.join(documents.select(F.col("category_id").alias("id")), "id", "left_anti").select("id", "name")


def docs_per_category(categories: DataFrame, documents: DataFrame) -> DataFrame:
    n = documents.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n"))
    return categories.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("documents"))


def library_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts of documents, indexed documents and chunks: three one-row aggregates side by side."""
    docs = documents.agg(F.count("*").alias("documents"), F.count_if(F.coalesce("indexed", F.lit(False))).alias("indexed"))
    return docs.crossJoin(chunks.agg(F.count("*").alias("chunks")))


def chunk_sources(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's path and type; a missing document or type counts as pdf."""
    facts = documents.select(F.col("id").alias("document_id"), "file_path", F.col("file_type").alias("_type"))
    return chunks.join(facts, "document_id", "left").withColumn("file_type", F.coalesce(F.nullif("_type", F.lit("")), F.lit("pdf"))).drop("_type")
