"""Schemas of the engine's tables, typed reads, and schema upgrades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "users": "id bigint, username string, full_name string, role string, is_active boolean, created_date timestamp_ntz",
    "categories": "id bigint, name string",
    "documents": "id bigint, category_id bigint, title string, file_path string, file_type string, uploaded_by bigint, created_date timestamp_ntz, keywords string, indexed boolean, index_note string",
    "doc_chunks": "id string, document_id bigint, category_id bigint, title string, page int, chunk_text string, keywords string",
    "certificates": "id bigint, user_id bigint, title string, issuer string, file_path string, issued_date string, notes string, uploaded_by bigint, created_date timestamp_ntz",
    "safety_documents": "id bigint, title string, file_path string, file_type string, uploaded_by bigint, created_date timestamp_ntz, keywords string",
    "safety_meetings": "id bigint, title string, meeting_date string, file_path string, notes string, created_by bigint, created_date timestamp_ntz",
    "safety_acknowledgements": "id bigint, meeting_id bigint, user_id bigint, signed_at timestamp_ntz, understood boolean",
    "diagnostic_jobs": "id bigint, wo_number string, user_id bigint, category_name string, model_text string, concern string, plan_text string, findings string, step_log string, sources_text string, sources_json string, final_story string, status string, created_date timestamp_ntz, updated_date timestamp_ntz",
    "ask_chats": "id bigint, user_id bigint, category_name string, model_text string, title string, final_story string, created_date timestamp_ntz, updated_date timestamp_ntz",
    "ask_messages": "id bigint, chat_id bigint, role string, content string, created_date timestamp_ntz",
}
DEFAULTS = {"documents": {"indexed": False}}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def load_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table's Parquet files under its declared schema; columns that older files lack are null."""
    return spark.read.schema(schema(name)).parquet(path)


def upgrade_schema(df: DataFrame, name: str) -> DataFrame:
    """Adds the columns of the declared schema that ``df`` lacks, with their defaults; extra columns stay."""
    have = {c.lower() for c in df.columns}
    missing = {f.name: F.lit(DEFAULTS.get(name, {}).get(f.name)).cast(f.dataType) for f in schema(name) if f.name.lower() not in have}
    return df.withColumns(missing) if missing else df
