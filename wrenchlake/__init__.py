"""Service-document and job analytics as Spark DataFrame operators."""
