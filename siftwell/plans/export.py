"""Nested export of companies with their addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import nest

EMAIL_FIELDS = ["address", "confidence", "source", "method", "page", "validation_status", "mx_valid", "is_disposable", "is_role_based", "discovered_at"]


def export_companies(companies: DataFrame, emails: DataFrame, min_confidence: int = 0) -> DataFrame:
    """A row for each company; its addresses of so much confidence, no duplicates, best first. Companies without any stay.

    companies.id is emails.company_id; emails must have EMAIL_FIELDS and is_duplicate.
    """
    good = emails.where((F.col("confidence") >= min_confidence) & ~F.col("is_duplicate")).withColumnRenamed("company_id", "id")
    nested = nest(companies, good, "id", EMAIL_FIELDS, "emails", [(-F.col("confidence")).alias("o1"), F.col("address").alias("o2")])
    return nested.withColumn("state", F.col("address.state")) if "address" in companies.columns else nested


def export_company(companies: DataFrame, emails: DataFrame, company_id: str) -> DataFrame:
    """One company in the same form; no row if there is none."""
    return export_companies(companies.where(F.col("id") == company_id), emails.where(F.col("company_id") == company_id))


def export_totals(exported: DataFrame) -> DataFrame:
    return exported.agg(F.count(F.lit(1)).alias("companies"), F.coalesce(F.sum(F.size("emails")), F.lit(0)).alias("emails"), F.count_if(F.size("emails") > 0).alias("leads"))
