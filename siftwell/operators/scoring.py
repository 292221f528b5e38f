"""The confidence of a find: a base for how it was found, and weights for what is known about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import urls as U
from ..functions.emails import domain_part
from ..functions.text import clamp


def base_score(method: Column) -> Column:
    out = F.lit(C.OTHER_METHOD_BASE)
    for name, score in C.METHOD_BASE.items():
        out = F.when(method == name, score).otherwise(out)
    return out


def confidence(method: Column, signals: dict[str, Column]) -> Column:
    """0 to 100. A signal that is null counts as not given."""
    terms = [F.when(F.coalesce(c, F.lit(False)), C.SIGNAL_WEIGHTS[name]).otherwise(0) for name, c in signals.items()]
    return clamp(reduce(lambda x, y: x + y, terms, base_score(method))).cast("int")


def signals_of(method: Column, page_url: Column, address: Column, company_domain: Column, occurrences: Column | None = None) -> dict[str, Column]:
    """Signals of a validated find (columns as ``validation.validate`` names them). The domain must equal the company's."""
    return {
        "via_mailto": method == "mailto",
        "on_contact_page": U.is_contact_page(page_url),
        "found_multiple_times": (occurrences if occurrences is not None else F.lit(1)) > 1,
        "mx_valid": F.col("mx_valid"),
        "smtp_valid": F.col("smtp_valid"),
        "company_domain_match": domain_part(address) == F.lower(company_domain),
        "via_schema": method.isin("schema_ld", "json_ld"),
        "is_disposable": F.col("is_disposable"),
        "is_malformed": ~F.col("is_valid_syntax"),
        "is_role_based": F.col("is_role_based"),
        "no_mx_record": ~F.col("mx_valid"),
        "via_ocr": method == "ocr",
        "via_comment": method == "html_comment",
    }


def score_finds(finds: DataFrame, page_url: Column, company_domain: Column) -> DataFrame:
    """Validated finds plus ``confidence``."""
    return finds.withColumn("confidence", confidence(F.col("method"), signals_of(F.col("method"), page_url, F.col("address"), company_domain)))


def tier(score: Column) -> Column:
    """Optional label of a score."""
    return F.when(score >= 95, "Verified").when(score >= 85, "High").when(score >= 70, "Risky").otherwise("Invalid")
