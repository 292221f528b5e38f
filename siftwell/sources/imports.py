"""Company lists: header detection, cleaning, first row of a domain, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import urls as U
from ..functions.text import sanitise, strip


def detect_column(headers: list[str], aliases: list[str]) -> str | None:
    """The first header, in the order of the file, that is one of the aliases; as it is spelt in the file."""
    return next((h for h in headers if h.strip().lower() in aliases), None)


def read_company_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, plus source_file. Lines that are wholly blank are no records."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    if not df.columns:
        raise ValueError("the file has no headers")
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def number_records(df: DataFrame, out: str = "source_row", first: int = 2) -> DataFrame:
    """Record numbers of one ordered file, from 2 on, as the header is record 1. Without one ordered file the numbers mean nothing."""
    # ids count up from 2**33 times the partition's number; the records of earlier partitions take the place of that
    placed = df.withColumn("record_at", F.monotonically_increasing_id()).withColumn("record_part", F.shiftright("record_at", 33))
    counts = placed.groupBy("record_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("record_part", F.coalesce(F.sum("n").over(Window.orderBy("record_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row a partition of the file
    return placed.join(F.broadcast(before), "record_part").select(*df.columns, (F.col("record_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + first).cast("long").alias(out))


def clean_import(rows: DataFrame, row: str = "source_row") -> DataFrame:
    """Every record plus raw, domain, website, name and outcome: ``empty``, ``invalid``, ``duplicate`` (its domain stood in an earlier record) or ``queued``."""
    headers = [c for c in rows.columns if c not in (row, "source_file")]
    domain_col, name_col = detect_column(headers, C.DOMAIN_COLUMNS), detect_column(headers, C.NAME_COLUMNS)
    if domain_col is None:
        raise ValueError(f"a domain or website column is needed; found {headers}")
    raw = F.coalesce(strip(F.col(f"`{domain_col}`")), F.lit(""))
    name = F.nullif(sanitise(F.col(f"`{name_col}`")), F.lit("")) if name_col else F.lit(None).cast("string")
    df = rows.select(F.col(row).alias("source_row"), raw.alias("raw"), name.alias("name"))
    df = df.withColumn("domain", F.when(F.col("raw") == "", None).when(U.is_maps(F.col("raw")), U.maps_placeholder(F.col("raw"))).otherwise(U.normal_domain(F.col("raw"))))
    df = df.withColumn("website", F.when(U.is_maps(F.col("raw")), F.col("raw")).otherwise(F.concat(F.lit("https://"), F.col("domain"))))
    first = df.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.min("source_row").alias("first_row"))
    df = df.join(first, "domain", "left")
    return df.withColumn(
        "outcome", F.when(F.col("raw") == "", "empty").when(F.col("domain").isNull(), "invalid").when(F.col("source_row") > F.col("first_row"), "duplicate").otherwise("queued")
    ).select("source_row", "raw", "name", "domain", "website", "outcome")


def new_companies(cleaned: DataFrame, stored: DataFrame) -> DataFrame:
    """Queued records whose domain is not stored yet."""
    return cleaned.where("outcome = 'queued'").join(stored.select("domain"), "domain", "left_anti")


def import_summary(cleaned: DataFrame, most_errors: int = 20) -> DataFrame:
    """total_rows, queued_jobs, skipped_rows, errors (the first of the file, so many at most)."""
    counts = cleaned.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("outcome") == "queued").alias("queued_jobs"), F.count_if(F.col("outcome") != "queued").alias("skipped_rows"))
    text = F.concat(F.lit("Row "), F.col("source_row").cast("string"), F.lit(": invalid domain '"), F.col("raw"), F.lit("'"))
    first = cleaned.where("outcome = 'invalid'").orderBy("source_row").limit(most_errors).select("source_row", text.alias("text"))
    errors = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("source_row", "text"))), lambda x: x["text"]).alias("errors"))
    return counts.crossJoin(errors)  # one row each


def resolve_maps(pending: DataFrame, resolution: DataFrame, stored: DataFrame) -> DataFrame:
    """pending(id, domain, website) of map listings -> id, new_domain, outcome.

    resolution(maps_url, resolved_url). No site: ``no_website``. A site that another company has, stored or resolved by a smaller
    id: ``duplicate_listing``. Else ``resolved``.
    """
    df = pending.join(resolution.withColumnRenamed("maps_url", "website"), "website", "left").withColumn("new_domain", U.normal_domain(F.col("resolved_url")))
    w = Window.partitionBy("new_domain").orderBy("id")
    df = df.withColumn("rn", F.when(F.col("new_domain").isNotNull(), F.row_number().over(w)))
    df = df.join(stored.select(F.col("domain").alias("new_domain"), F.lit(True).alias("known")).distinct(), "new_domain", "left")
    return df.select("id", "new_domain", F.when(F.col("new_domain").isNull(), "no_website").when(F.col("known") | (F.col("rn") > 1), "duplicate_listing").otherwise("resolved").alias("outcome"))


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    """One address a line, blanks dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("address")).where("address <> ''")
