"""Reading and writing tables: Parquet by default, a database by JDBC where one is wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

PAGES_RAW = """company_id string, domain string, page_ord int, url string, final_url string, html string, status_code int,
content_type string, engine string, success boolean, error string, duration_ms double, redirect_chain array<string>,
response_headers map<string,string>"""


def read(spark: SparkSession, place: str, **jdbc: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=place, **jdbc).load() if place.startswith("jdbc:") else spark.read.parquet(place)


def append(df: DataFrame, place: str, partition_by: str | None = None, **jdbc: str) -> None:
    if place.startswith("jdbc:"):
        df.write.format("jdbc").options(url=place, **jdbc).mode("append").save()
    else:
        writer = df.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(place)


def read_pages(spark: SparkSession, place: str) -> DataFrame:
    """Collected pages, whichever engine fetched them (http, browser, pdf, ocr)."""
    return spark.read.schema(PAGES_RAW).parquet(place)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """All rows as one JSON array in the text files of a folder, which is the array when they are joined in the order of their names.
    Every task writes its own rows; none holds them all. The rows are saved with their places first, so ``df`` is read once."""
    spark = df.sparkSession
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"), F.monotonically_increasing_id().alias("n"))
    at = work_dir(spark, "json")
    rows.write.parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    first = rows.agg(F.min("n")).first()[0]
    lines = rows.repartitionByRange("n").sortWithinPartitions("n").select(F.concat(F.when(F.col("n") == F.lit(first), "[").otherwise(","), F.col("json")).alias("value"))
    end = spark.range(1, numPartitions=1).select(F.lit("]" if first is not None else "[]").alias("value"))
    lines.union(end).write.mode("overwrite").text(path)


def json_array(df: DataFrame) -> DataFrame:
    """All rows as one JSON array in one row: for small results only, as one task makes it."""
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
