"""Source lists and documents: reading, filtering, metadata, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions.text import display_name, strip

REQUIRED = ("url", "scheme_name", "scheme_category", "doc_type")
METADATA = ("scheme_name", "scheme_category", "doc_type", "source_url", "fetched_at")
MAX_CHARS = 200_000


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """A source list in CSV with a header, all columns strings, a byte order mark left out; missing columns raise ValueError."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return source_rows(df)


def source_rows(df: DataFrame) -> DataFrame:
    """The four columns, stripped, nulls as empty strings."""
    return df.select(*(strip(c).alias(c) for c in REQUIRED))


def reject_reason(url: str = "url") -> Column:
    return F.when(F.col(url) == "", "blank").when(~F.col(url).rlike(r"(?i)^https?://[^/]"), "not a web address").otherwise("kept")


def public(rows: DataFrame) -> DataFrame:
    """Rows with an http or https address."""
    return rows.where(reject_reason() == "kept")


def content_kind(url: Column) -> Column:
    """pdf, html, page or none, by the address."""
    return F.when(url.rlike(r"(?i)\.pdf($|[?#])"), "pdf").when(url.rlike(r"(?i)\.html?($|[?#])"), "html").when(url.rlike(r"(?i)^https?://"), "page").otherwise("none")


def typed(pages: DataFrame) -> DataFrame:
    """pd_id, text and the metadata as columns, missing ones empty."""
    return pages.select("pd_id", "text", *(F.coalesce(F.col("metadata")[k], F.lit("")).alias(k) for k in METADATA))


def truncated(pages: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """Pages with text, cut at ``most`` characters."""
    return pages.where("text IS NOT NULL AND trim(text) <> ''").withColumn("text", F.substring("text", 1, most))


def split(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable documents, and the quarantined ones with their reason."""
    x = typed(pages)
    reason = F.when(strip("text") == "", "no text").when(strip("source_url") == "", "no source")
    x = x.withColumn("reason", reason)
    return x.where("reason IS NULL").drop("reason"), x.where("reason IS NOT NULL")


def owners(sources: DataFrame) -> DataFrame:
    """url and owner (name shown) of each address of the source list."""
    return sources.select(strip("url").alias("url"), display_name(F.col("scheme_name")).alias("owner")).where("url <> ''").groupBy("url").agg(F.max("owner").alias("owner"))
