"""From hits to one context for each question: the citation, the context block and the reasons not to trust it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERAL = ("", "general")


def is_general(entity: Column) -> Column:
    return F.coalesce(entity, F.lit("")).isin(*GENERAL)


def label(entity: Column, section: Column) -> Column:
    """entity | section, without the bar where one is missing."""
    return F.regexp_replace(F.concat_ws(" | ", F.coalesce(entity, F.lit("")), F.coalesce(section, F.lit(""))), r"^[ |]+|[ |]+$", "")


def context_blocks(hits: DataFrame) -> DataFrame:
    """qid and context: the hits (qid, rank, label, text, source_url, fetched_at) in the order of their ranks."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "label", F.lit("\n"), "text", F.lit("\nsource: "), "source_url", F.lit("\nfetched_at: "), "fetched_at")
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("context"))


def assembled(questions: DataFrame, hits: DataFrame, floor: float = 0.45) -> DataFrame:
    """One row per question (qid, named: array of entities): best similarity, cited id, weak and its reasons.

    hits: qid, rank, id, similarity, entity, fell_back.
    """
    per = hits.groupBy("qid").agg(
        F.max("similarity").alias("best"),
        F.min_by("id", "rank").alias("cited"),
        F.min_by("entity", "rank").alias("first_entity"),
        F.array_sort(F.collect_set(F.when(~is_general(F.col("entity")), F.col("entity")))).alias("present"),
        F.max("fell_back").alias("fell_back"),
    )
    x = questions.join(per, "qid", "left")
    named, present = F.size("named"), F.col("present")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("best") < floor, "below floor"),
            F.when(named > 1, F.concat(F.lit("names "), named.cast("string"), F.lit(" entities"))),
            F.when((named == 1) & (F.size(present) > 0) & ~F.array_contains(present, F.col("named")[0]), "other entities"),
            F.when((named == 0) & ~is_general(F.col("first_entity")) & (F.size(present) > 1), F.concat(F.lit("spans "), F.size(present).cast("string"), F.lit(" entities"))),
            F.when(F.col("fell_back"), "fell back"),
        )
    )
    reasons = F.when(F.col("best").isNull(), F.array(F.lit("no hits"))).otherwise(reasons)
    return x.select("qid", F.coalesce("best", F.lit(0.0)).alias("best"), "cited", (F.size(reasons) > 0).alias("weak"), F.array_join(reasons, ",").alias("reasons"))


def summary() -> Column:
    """One line on an assembled question (best, weak, reasons)."""
    return F.concat(F.format_string("max_similarity=%.3f", "best"), F.when(F.col("weak"), F.concat(F.lit(" weak="), "reasons")).otherwise(" strong"))
