"""Entities named in conversations, and which earlier turn gives a question its entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundline.functions.rules import PERSONAL, matches
from groundline.functions.text import display_name, entity_key, strip, word_runs

TURNS = 10


def entities(sources: DataFrame) -> DataFrame:
    """alias (words in lower case) and entity (name to show) of every named scheme of the source list."""
    named = sources.where("scheme_name IS NOT NULL").select(entity_key(F.col("scheme_name")).alias("alias"), display_name(F.col("scheme_name")).alias("entity")).where("alias <> '' AND alias <> 'general'")
    return named.groupBy("alias").agg(F.max("entity").alias("entity"))


def named_entities(texts: DataFrame, aliases: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, alias and entity, once for each alias whose words stand in the text: runs of words joined with the aliases by equality.

    Runs are as long as the longest alias, which is looked up first.
    """
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    runs = texts.where(F.col(text_col).isNotNull()).select(*keys, F.explode(F.array_distinct(word_runs(F.col(text_col), longest))).alias("alias"))
    return runs.join(aliases, "alias").select(*keys, "alias", "entity").distinct()


def user_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn and stripped text of each user turn, repeated rows once."""
    return turns.where("role = 'user'").select("conv_id", "turn", strip("text").alias("text")).distinct()


def screened(turns: DataFrame, last: int = TURNS) -> DataFrame:
    """The last turns of each conversation that are not blank and hold no personal data."""
    kept = user_turns(turns).where((F.col("text") != "") & (F.size(matches(F.col("text"), PERSONAL)) == 0))
    return kept.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc(), "text"))).where(F.col("back") <= last)


def resolved(turns: DataFrame, aliases: DataFrame, last: int = TURNS) -> DataFrame:
    """conv_id, turn, entity and origin (question, memory or none) of each user turn.

    A turn's own entities win; else the most recent of the ``last`` screened turns before it that names exactly one entity gives it (an as-of join,
    as a window over the conversation).
    """
    own = user_turns(turns).withColumn("clean", (F.col("text") != "") & (F.size(matches(F.col("text"), PERSONAL)) == 0))
    found = named_entities(own, aliases, ["conv_id", "turn", "text"]).groupBy("conv_id", "turn", "text").agg(F.array_sort(F.collect_set("entity")).alias("own"))
    x = own.join(found, ["conv_id", "turn", "text"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    # the place of a turn among the clean ones bounds how far memory reaches
    w = W.partitionBy("conv_id").orderBy("turn", "text")
    x = x.withColumn("nth", F.coalesce(F.sum(F.col("clean").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    donor = F.last(F.when(F.col("clean") & (F.size("own") == 1), F.struct(F.col("own")[0].alias("entity"), (F.col("nth") + 1).alias("at"))), ignorenulls=True)
    x = x.withColumn("donor", donor.over(w.rowsBetween(W.unboundedPreceding, -1)))
    remembered = F.when(F.col("donor.at") > F.col("nth") - last, F.col("donor.entity"))
    entity = F.when(F.size("own") > 0, F.array_join("own", ", ")).otherwise(remembered)
    origin = F.when(F.size("own") > 0, "question").when(remembered.isNotNull(), "memory").otherwise("none")
    return x.select("conv_id", "turn", "text", F.coalesce(entity, F.lit("")).alias("entity"), origin.alias("origin"))
