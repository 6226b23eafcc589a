"""The whole way from turns to answers, as one plan: guard, memory, retrieval, assembly, reply, post-checks, trace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions.rules import verdict
from groundline.functions.text import display_name, words
from groundline.operators import answers, assemble, index, memory, search
from groundline.runtime import cut

TOP_K, SENTENCES = 5, 3


def quoted(question: Column, text: Column) -> Column:
    """Stands in for the chat completion: the sentence of the best chunk's whole text that has most of the question's words, the first of equals."""
    parts = F.flatten(F.transform(F.split(text, "\n"), answers.sentences))
    scored = F.transform(parts, lambda x, i: F.struct(F.size(F.array_intersect(words(x), words(question))).alias("n"), (-i).alias("at"), x.alias("sentence")))
    return F.coalesce(F.array_max(scored)["sentence"], F.lit(""))


def retrieved(questions: DataFrame, chunks: DataFrame, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """Hits of ``questions`` (qid, query_text, named): qid, rank, id, similarity, entity, fell_back; and the chunks by that id.

    Questions that name exactly one entity search its chunks, all chunks where it has none; the others search all chunks.
    """
    texts = chunks.where("text IS NOT NULL").dropDuplicates(["id"]).withColumn("key", F.xxhash64("id")).withColumn("entity", F.lower(display_name(F.col("scheme_name"))))
    v = index.embedded(texts.select(F.struct("key", "entity").alias("row"), "text"), "row", "text")
    q = index.embedded(questions.select(F.struct("qid", F.when(F.size("named") == 1, F.col("named")[0]).otherwise("").alias("entity")).alias("row"), "query_text"), "row", "query_text")
    q, v = cut(q.select(F.col("row.qid").alias("id"), "row.entity", F.col("embedding").alias("vector"))), cut(v.select(F.col("row.key").alias("id"), "row.entity", F.col("embedding").alias("vector")))
    return search.with_fallback(q, v, k), texts.select(F.col("key").alias("id"), "text", "source_url", "fetched_at")


def answered(turns: DataFrame, chunks: DataFrame, sources: DataFrame, complete: Callable[[Column, Column], Column] = quoted, floor: float = 0.45) -> DataFrame:
    """One row per user turn: mode, text, source_url, last_updated, reason and the stage at which it stopped.

    ``complete`` makes the reply from the question and the text of the cited chunk; it is the only stage that stands in for another.
    """
    asked = memory.resolved(turns, memory.entities(sources)).withColumn("verdict", verdict(F.col("text")))
    query_text = F.when(F.col("origin") == "memory", F.concat_ws(" ", "text", "entity")).otherwise(F.col("text"))
    named = F.when(F.col("entity") == "", F.array().cast("array<string>")).otherwise(F.split(F.lower("entity"), ", "))
    asked = asked.withColumn("query_text", query_text).withColumn("named", named)
    asked = cut(asked.withColumn("qid", F.xxhash64("text", "query_text", "named")))  # read several times below
    open_ = asked.where("verdict = 'allow' AND text <> ''").select("qid", "text", "query_text", "named").dropDuplicates(["qid"])  # what is refused never reaches retrieval
    hits, texts = retrieved(open_, chunks)
    hits = cut(hits)
    found = assemble.assembled(open_.select("qid", "named"), hits, floor)
    strong = found.where("NOT weak").join(texts, F.col("cited") == F.col("id")).join(open_.select("qid", F.col("text").alias("question")), "qid")  # nor what is weak the reply
    reply = strong.select("qid", "source_url", "fetched_at", complete(F.col("question"), F.col("text")).alias("raw"))
    reply = cut(reply.withColumn("reply", F.array_join(F.slice(answers.sentences(answers.clean(F.col("raw"))), 1, SENTENCES), " ")))
    context = hits.join(texts, "id").join(reply.select("qid"), "qid", "left_semi").select(F.col("qid").cast("string").alias("source_url"), "text")
    loose = answers.ungrounded(reply.select(F.col("qid").alias("answer_id"), F.col("qid").cast("string").alias("source_url"), F.col("reply").alias("text")), context)
    x = asked.join(found.select("qid", "weak"), "qid", "left").join(reply, "qid", "left").join(loose.select(F.col("answer_id").alias("qid"), F.lit(True).alias("loose")).distinct(), "qid", "left")
    reason = (
        F.when(F.col("text") == "", "empty")
        .when(F.col("verdict") != "allow", F.col("verdict"))
        .when(F.coalesce("weak", F.lit(True)), "weak_retrieval")
        .when(answers.declined(F.col("raw")) | (F.coalesce("reply", F.lit("")) == ""), "insufficient")
        .when(~F.col("reply").rlike(r"\p{L}"), "unusable")
        .when(F.col("loose"), "ungrounded")
        .otherwise("")
    )
    stop = F.when(F.col("reason").isin("empty"), "trim").when(F.col("reason").isin("pii", "advice", "returns"), "guard").when(F.col("reason") == "weak_retrieval", "assemble").when(F.col("reason") != "", "generate").otherwise("answered")
    x = x.withColumn("reason", reason).withColumn("stopped_at", stop)
    fact = F.col("reason") == ""
    return x.select("conv_id", "turn", F.when(fact, "fact").otherwise("refuse").alias("mode"), F.when(fact, F.col("reply")).otherwise("").alias("text"), F.when(fact, F.col("source_url")).otherwise("").alias("source_url"), F.when(fact, F.col("fetched_at")).otherwise("").alias("last_updated"), "reason", "stopped_at")


def ingest_summary(sources: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of each stage of the ingestion in one row."""
    one = sources.agg(F.count("*").alias("sources")).withColumn("k", F.lit(1))
    two = pages.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).withColumn("k", F.lit(1))
    three = chunks.agg(F.count("*").alias("chunks")).withColumn("k", F.lit(1))
    return one.join(two, "k").join(three, "k").drop("k")
