"""Mixing of sources to target shares of tokens (problem 7).

Every row of a source with a target gets its number of tokens and a hash of its id. From the sums by source follows how much each source
gives: its share of the total, at most ``max_repeats`` times what it has; what a limited source cannot give is divided among
the others by their shares. A source that gives r.f times its tokens repeats all its rows r times and
once more those whose hash is below a threshold: so the choices for smaller and larger totals are nested in one another.

The thresholds come from histograms: tokens summed by source and bucket of the hash, the running sum names the bucket in which the budget
ends, and only that bucket is divided again, ``LEVELS`` times. Nothing is sorted, and no row leaves its partition but as a sum.

Edge cases: rows of sources without a target, and with a null source, are not in the mix. Null and empty texts have no tokens and are not
in the mix. A target without documents gives nothing and is reported with share 0. Rows with equal ids share one hash and are chosen together. Null shares or repeats count as 0. Several
target rows for one source: the shares add up, the largest max_repeats holds. Empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundline.llm.encode import VOCABULARY, encode
from groundline.runtime import cut

LEVELS, BITS = 3, 12


def sized(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """row_id, source, n_tokens and hash (an integer of LEVELS * BITS bits) of every row whose source has a target."""
    wanted = targets.where("source IS NOT NULL").select("source").distinct()
    rows = docs.select(F.struct(F.col("doc_id"), F.col("source")).alias("row"), "text", "source").join(wanted, "source", "left_semi")
    counted = encode(rows, "row", "text", vocabulary, count_only=True).where("n_tokens > 0")
    return counted.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_tokens", F.shiftrightunsigned(F.xxhash64("row.doc_id"), 64 - LEVELS * BITS).alias("hash"))


def budgets(rows: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: source, target_share, max_repeats, available, given (tokens it gives), repeats and rest (tokens beyond whole repeats)."""
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    have = wanted.join(rows.groupBy("source").agg(F.sum("n_tokens").alias("available")), "source", "left").na.fill(0, ["available"])
    every = W.partitionBy()  # as many rows as there are targets
    have = have.withColumn("most", F.col("available") * F.col("max_repeats"))
    have = have.withColumn("total", F.lit(total_tokens).cast("double") if total_tokens else F.sum("available").over(every).cast("double"))
    # The level at which a source is exhausted; below it the sources already exhausted give all they have and the others share the rest.
    have = have.withColumn("level", F.when(F.col("target_share") > 0, F.col("most") / F.col("target_share")))
    before = W.orderBy(F.col("level").asc_nulls_last(), "source").rowsBetween(W.unboundedPreceding, -1)
    have = have.withColumn("spent", F.coalesce(F.sum(F.when(F.col("target_share") > 0, F.col("most"))).over(before), F.lit(0)))
    have = have.withColumn("open", F.sum("target_share").over(every) - F.coalesce(F.sum("target_share").over(before), F.lit(0.0)))
    have = have.withColumn("fair", F.when(F.col("open") > 1e-12, (F.col("total") - F.col("spent")) / F.col("open")))
    # In the order of the levels the first source that is not exhausted at its fair level sets the level of all that follow.
    have = have.withColumn("water", F.min(F.when(F.col("fair") <= F.col("level"), F.struct("level", "source", "fair"))).over(every)["fair"])
    given = F.when(F.col("target_share") > 0, F.least(F.col("most").cast("double"), F.coalesce(F.col("target_share") * F.col("water"), F.col("most").cast("double")))).otherwise(0.0)
    have = have.withColumn("given", F.floor(given + 1e-6))
    have = have.withColumn("repeats", F.when(F.col("available") > 0, F.floor(F.col("given") / F.col("available"))).otherwise(0))
    return have.select("source", "target_share", "max_repeats", "available", "given", "repeats", (F.col("given") - F.col("repeats") * F.col("available")).alias("rest"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with ``below``: rows whose hash is less are taken once more than ``repeats``."""
    state = plan.withColumn("below", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * BITS
        # Only rows of the bucket in which the budget ends take part from the second level on.
        here = rows.join(state.where("rest > 0").select("source", "below"), "source").where(F.shiftright("hash", shift + BITS) == F.shiftright("below", shift + BITS))
        buckets = here.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
        up_to = W.partitionBy("source").orderBy("bucket")  # at most 2**BITS rows of a source
        ends = buckets.withColumn("sum", F.sum("tokens").over(up_to)).join(state.select("source", "rest"), "source")
        fits = ends.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("sum") > F.col("rest"), F.col("bucket"))), F.max("bucket") + 1).alias("bucket"), F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))), F.lit(0)).alias("taken"))
        state = cut(state.join(fits, "source", "left").withColumn("below", F.coalesce(F.shiftleft("bucket", shift), "below")).withColumn("rest", F.col("rest") - F.coalesce("taken", F.lit(0))).drop("bucket", "taken"))
    return state


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (source, doc_id, n_tokens, copies) and the report of each target.

    ``total_tokens`` is the size of the mix; unless given, as many tokens as the sources with a target have.
    """
    rows = cut(sized(docs, targets, vocabulary))
    plan = thresholds(rows, cut(budgets(rows, targets, total_tokens)))
    chosen = rows.join(plan.select("source", "repeats", "below"), "source").withColumn("copies", (F.col("repeats") + (F.col("hash") < F.col("below")).cast("int")).cast("int")).where("copies > 0").select("source", "doc_id", "n_tokens", "copies")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents"))
    report = plan.select("source", "target_share", "max_repeats", "available", "given").join(got, "source", "left").na.fill(0, ["mix_tokens", "most_copies", "documents"])
    whole = F.sum("mix_tokens").over(W.partitionBy())
    return chosen, report.select("source", "target_share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(0.0).alias("reached_share"), "max_repeats", "most_copies", "documents", F.col("available").alias("available_tokens"), "mix_tokens", (F.col("given") >= F.col("available") * F.col("max_repeats")).alias("limited"))
