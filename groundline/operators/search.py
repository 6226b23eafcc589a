"""Cosine top-k search of a set of query vectors against all vectors, in blocks.

Queries and vectors get the key they search under: the entity where it filters, none where everything is searched. The rows of a key are
divided in blocks of bounded size by hash of the id, as many as the key's rows ask for, and every two blocks of one key are a group of their own
(``key, q_block, v_block``): a task multiplies two bounded matrices and keeps ``k`` hits a query. What leaves it is k rows a query and block,
from which a ranked window takes the final k. A filtered query meets the vectors of its entity only; vectors nobody asks for are not sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK, VECTOR_BLOCK = 4096, 8192
#: Queries of a block that are multiplied at once, which bounds the matrix of similarities.
AT_ONCE, TOP_K = 512, 5


def cells(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (key, id, vector, ...) with q_block and v_block: each row once for every block of the other side of its key."""
    nq = queries.groupBy("key").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("nq"))
    nv = vectors.groupBy("key").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("nv"))
    blocks = nq.join(nv, "key")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(blocks, "key").withColumn("q_block", own("nq")).withColumn("v_block", other("nv"))
    v = vectors.join(blocks, "key").withColumn("v_block", own("nv")).withColumn("q_block", other("nq"))
    return q.drop("nq", "nv"), v.drop("nq", "nv")


def unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def meet(k: int):
    """Cogrouped function: a block of queries and a block of vectors to the k best of the block for each query."""

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        parts = []
        if q.num_rows and v.num_rows:
            queries, many = unit(q.column("vector")), unit(v.column("vector")).T
            ids = v.column("id").to_numpy()
            for lo in range(0, len(queries), AT_ONCE):
                sim = queries[lo : lo + AT_ONCE] @ many
                rough = np.round(sim, 4)
                least = np.partition(rough, -k, axis=1)[:, -k] if k < rough.shape[1] else np.full(len(rough), -np.inf)
                row, col = np.nonzero(rough >= least[:, None])  # the k best with all that tie with the last of them
                order = np.lexsort((ids[col], -np.round(sim[row, col], 8), -rough[row, col], row))
                row, col = row[order], col[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[keep], col[keep]
                parts.append((row + lo, col, sim[row, col]))
        row, col, raw = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        row, col = pa.array(row), pa.array(col)
        return pa.table({"qid": q.column("id").take(row), "id": v.column("id").take(col), "raw": pa.array(raw), "entity": v.column("entity").take(col), "fell_back": q.column("fell_back").take(row)})

    return run


def searched(queries: DataFrame, vectors: DataFrame, k: int, filtered: bool) -> DataFrame:
    """Hits of queries (id, key, fell_back, vector); without ``filtered`` no query has an entity for its key."""
    k = k or TOP_K
    # named anew, so that queries made from the vectors are told apart from them
    v = vectors.where("vector IS NOT NULL").select(F.col("id").alias("id"), F.coalesce("entity", F.lit("")).alias("entity"), F.col("vector").alias("vector"))
    # a vector stands under its entity, and under no entity for the queries that search everything
    keys = F.array(F.struct(F.lit(True).alias("all"), F.lit("").alias("entity")), F.struct(F.lit(False).alias("all"), F.col("entity").alias("entity")))
    v = v.withColumn("key", F.explode(keys) if filtered else keys[0])
    q, v = cells(queries.where("vector IS NOT NULL"), v)
    group = ["key", "q_block", "v_block"]
    near = q.groupBy(*group).cogroup(v.groupBy(*group)).applyInArrow(meet(k), "qid long, id long, raw double, entity string, fell_back boolean")
    order = W.partitionBy("qid").orderBy(F.round("raw", 4).desc(), F.round("raw", 8).desc(), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", F.round("raw", 4).alias("similarity"), "entity", "fell_back")


def keyed(queries: DataFrame, everything, fell_back=None) -> DataFrame:
    """Queries with their key: everything (a column), or their entity."""
    entity = F.coalesce("entity", F.lit(""))
    key = F.struct(everything.alias("all"), F.when(everything, "").otherwise(entity).alias("entity"))
    return queries.select(F.col("id").alias("id"), key.alias("key"), (F.lit(False) if fell_back is None else fell_back).alias("fell_back"), F.col("vector").alias("vector"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, mode: str = "all") -> DataFrame:
    """qid, rank, id, similarity (four places) and entity of the k nearest vectors of each query; k = 0 means the default.

    ``queries`` and ``vectors`` have id (bigint), entity (string) and vector (array<float>). mode: all; same (only
    vectors of the query's entity); named (the same for queries with an entity that is not empty, all for the others).
    """
    everything = {"all": F.lit(True), "same": F.lit(False), "named": F.coalesce("entity", F.lit("")) == ""}[mode]
    return searched(keyed(queries, everything), vectors, k, mode != "all").drop("fell_back")


def with_fallback(queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """top_k with mode named; queries whose filter leaves nothing are searched without it (fell_back). An entity leaves nothing if it has no vectors, so one search is enough."""
    there = vectors.where("vector IS NOT NULL").select(F.coalesce("entity", F.lit("")).alias("entity"), F.lit(True).alias("there")).distinct()
    asked = queries.join(there, "entity", "left")
    unnamed = F.coalesce("entity", F.lit("")) == ""
    missed = F.col("there").isNull() & ~unnamed
    return searched(keyed(asked, unnamed | missed, missed), vectors, k, True)
