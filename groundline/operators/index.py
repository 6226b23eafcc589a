"""The index of chunks: ids, checks before writing, writing and appending, hashed embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions.text import strip
from groundline.operators import chunking
from groundline.runtime import cut, spread

DIMENSIONS = 64


def chunk_id(url: Column, number: Column) -> Column:
    """First eight hex digits of the address's SHA-1, and the chunk's number."""
    return F.concat(F.substring(F.sha1(F.coalesce(url, F.lit("")).cast("binary")), 1, 8), F.lit("-"), number)


def without_citation(rows: DataFrame, url: str = "source_url") -> DataFrame:
    return rows.where(strip(url) == "")


def flat_metadata(metadata: Column) -> Column:
    """key=value pairs in the order of the keys, null values left out."""
    pairs = F.transform(F.map_entries(F.map_filter(metadata, lambda k, v: v.isNotNull())), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";")


def checks(chunks: DataFrame) -> DataFrame:
    """One row of counts that must hold before an index is written."""
    blank = F.coalesce(F.trim("source_url"), F.lit("")) == ""
    return chunks.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("id")).alias("repeated_ids"), F.count_if(blank).alias("without_citation"), F.count_if(F.col("embedding").isNull()).alias("without_vector"), F.count_distinct(F.size("embedding")).alias("dimensions"))


def write(chunks: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write the index by entity after its checks; ValueError if there is nothing to write or a check fails. The number of rows."""
    c = checks(chunks).first()
    if not c.rows or c.repeated_ids or c.without_citation or c.without_vector or c.dimensions != 1:
        raise ValueError(f"index not written: {c.asDict()}")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    chunks.withColumn("entity", F.coalesce("scheme_name", F.lit(""))).withColumn("norm", norm).write.mode(mode).partitionBy("entity").parquet(path)
    return c.rows


class MissingIndex(FileNotFoundError):
    """There is no index at the path."""


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The index at ``path``; MissingIndex if there is none. A blank entity is an empty string."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        raise MissingIndex(path) from e
    return rows.withColumn("entity", F.coalesce("entity", F.lit("")))


def append(chunks: DataFrame, path: str) -> int:
    """Append the chunks whose id the index does not have; the number appended."""
    new = cut(to_append(chunks, opened(chunks.sparkSession, path).select("id")))  # what is read from the index is read before it is written
    return 0 if new.isEmpty() else write(new, path, "append")


def page_chunks(pages: DataFrame) -> DataFrame:
    """id, source_url, chunk_index, chunk_count, section and text of every chunk of the pages that have an address and a text; of several pages with one address the longest."""
    usable = pages.select(F.trim("source_url").alias("source_url"), "text", "scheme_name").where("source_url <> '' AND text <> ''")
    one = usable.groupBy("source_url").agg(F.max(F.struct(F.length("text"), "text", "scheme_name")).alias("page")).select("source_url", "page.text", "page.scheme_name")
    return chunking.chunked(one, "source_url", "text", "scheme_name").withColumn("id", chunk_id(F.col("source_url"), F.col("chunk_index").cast("string")))


def to_append(new: DataFrame, have: DataFrame) -> DataFrame:
    return new.join(have, "id", "left_anti")


def embedded(df: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """id_col and embedding: signed feature hashing of the words, length one; null for texts without words."""
    kind = df.schema[id_col].dataType.simpleString()
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"([\p{L}\p{M}\p{Nd}]+)"))
    hashes = df.select(id_col, F.transform(words, lambda w: F.xxhash64(w)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            size = np.asarray(pa.compute.list_value_length(lists))
            h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            row = np.repeat(np.arange(len(size)), size)
            sign = np.where(h >> np.uint64(63), -1.0, 1.0)
            m = np.bincount(row * dimensions + (h % np.uint64(dimensions)).astype(np.int64), sign, minlength=len(size) * dimensions).reshape(-1, dimensions)
            norm = np.sqrt((m * m).sum(1))
            m = (m / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dimensions), pa.int32()), pa.array(m.ravel()), mask=pa.array(norm == 0))
            yield pa.record_batch([batch.column(0), vectors], names=[id_col, "embedding"])

    return spread(hashes).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")


def equivalence(pairs: DataFrame) -> DataFrame:
    """pairs, least_cosine and most_apart of two vectors (a, b: array<double>) a row."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))
    apart = F.array_max(F.zip_with("a", "b", lambda p, q: F.abs(p - q)))
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.min(cosine), 4).alias("least_cosine"), F.round(F.max(apart), 4).alias("most_apart"))
