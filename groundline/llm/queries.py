"""Queries of the operators for training text: QUERIES by name, and SQL with the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import encode, lookalikes, main_body, mix, near_duplicates, sentences, site_lines, truncation
from groundline.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages whose texts differ but look the same."""
    return lookalikes.look_alike_pairs(table(spark, sf_dir, "page_docs"), "pd_id")


SQL["p1_found"] = lookalikes.look_alike_sql("page_docs", "pd_id")


@query
def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page text in its one consistent form."""
    return lookalikes.consistent(table(spark, sf_dir, "page_docs"), "pd_id").select("pd_id", "form")


SQL["p1_forms"] = f"SELECT pd_id, {lookalikes.form_sql()} AS form FROM (SELECT pd_id, {lookalikes.skeleton_sql()} AS skeleton FROM page_docs)"


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a large part of a site's pages have."""
    return site_lines.repeated_lines(table(spark, sf_dir, "page_docs"), "pd_id", "text", F.col("metadata")["source_url"])


SQL["p2_found"] = site_lines.site_lines_sql("page_docs", "pd_id", "text", "metadata['source_url']")


@query
def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page text without those lines."""
    pages = table(spark, sf_dir, "page_docs")
    return site_lines.without_repeated_lines(pages, "pd_id", "text", F.col("metadata")["source_url"]).select("pd_id", "text", "n_removed")


SQL["p2_texts"] = f"""WITH gone AS ({SQL['p2_found']}), g AS (SELECT pd_id, count(*) AS n, list(line_no) AS gone FROM gone GROUP BY pd_id)
SELECT pd_id, CASE WHEN g.n IS NULL THEN text ELSE array_to_string([x FOR x, i IN str_split(text, chr(10)) IF NOT list_contains(g.gone, i - 1)], chr(10)) END AS text, CAST(coalesce(g.n, 0) AS INTEGER) AS n_removed FROM page_docs LEFT JOIN g USING (pd_id)"""


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks that share at least half of their sequences of eight characters."""
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "chunks"))


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each chunk that has a near duplicate, and its number of links."""
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "chunks"))


#: Brute force: every shingle of every chunk, joined with itself.
_PAIRS = """WITH n AS (SELECT id, trim(regexp_replace(lower(text), '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{1680}]+', ' ', 'g')) AS t FROM chunks WHERE text IS NOT NULL),
d AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM n WHERE t <> '')),
s AS (SELECT DISTINCT k, substr(t, CAST(i AS BIGINT), 8) AS g FROM d, unnest(generate_series(1, length(t) - 7)) AS u(i)),
c AS (SELECT k, count(*) AS n FROM s GROUP BY k),
o AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.k < y.k GROUP BY x.k, y.k),
p AS (SELECT a, b FROM o JOIN c x ON x.k = a JOIN c y ON y.k = b WHERE o.n >= 0.5 * (x.n + y.n - o.n)),
m AS (SELECT id, k FROM n JOIN d USING (t)),
r AS (SELECT x.id AS i, y.id AS j FROM p JOIN m x ON x.k = a JOIN m y ON y.k = b UNION ALL SELECT x.id, y.id FROM m x JOIN m y ON x.k = y.k AND x.id < y.id)"""

SQL["p3_found"] = _PAIRS + " SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM r"


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of the sentence units of chunks and answers."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("rec_table"), F.col("id").alias("rec_id"), "text")
    answers = table(spark, sf_dir, "answers").select(F.lit("answers").alias("rec_table"), F.col("answer_id").cast("string").alias("rec_id"), "text")
    return sentences.sentence_units(chunks.unionByName(answers))


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode.encode(table(spark, sf_dir, "documents"))


@query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each occurs in it."""
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that are not main body."""
    lines = main_body.labelled_lines(table(spark, sf_dir, "page_docs"), table(spark, sf_dir, "line_labels"))
    return lines.where("NOT is_main").select("pd_id", "line_no")


@query
def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every page."""
    return main_body.main_bodies(table(spark, sf_dir, "page_docs"), table(spark, sf_dir, "line_labels"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lost their end."""
    return truncation.lost_ends(table(spark, sf_dir, "documents"))


@query
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source's documents lost their end."""
    return truncation.loss_rates(table(spark, sf_dir, "documents"))
