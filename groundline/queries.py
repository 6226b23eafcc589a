"""The catalogue of the core's queries: QUERIES by name, and SQL with the same result where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundline.functions import rules, text
from groundline.operators import answers, assemble, chunking, index, memory, search
from groundline.plans import pipeline
from groundline.runtime import shared_folder, table
from groundline.sources import documents as docs
from groundline.sources import html
from groundline.streaming import turns as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Expressions, the same in Spark and DuckDB, that put into whole columns what the tables lack, so that every rule meets cases and rows without any.
PLANTED = {
    "personal": "text || CASE doc_id % 9 WHEN 0 THEN ' Write to a.b@example.org.' WHEN 1 THEN ' PAN ABCDE1234F.' WHEN 2 THEN ' Call 9876543210 or +91 98765 43210.' WHEN 3 THEN ' The OTP is 123456.' WHEN 4 THEN ' folio no. 12345678' WHEN 5 THEN ' 1234 5678 9012' WHEN 6 THEN ' x@y.example,9876543210' ELSE '' END",
    "secret": "text || CASE doc_id % 11 WHEN 0 THEN ' key ghp_0123456789abcdefghij' WHEN 5 THEN ' sk-ABCDEFGHIJKLMNOPQRSTUV sk-short' ELSE '' END",
    "question": "question || CASE answer_id % 6 WHEN 0 THEN ' Should I invest?' WHEN 1 THEN ' My PAN is ABCDE1234F.' WHEN 2 THEN ' Which has the best returns?' ELSE '' END",
    "turn": "text || CASE WHEN conv_id % 3 = 0 AND turn % 4 = 1 THEN ' call 9876543210' ELSE '' END",
    "long": "CASE WHEN length(text) > 1500 THEN repeat(text, 150) ELSE text END",
    "rows": "repeat(text || chr(10), 12)",
    "cut_row": "'| ' || coalesce(section, '') || ' |' || chr(10) || '| ' || coalesce(section, '') || ' | ' || coalesce(doc_type, '') || ' |' || chr(10) || '| fetched | ' || coalesce(fetched_at, '') || ' |' || chr(10) || text",
    "citation": "CASE WHEN answer_id % 10 = 3 THEN coalesce(nullif(source_url, ''), 'http://planted.example/') || 'x' ELSE source_url END",
}


def planted(rows: DataFrame, column: str, case: str) -> DataFrame:
    return rows.withColumn(column, F.expr(PLANTED[case]))


# Sources and documents


@query(f"SELECT {text.strip_sql('url')} AS url, {text.strip_sql('scheme_name')} AS scheme_name, {text.strip_sql('scheme_category')} AS scheme_category, {text.strip_sql('doc_type')} AS doc_type FROM sources")
def src_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.source_rows(table(spark, sf_dir, "sources"))


_URLS = f"(SELECT {text.strip_sql('url')} AS url FROM sources)"


@query(f"SELECT DISTINCT url FROM {_URLS} WHERE regexp_matches(url, '(?i)^https?://[^/]')")
def src_public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.public(docs.source_rows(table(spark, sf_dir, "sources"))).select("url").distinct()


@query(f"SELECT CASE WHEN url = '' THEN 'blank' WHEN NOT regexp_matches(url, '(?i)^https?://[^/]') THEN 'not a web address' ELSE 'kept' END AS reason, count(*) AS n FROM {_URLS} GROUP BY 1")
def src_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.source_rows(table(spark, sf_dir, "sources")).groupBy(docs.reject_reason().alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN regexp_matches(url, '(?i)\\.pdf($|[?#])') THEN 'pdf' WHEN regexp_matches(url, '(?i)\\.html?($|[?#])') THEN 'html' WHEN regexp_matches(url, '(?i)^https?://') THEN 'page' ELSE 'none' END AS kind, count(*) AS n FROM {_URLS} GROUP BY 1")
def content_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.source_rows(table(spark, sf_dir, "sources")).groupBy(docs.content_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT pd_id, coalesce(metadata['scheme_name'], '') AS scheme_name, coalesce(metadata['scheme_category'], '') AS scheme_category, coalesce(metadata['doc_type'], '') AS doc_type, coalesce(metadata['source_url'], '') AS source_url, coalesce(metadata['fetched_at'], '') AS fetched_at FROM page_docs")
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.typed(table(spark, sf_dir, "page_docs")).drop("text")


@query(f"SELECT pd_id, {text.clean_lines_sql('text')} AS text FROM page_docs WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_docs").where("text IS NOT NULL").select("pd_id", text.clean_lines(F.col("text")).alias("text"))


@query(f"SELECT pd_id, CAST(least(length(text), 200000) AS INTEGER) AS n_chars, md5(substr(text, 1, 200000)) AS digest FROM (SELECT pd_id, {PLANTED['long']} AS text FROM page_docs) WHERE text IS NOT NULL AND trim(text) <> ''")
def doc_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.truncated(planted(table(spark, sf_dir, "page_docs"), "text", "long")).select("pd_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT pd_id, CASE WHEN {text.strip_sql('text')} = '' THEN 'no text' ELSE 'no source' END AS reason FROM page_docs WHERE {text.strip_sql('text')} = '' OR {text.strip_sql(chr(109) + 'etadata[' + chr(39) + 'source_url' + chr(39) + ']')} = ''")
def load_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.split(table(spark, sf_dir, "page_docs"))[1].select("pd_id", "reason")


@query("SELECT coalesce(metadata['doc_type'], '') AS doc_type, count(*) AS documents, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, min(length(text)) AS least, max(length(text)) AS most FROM page_docs GROUP BY 1")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return docs.typed(table(spark, sf_dir, "page_docs")).groupBy("doc_type").agg(F.count("*").alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.min(n).alias("least"), F.max(n).alias("most"))


@query(f"SELECT coalesce(source, '') AS source, CAST(sum(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, {rules.literal(rules.SECRET)})) END) AS BIGINT) AS secrets, count(*) AS documents FROM (SELECT source, {PLANTED['secret']} AS text FROM documents) GROUP BY 1")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.regexp_count("text", F.lit(rules.SECRET)), F.lit(0)).cast("long")
    return planted(table(spark, sf_dir, "documents"), "text", "secret").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(n).alias("secrets"), F.count("*").alias("documents"))


# Pages in HTML: made from the pages' lines, short ones as headings, rows as table rows, framed by what pages have around their content

_HEAD_LINE = "^[^#.|:<>&]{3,60}$"


def _as_html(rows: DataFrame) -> DataFrame:
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda x: F.concat(F.lit("<table><tr><td>"), F.replace(esc(x), F.lit(" | "), F.lit("</td><td>")), F.lit("</td></tr></table>"))
    word = lambda x: F.concat(F.lit("<p><b>"), F.left(esc(F.left(x, F.lit(1))), F.lit(9)), F.lit("</b>"), esc(F.substring(x, 2, 1_000_000)), F.lit("<p class='share-bar'>Share</p>"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(x.contains(" | "), row(x)).when(x.rlike(_HEAD_LINE), F.concat(F.lit("<h2>"), x, F.lit("</h2>"))).otherwise(word(x)))
    title = esc(F.coalesce(F.col("metadata")["scheme_name"], F.lit("")))
    page = F.concat(F.lit("<html><head><title>"), title, F.lit("</title><style>p {}</style></head><body><nav><li>Home<li>Funds</nav><div role='menu'>All funds</div>"), F.array_join(lines, ""), F.lit("<footer>Terms</footer></body></html>"))
    return rows.where("text IS NOT NULL").select("pd_id", page.alias("html"))


_SPACED = f"trim(regexp_replace(x, '[{text.WHITE}\\x{{001C}}-\\x{{001F}}]+', ' ', 'g'))"
_CELLS = f"array_to_string([c FOR c IN [{_SPACED} FOR x IN str_split(l, ' | ')] IF c <> ''], ' | ')"
_PAGE_LINES = f"""t AS (SELECT pd_id, nullif({_SPACED.replace('x,', "coalesce(metadata['scheme_name'], ''),", 1)}, '') AS title, str_split(text, chr(10)) AS lines FROM page_docs WHERE text IS NOT NULL),
h AS (SELECT pd_id, title, [CASE WHEN contains(l, ' | ') THEN {_CELLS} WHEN regexp_matches(l, '{_HEAD_LINE}') THEN CASE WHEN {_SPACED.replace('x,', 'l,', 1)} = '' THEN '' ELSE '## ' || {_SPACED.replace('x,', 'l,', 1)} END ELSE {_SPACED.replace('x,', 'l,', 1)} END FOR l IN lines] AS lines FROM t)"""


_WHOLE = "coalesce('# ' || title || chr(10), '') || array_to_string(lines, chr(10))"


@query(f"WITH {_PAGE_LINES} SELECT pd_id, {text.clean_lines_sql(_WHOLE)} AS text FROM h")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.with_text(_as_html(table(spark, sf_dir, "page_docs"))).select("pd_id", "text")


@query(f"WITH {_PAGE_LINES}, r AS (SELECT pd_id, unnest(lines) AS row FROM h) SELECT row, count(*) AS pages FROM (SELECT DISTINCT pd_id, row FROM r WHERE contains(row, ' | ')) GROUP BY row")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the pages' tables, and on how many pages each stands."""
    rows = html_text(spark, sf_dir).select("pd_id", F.explode(F.split("text", "\n")).alias("row")).where("contains(row, ' | ')")
    return rows.distinct().groupBy("row").agg(F.count("*").alias("pages"))


@query(f"WITH {_PAGE_LINES}, r AS (SELECT pd_id, unnest([l FOR l IN lines IF NOT contains(l, ' | ') AND regexp_matches(l, '{_HEAD_LINE}')]) AS heading FROM t) SELECT pd_id, count(*) AS headings, min(length(trim(heading))) AS shortest FROM r GROUP BY pd_id")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _as_html(table(spark, sf_dir, "page_docs")).select("pd_id", F.explode(html.headings(F.col("html"))).alias("h"))
    return found.groupBy("pd_id").agg(F.count("*").alias("headings"), F.min(F.length("h.text")).cast("long").alias("shortest"))


# Index


@query("SELECT id, substr(sha1(coalesce(source_url, '')), 1, 8) || '-' || chunk_index AS made_id FROM chunks")
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", index.chunk_id(F.col("source_url"), F.col("chunk_index")).alias("made_id"))


@query("SELECT made_id, count(*) AS n, min(id) AS first_id FROM (SELECT id, substr(sha1(coalesce(source_url, '')), 1, 8) || '-' || chunk_index AS made_id FROM chunks UNION ALL SELECT 'page ' || pd_id, substr(sha1(coalesce(metadata['source_url'], '')), 1, 8) || '-0' FROM page_docs) GROUP BY made_id HAVING count(*) > 1")
def id_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that clash among the chunks of the index and the first chunks of the pages."""
    made = table(spark, sf_dir, "chunks").select("id", index.chunk_id(F.col("source_url"), F.col("chunk_index")).alias("made_id"))
    pages = table(spark, sf_dir, "page_docs").select(F.concat(F.lit("page "), F.col("pd_id").cast("string")).alias("id"), index.chunk_id(F.col("metadata")["source_url"], F.lit("0")).alias("made_id"))
    return made.unionByName(pages).groupBy("made_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query(f"SELECT pd_id FROM page_docs WHERE {text.strip_sql(chr(109) + 'etadata[' + chr(39) + 'source_url' + chr(39) + ']')} = ''")
def citation_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.without_citation(docs.typed(table(spark, sf_dir, "page_docs"))).select("pd_id")


@query("SELECT pd_id, array_to_string(list_sort([k || '=' || metadata[k] FOR k IN map_keys(metadata) IF metadata[k] IS NOT NULL]), ';') AS metadata FROM page_docs")
def sanitize_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_docs").select("pd_id", index.flat_metadata(F.col("metadata")).alias("metadata"))


_CHECKS = "SELECT count(*) AS rows, count(*) - count(DISTINCT id) AS repeated_ids, count_if(coalesce(trim(source_url), '') = '') AS without_citation, count_if(embedding IS NULL) AS without_vector, CAST(count(DISTINCT len(embedding)) AS BIGINT) AS dimensions FROM chunks"


@query(_CHECKS)
def index_write_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.checks(table(spark, sf_dir, "chunks"))


@query("SELECT coalesce(scheme_name, '') AS entity, count(*) AS chunks, count(DISTINCT source_url) AS pages FROM chunks GROUP BY 1")
def index_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy(F.coalesce("scheme_name", F.lit("")).alias("entity")).agg(F.count("*").alias("chunks"), F.count_distinct("source_url").alias("pages"))


@query("SELECT id, section, length(text) AS chars FROM chunks ORDER BY id LIMIT 5")
def index_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").orderBy("id").limit(5).select("id", "section", F.length("text").cast("long").alias("chars"))


@query("WITH n AS (SELECT DISTINCT substr(sha1(trim(metadata['source_url'])), 1, 8) || '-0' AS id FROM page_docs WHERE coalesce(trim(metadata['source_url']), '') <> '' AND text <> ''), h AS (SELECT DISTINCT substr(sha1(coalesce(source_url, '')), 1, 8) || '-' || chunk_index AS id FROM chunks) SELECT n.id FROM n ANTI JOIN h USING (id)")
def index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = docs.typed(table(spark, sf_dir, "page_docs")).where("trim(source_url) <> '' AND text <> ''").select(index.chunk_id(F.trim("source_url"), F.lit("0")).alias("id")).distinct()
    have = table(spark, sf_dir, "chunks").select(index.chunk_id(F.col("source_url"), F.col("chunk_index")).alias("id"))
    return index.to_append(new, have)


@query()
def index_append_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of the usable pages that the index does not have, by its address and number."""
    made = index.page_chunks(docs.typed(table(spark, sf_dir, "page_docs")))
    have = table(spark, sf_dir, "chunks").select(index.chunk_id(F.col("source_url"), F.col("chunk_index")).alias("id"))
    return index.to_append(made, have)


_USABLE = "FROM chunks WHERE coalesce(trim(source_url), '') <> '' AND embedding IS NOT NULL"


@query(f"SELECT coalesce(scheme_name, '') AS entity, count(*) AS chunks, count_if(chunk_index = '0') AS first_chunks, round(sum(sqrt(list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])]))), 2) AS norms {_USABLE} GROUP BY 1")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written with the first chunk of each page, grown by all chunks (those it has are left out), and opened again."""
    rows = table(spark, sf_dir, "chunks").where("coalesce(trim(source_url), '') <> '' AND embedding IS NOT NULL")
    path = f"{shared_folder(spark)}/index_{uuid.uuid4().hex}"
    index.write(rows.where("chunk_index = '0'"), path)
    index.append(rows, path)
    index.append(rows, path)
    n = index.opened(spark, path).groupBy("entity").agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_index") == "0").alias("first_chunks"), F.round(F.sum("norm"), 2).alias("norms"))
    return n


@query()
def embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.embedded(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT count(*) AS pairs, round(min(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 2)))), 4) AS least_cosine, round(max(list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x - round(x, 2))))), 4) AS most_apart FROM embeddings")
def embed_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors against a coarser form of themselves: least cosine and largest difference."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(v.alias("a"), F.transform(v, lambda x: F.round(x, 2)).alias("b"))
    return index.equivalence(rows)


# Search: queries are the vectors whose id is divisible by 50, the entity is the label


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("e"), F.col("label").cast("string")).alias("entity"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("id % 50 = 0")


def _named(v: DataFrame) -> DataFrame:
    """Every third query names no entity, every seventh one that does not exist."""
    n = F.col("id") / 50
    return v.withColumn("entity", F.when(n % 3 == 0, "").when(n % 7 == 0, "e99").otherwise(F.col("entity")))


_V = "v AS (SELECT vec_id AS id, 'e' || label AS entity, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
_Q = "q AS (SELECT * FROM v WHERE id % 50 = 0)"
_QN = "q AS (SELECT id, CASE WHEN (id / 50) % 3 = 0 THEN '' WHEN (id / 50) % 7 = 0 THEN 'e99' ELSE entity END AS entity, vector FROM v WHERE id % 50 = 0)"


def _top_sql(q: str = "q", on: str = "true", k: int = 5) -> str:
    return f"SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(raw, 4) AS similarity, entity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 4) DESC, round(raw, 8) DESC, id) AS rank FROM (SELECT {q}.id AS qid, v.id, v.entity, list_cosine_similarity({q}.vector, v.vector) AS raw FROM {q} JOIN v ON {on})) WHERE rank <= {k}"


@query(f"WITH {_V}, {_Q} {_top_sql()}")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_asked(spark, sf_dir), _vectors(spark, sf_dir))


@query(f"WITH {_V}, {_Q} {_top_sql(on='q.entity = v.entity')}")
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_asked(spark, sf_dir), _vectors(spark, sf_dir), mode="same")


_NAMED_ON = "(q.entity = '' OR q.entity = v.entity)"


@query(f"WITH {_V}, {_QN} {_top_sql(on=_NAMED_ON)}")
def topk_conditional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_named(_asked(spark, sf_dir)), _vectors(spark, sf_dir), mode="named")


_FALLBACK = f"{_V}, {_QN}, a AS ({_top_sql(on=_NAMED_ON)}), m AS (SELECT * FROM q WHERE id NOT IN (SELECT qid FROM a)), hits AS (SELECT *, false AS fell_back FROM a UNION ALL SELECT *, true AS fell_back FROM ({_top_sql('m')}))"


@query(f"WITH {_FALLBACK} SELECT * FROM hits")
def topk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_fallback(_named(_asked(spark, sf_dir)), _vectors(spark, sf_dir))


@query(f"WITH {_V}, {_Q}, hits AS ({_top_sql(on='q.entity = v.entity', k=100)}) SELECT qid, count(*) AS n, CAST(count(*) < 100 AS BOOLEAN) AS thin FROM hits GROUP BY qid")
def topk_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered search is never topped up from other entities."""
    return search.top_k(_asked(spark, sf_dir), _vectors(spark, sf_dir), k=100, mode="same").groupBy("qid").agg(F.count("*").alias("n"), (F.count("*") < 100).alias("thin"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the search with fallback; label 0 is the general entity."""
    return search.with_fallback(_named(_asked(spark, sf_dir)), _vectors(spark, sf_dir)).withColumn("entity", F.when(F.col("entity") == "e0", "general").otherwise(F.col("entity")))


_HITS = f"{_FALLBACK}, h AS (SELECT qid, rank, id, similarity, CASE WHEN entity = 'e0' THEN 'general' ELSE entity END AS entity, fell_back FROM hits)"


@query(f"WITH {_HITS} SELECT qid, count(*) AS hits, count_if(entity IN ('', 'general')) AS general FROM h GROUP BY qid")
def hits_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("hits"), F.count_if(assemble.is_general(F.col("entity"))).alias("general"))


@query("SELECT id, regexp_replace(concat_ws(' | ', coalesce(scheme_name, ''), coalesce(section, '')), '^[ |]+|[ |]+$', '', 'g') AS label FROM chunks")
def hit_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", assemble.label(F.col("scheme_name"), F.col("section")).alias("label"))


@query(f"WITH {_HITS} SELECT qid, id AS cited, entity, similarity FROM h WHERE rank = 1")
def citation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).where("rank = 1").select("qid", F.col("id").alias("cited"), "entity", "similarity")


@query(f"WITH {_HITS}, t AS (SELECT h.qid, h.rank, '[' || h.rank || '] ' || regexp_replace(concat_ws(' | ', h.entity, coalesce(d.source, '')), '^[ |]+|[ |]+$', '', 'g') || chr(10) || coalesce(d.text, '') || chr(10) || 'source: ' || coalesce(d.source, '') || chr(10) || 'fetched_at: ' || coalesce(strftime(d.fetched_at, '%Y-%m-%d'), '') AS block FROM h LEFT JOIN documents d ON d.doc_id = h.id) SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY qid")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits' documents (by equal id) as one context a question."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source_url"), F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("")).alias("fetched_at"))
    h = _hits(spark, sf_dir).join(d, "id", "left").na.fill("", ["text", "source_url", "fetched_at"])
    return assemble.context_blocks(h.withColumn("label", assemble.label(F.col("entity"), F.col("source_url"))))


_ASSEMBLE = f"""{_HITS}, n AS (SELECT id AS qid, CASE WHEN entity = '' THEN [] WHEN (id / 50) % 5 = 0 THEN [entity, 'e98'] ELSE [entity] END AS named FROM q),
p AS (SELECT qid, max(similarity) AS best, min_by(id, rank) AS cited, min_by(entity, rank) AS first_entity, list_sort(list_distinct(list(entity) FILTER (WHERE entity NOT IN ('', 'general')))) AS present, bool_or(fell_back) AS fell_back FROM h GROUP BY qid),
r AS (SELECT n.qid, best, cited, CASE WHEN best IS NULL THEN ['no hits'] ELSE list_filter([CASE WHEN best < 0.45 THEN 'below floor' END, CASE WHEN len(named) > 1 THEN 'names ' || len(named) || ' entities' END, CASE WHEN len(named) = 1 AND len(coalesce(present, [])) > 0 AND NOT list_contains(present, named[1]) THEN 'other entities' END, CASE WHEN len(named) = 0 AND first_entity NOT IN ('', 'general') AND len(coalesce(present, [])) > 1 THEN 'spans ' || len(present) || ' entities' END, CASE WHEN fell_back THEN 'fell back' END], lambda x: x IS NOT NULL) END AS reasons FROM n LEFT JOIN p USING (qid))"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") / 50
    named = F.when(F.col("entity") == "", F.array().cast("array<string>")).when(n % 5 == 0, F.array("entity", F.lit("e98"))).otherwise(F.array("entity"))
    return _named(_asked(spark, sf_dir)).select(F.col("id").alias("qid"), named.alias("named"))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assembled(_questions(spark, sf_dir), _hits(spark, sf_dir))


@query(f"WITH {_ASSEMBLE} SELECT qid, coalesce(best, 0) AS best, cited, len(reasons) > 0 AS weak, array_to_string(reasons, ',') AS reasons FROM r")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)


@query(f"WITH {_ASSEMBLE} SELECT qid, 'max_similarity=' || printf('%.3f', coalesce(best, 0)) || CASE WHEN len(reasons) > 0 THEN ' weak=' || array_to_string(reasons, ',') ELSE ' strong' END AS summary FROM r")
def assemble_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).select("qid", assemble.summary().alias("summary"))


@query(f"WITH {_ASSEMBLE} SELECT u.reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) u GROUP BY u.reason")
def weak_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).select(F.explode(F.split("reasons", ",")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_V}, {_Q}, hits AS ({_top_sql(k=2)}) SELECT q.entity AS class, count(*) AS questions, min(similarity) AS least, max(similarity) AS most FROM hits JOIN q ON q.id = qid WHERE rank = 2 GROUP BY 1")
def floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the best similarity with another vector, by class of question."""
    q = _asked(spark, sf_dir)
    second = search.top_k(q, _vectors(spark, sf_dir), k=2).where("rank = 2").select("qid", "similarity")
    return second.join(q.select(F.col("id").alias("qid"), F.col("entity").alias("class")), "qid").groupBy("class").agg(F.count("*").alias("questions"), F.min("similarity").alias("least"), F.max("similarity").alias("most"))


@query()
def topk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks nearest to every fiftieth question, by hashed words (hash function without a twin in SQL)."""
    asked = index.embedded(table(spark, sf_dir, "answers").where("answer_id % 50 = 0 AND question IS NOT NULL"), "answer_id", "question")
    numbered = table(spark, sf_dir, "chunks").select(F.xxhash64("id").alias("key"), F.concat_ws(" ", "scheme_name", "section", "text").alias("text"))
    q = asked.select(F.col("answer_id").alias("id"), F.lit("").alias("entity"), F.col("embedding").alias("vector"))
    v = index.embedded(numbered, "key", "text").select(F.col("key").alias("id"), F.lit("").alias("entity"), F.col("embedding").alias("vector"))
    return search.top_k(q, v).drop("entity")


# Guards

_DOCS = f"(SELECT doc_id, {PLANTED['personal']} AS text FROM documents WHERE text IS NOT NULL)"


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "personal")



@query(f"SELECT doc_id, array_to_string(list_sort({rules.matches_sql('text', rules.PERSONAL)}), ',') AS kinds FROM {_DOCS} WHERE len({rules.matches_sql('text', rules.PERSONAL)}) > 0")
def pii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.matches(F.col("text"), rules.PERSONAL)
    return _personal(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(found), ",").alias("kinds")).where("kinds <> ''")


@query(f"SELECT kind, count(*) AS n FROM (SELECT unnest({rules.matches_sql('text', rules.PERSONAL)}) AS kind FROM {_DOCS}) GROUP BY kind")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select(F.explode(rules.matches(F.col("text"), rules.PERSONAL)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {rules.redact_sql('text')} AS text FROM {_DOCS}")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("doc_id", rules.redact(F.col("text")).alias("text"))


_QUESTIONS = f"(SELECT answer_id, mode, text, source_url, last_updated, scheme_name, {PLANTED['question']} AS question FROM answers)"


@query(f"SELECT answer_id, {rules.verdict_sql('question')} AS verdict FROM {_QUESTIONS}")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(table(spark, sf_dir, "answers"), "question", "question").select("answer_id", rules.verdict(F.col("question")).alias("verdict"))


_GUARDED = ("mode", "text", "source_url", "last_updated", "scheme_name", "reason")


@query(f"SELECT answer_id, to_json(struct_pack(mode := CASE WHEN v = 'allow' THEN coalesce(mode, '') ELSE 'refuse' END, " + ", ".join(f"{c} := CASE WHEN v = 'allow' THEN coalesce({c}, '') ELSE '' END" for c in _GUARDED[1:-1]) + f", reason := CASE WHEN v = 'allow' THEN '' ELSE v END)) AS payload FROM (SELECT *, {rules.verdict_sql('question')} AS v FROM {_QUESTIONS})")
def guard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload after the guard: what is blocked is a refusal with the verdict for its reason, without text, citation and date; the rest passes."""
    return answers.guarded(planted(table(spark, sf_dir, "answers"), "question", "question"), rules.verdict(F.col("question"))).select("answer_id", answers.payload(_GUARDED).alias("payload"))


_BAD = f"mode = 'refuse' AND (coalesce(trim(source_url), '') <> '' OR coalesce(trim(last_updated), '') <> '' OR coalesce(reason, '') = '') OR mode = 'fact' AND {text.strip_sql('source_url')} = ''"


_CITED = f"(SELECT answer_id, mode, reason, last_updated, {PLANTED['citation']} AS source_url FROM answers)"


@query(f"SELECT answer_id, mode FROM {_CITED} WHERE {_BAD}")
def refusal_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.broken(planted(table(spark, sf_dir, "answers"), "source_url", "citation")).select("answer_id", "mode")


@query(f"SELECT scheme_name, {text.display_name_sql('scheme_name')} AS display_name, count(*) AS n FROM chunks GROUP BY 1, 2")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy("scheme_name", text.display_name(F.col("scheme_name")).alias("display_name")).agg(F.count("*").alias("n"))


_PAYLOAD = ("mode", "text", "source_url", "last_updated", "scheme_name", "reason")


@query("SELECT answer_id, to_json(struct_pack(" + ", ".join(f"{c} := coalesce({c}, '')" for c in _PAYLOAD) + ")) AS payload FROM answers")
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").select("answer_id", answers.payload(_PAYLOAD).alias("payload"))


# Conversations

_ALIAS = f"al AS (SELECT alias, max(entity) AS entity FROM (SELECT {text.entity_key_sql('scheme_name')} AS alias, {text.display_name_sql('scheme_name')} AS entity FROM sources WHERE scheme_name IS NOT NULL) WHERE alias NOT IN ('', 'general') GROUP BY alias)"
_TURNS = f"u AS (SELECT DISTINCT conv_id, turn, {text.strip_sql('text')} AS text FROM chat_turns WHERE role = 'user')"
_FOUND = "e AS (SELECT DISTINCT conv_id, turn, text, alias, entity FROM (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}]+'), ' ') || ' ' AS said FROM u) JOIN al ON contains(said, ' ' || alias || ' '))"


@query(f"WITH {_ALIAS}, {_TURNS}, {_FOUND} SELECT conv_id, turn, array_to_string(list_sort(list(DISTINCT entity)), ', ') AS entities FROM e GROUP BY conv_id, turn")
def detect_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = memory.named_entities(memory.user_turns(table(spark, sf_dir, "chat_turns")), memory.entities(table(spark, sf_dir, "sources")), ["conv_id", "turn"])
    return found.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_set("entity")), ", ").alias("entities"))


@query(f"WITH {_TURNS} SELECT * FROM u")
def history_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.user_turns(table(spark, sf_dir, "chat_turns"))


_CLEAN = " AND ".join(f"NOT regexp_matches(text, {rules.alone_sql(p)})" for _, p in rules.PERSONAL)


_PLANTED_TURNS = f"u AS (SELECT DISTINCT conv_id, turn, {text.strip_sql('text')} AS text FROM (SELECT conv_id, turn, role, {PLANTED['turn']} AS text FROM chat_turns) WHERE role = 'user')"


@query(f"WITH {_PLANTED_TURNS} SELECT conv_id, turn, text, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS back FROM u WHERE text <> '' AND {_CLEAN}) WHERE back <= 4")
def memory_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four turns without personal data."""
    return memory.screened(planted(table(spark, sf_dir, "chat_turns"), "text", "turn"), 4).select("conv_id", "turn", "text", "back")


_RESOLVED = f"""{_ALIAS}, {_TURNS}, {_FOUND}, o AS (SELECT u.conv_id, u.turn, u.text, list_sort(list(DISTINCT entity) FILTER (WHERE entity IS NOT NULL)) AS own FROM u LEFT JOIN e USING (conv_id, turn, text) GROUP BY ALL),
k AS (SELECT *, coalesce(len(own), 0) AS n_own, text <> '' AND {_CLEAN} AS clean FROM o),
w AS (SELECT *, coalesce(sum(CAST(clean AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM k),
d AS (SELECT *, last_value(CASE WHEN clean AND n_own = 1 THEN own[1] END IGNORE NULLS) OVER x AS donor, last_value(CASE WHEN clean AND n_own = 1 THEN nth + 1 END IGNORE NULLS) OVER x AS donated FROM w WINDOW x AS (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT conv_id, turn, text, CASE WHEN n_own > 0 THEN array_to_string(own, ', ') WHEN donated > nth - 10 THEN donor ELSE '' END AS entity, CASE WHEN n_own > 0 THEN 'question' WHEN donated > nth - 10 THEN 'memory' ELSE 'none' END AS origin FROM d)"""


@query(f"WITH {_RESOLVED} SELECT * FROM r")
def memory_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.resolved(table(spark, sf_dir, "chat_turns"), memory.entities(table(spark, sf_dir, "sources")))


@query(f"WITH {_RESOLVED} SELECT origin, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM r GROUP BY origin")
def memory_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_resolve(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))


@query(f"WITH {_RESOLVED} SELECT conv_id, turn, text AS question, CASE WHEN origin = 'memory' THEN text || ' ' || entity ELSE text END AS query_text FROM r")
def query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = memory_resolve(spark, sf_dir)
    return r.select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("origin") == "memory", F.concat_ws(" ", "text", "entity")).otherwise(F.col("text")).alias("query_text"))


@query(f"WITH {_RESOLVED} SELECT conv_id, turn, 'Question: ' || text || chr(10) || 'Source: ' AS message, contains(text, entity) AS named FROM r WHERE origin = 'memory'")
def memory_prompt_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message to a model holds the question as asked; an entity from memory goes into the query text only."""
    r = memory_resolve(spark, sf_dir).where("origin = 'memory'")
    return r.select("conv_id", "turn", answers.user_message(F.col("text"), F.lit("")).alias("message"), F.col("text").contains(F.col("entity")).alias("named"))


# Chunking

_LINES = "SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL"


@query(f"WITH l AS ({_LINES}), f AS (SELECT *, contains(line, ' | ') AS is_table, {text.strip_sql('line')} = '' AS blank FROM l), s AS (SELECT *, CASE WHEN blank OR is_table <> lag(is_table) OVER w OR lag(blank) OVER w OR lag(line_no) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM s) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INTEGER) AS block_no, is_table, body FROM (SELECT doc_id, block, bool_or(is_table) AS is_table, string_agg(line, chr(10) ORDER BY line_no) AS body FROM g WHERE NOT blank GROUP BY doc_id, block)")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.blocks(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")


def _packed(column: Column) -> Column:
    return F.array_join(column, "\x1e")


@query(f"SELECT doc_id, {text.pack_sql('rows', '512', chr(10))} AS pieces FROM (SELECT doc_id, list_filter(str_split(text, chr(10)), lambda x: contains(x, ' | ')) AS rows FROM (SELECT doc_id, {PLANTED['rows']} AS text FROM documents WHERE text IS NOT NULL))")
def pack_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.filter(F.split("text", "\n"), lambda x: x.contains(" | "))
    return planted(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "rows").select("doc_id", _packed(text.pack(rows, 512, "\n")).alias("pieces"))


@query(f"SELECT doc_id, {text.pack_sql('w', '120', ' ')} AS pieces FROM (SELECT doc_id, list_filter(str_split_regex(text, '[{text.WHITE}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)")
def hard_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _packed(chunking.wrapped(F.col("text"), 120)).alias("pieces"))


@query()
def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document in pieces of at most 512 characters (the splitting needs lookaround, which the checking SQL lacks)."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(text.pack(text.sentences(F.col("text")), 512, " ")).alias("piece_no", "piece"))


@query("SELECT id, CAST(greatest(120, 512 - length(concat_ws(' | ', coalesce(scheme_name, 'general'), coalesce(section, 'overview'))) - 1) AS INTEGER) AS cap FROM chunks")
def chunk_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", chunking.cap(F.coalesce("scheme_name", F.lit("general")), F.coalesce("section", F.lit("overview"))).alias("cap"))


@query()
def overlap_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", chunking.trim_partial_row(text.overlap_tail(F.col("text"))).alias("tail"))


#: Short lines without a full stop, a bar or a colon become headings.
_SHORT = "(?m)^([^#.|:\n]{3,60})$"
_HEADED = f"(SELECT doc_id, regexp_replace(text, '{_SHORT}', '# \\1', 'g') AS text FROM documents)"
_HEADED_LINES = _LINES.replace("FROM documents", f"FROM {_HEADED}")
_TITLE = r"regexp_extract(line, '^#{1,6}\s+(\S.*?)\s*$', 1)"


@query(f"WITH l AS ({_HEADED_LINES}), t AS (SELECT *, nullif({_TITLE}, '') AS title FROM l), h AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER w, 'overview') AS heading, count(title) OVER w AS part FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), b AS (SELECT doc_id, part, heading, {text.strip_sql('string_agg(line, chr(10) ORDER BY line_no)')} AS body FROM h WHERE title IS NULL GROUP BY doc_id, part, heading) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section_no, heading, body FROM b WHERE body <> ''")
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = F.regexp_replace("text", _SHORT.replace("(?m)", "(?md)"), "# $1")
    return chunking.sections(table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("text", headed), "doc_id", "text")


_BAR_ROWS = f"list_filter([{text.strip_sql('x')} FOR x IN str_split(text, chr(10))], lambda x: starts_with(x, '|') AND ends_with(x, '|'))"
_BARS = "length({0}) - length(replace({0}, '|', ''))"


@query(f"SELECT id, CASE WHEN contains(text, chr(10)) AND len(rows) >= 2 AND starts_with(first, '|') AND {_BARS.format('first')} < list_sort([{_BARS.format('x')} FOR x IN rows])[len(rows) // 2 + 1] THEN {text.strip_sql('array_to_string(str_split(text, chr(10))[2:], chr(10))')} ELSE text END AS text FROM (SELECT id, text, {_BAR_ROWS} AS rows, {text.strip_sql('str_split(text, chr(10))[1]')} AS first FROM (SELECT id, {PLANTED['cut_row']} AS text FROM chunks) WHERE text IS NOT NULL)")
def trim_partial_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(table(spark, sf_dir, "chunks"), "text", "cut_row").where("text IS NOT NULL").select("id", chunking.trim_partial_row(F.col("text")).alias("text"))


@query()
def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.units(docs.typed(table(spark, sf_dir, "page_docs")), "pd_id", "text", "scheme_name")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' texts in chunks of at most 512 characters with their section, number and count; chunks under 400 take what fits from the next."""
    return chunking.chunked(docs.typed(table(spark, sf_dir, "page_docs")), "pd_id", "text", "scheme_name")


@query("SELECT id, CAST(row_number() OVER (PARTITION BY source_url ORDER BY CAST(chunk_index AS INTEGER), id) - 1 AS INTEGER) AS nth, count(*) OVER (PARTITION BY source_url) AS of, CAST(chunk_index AS INTEGER) AS chunk_index FROM chunks")
def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("source_url")
    i = F.col("chunk_index").cast("int")
    return table(spark, sf_dir, "chunks").select("id", (F.row_number().over(w.orderBy(i, "id")) - 1).alias("nth"), F.count("*").over(w).alias("of"), i.alias("chunk_index"))


@query("SELECT count(*) AS chunks, min(length(text)) AS least, max(length(text)) AS most, CAST(quantile_disc(length(text), 0.5) AS BIGINT) AS median, count_if(length(text) < 400) AS under_400, count_if(length(text) > 512) AS over_512 FROM chunks")
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "chunks").select(n.alias("n")).agg(F.count("*").alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("median"), F.count_if(F.col("n") < 400).alias("under_400"), F.count_if(F.col("n") > 512).alias("over_512"))


@query(f"SELECT {text.display_name_sql('scheme_name')} AS entity, count(*) AS chunks, row_number() OVER (ORDER BY count(*) DESC, {text.display_name_sql('scheme_name')}) AS place FROM chunks GROUP BY 1")
def chunk_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by their number of chunks. The place is the number of entities with more chunks (a window over the different numbers, few of them) and the place among those with as many."""
    n = table(spark, sf_dir, "chunks").groupBy(text.display_name(F.col("scheme_name")).alias("entity")).agg(F.count("*").alias("chunks"))
    more = n.groupBy("chunks").agg(F.count("*").alias("entities"))
    more = more.withColumn("before", F.coalesce(F.sum("entities").over(W.orderBy(F.col("chunks").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    alike = F.row_number().over(W.partitionBy("chunks").orderBy("entity"))
    return n.join(more.select("chunks", "before"), "chunks").select("entity", "chunks", (F.col("before") + alike).cast("long").alias("place"))


@query("WITH c AS (SELECT id, source_url, CAST(chunk_index AS INTEGER) AS i, list_distinct(str_split(text, chr(10))[2:]) AS lines FROM chunks WHERE text IS NOT NULL), p AS (SELECT id, lines, lag(id) OVER w AS before, lag(lines) OVER w AS earlier FROM c WINDOW w AS (PARTITION BY source_url ORDER BY i, id)) SELECT before AS first_id, id AS second_id, CAST(len(list_intersect(lines, earlier)) AS INTEGER) AS shared FROM p WHERE before IS NOT NULL")
def chunk_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that neighbouring chunks of a page share, their first lines left out."""
    lines = F.split("text", "\n")
    c = table(spark, sf_dir, "chunks").where("text IS NOT NULL").select("id", "source_url", F.col("chunk_index").cast("int").alias("i"), F.array_distinct(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).alias("lines"))
    w = W.partitionBy("source_url").orderBy("i", "id")
    p = c.select("id", "lines", F.lag("id").over(w).alias("first_id"), F.lag("lines").over(w).alias("earlier")).where("first_id IS NOT NULL")
    return p.select("first_id", F.col("id").alias("second_id"), F.size(F.array_intersect("lines", "earlier")).alias("shared"))


# Answers


@query("SELECT answer_id, coalesce(question, '') AS question, 'Question: ' || coalesce(question, '') || chr(10) || 'Source: ' || coalesce(source_url, '') AS message FROM answers")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers")
    return a.select("answer_id", F.coalesce("question", F.lit("")).alias("question"), answers.user_message(F.col("question"), F.col("source_url")).alias("message"))


@query(f"WITH c AS (SELECT source_url, string_agg('[' || nth || '] ' || text, chr(10) || chr(10) ORDER BY nth) AS context FROM (SELECT source_url, text, row_number() OVER (PARTITION BY source_url ORDER BY CAST(chunk_index AS INTEGER), id) AS nth FROM chunks WHERE text IS NOT NULL AND coalesce(trim(source_url), '') <> '') WHERE nth <= 5 GROUP BY source_url) SELECT answer_id, to_json([struct_pack(role := 'system', content := {rules.literal(answers.SYSTEM)}), struct_pack(role := 'user', content := 'CONTEXT' || chr(10) || '--------' || chr(10) || context || chr(10) || '--------' || chr(10) || chr(10) || 'QUESTION: ' || question)]) AS messages FROM answers JOIN c USING (source_url) WHERE question IS NOT NULL")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages to a model: its duties, then the first five chunks of the cited page in a fence and the question below it."""
    c = table(spark, sf_dir, "chunks").where("text IS NOT NULL AND coalesce(trim(source_url), '') <> ''")
    nth = F.row_number().over(W.partitionBy("source_url").orderBy(F.col("chunk_index").cast("int"), "id"))
    blocks = c.withColumn("nth", nth).where("nth <= 5").groupBy("source_url").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("] "), "text").alias("block")))).alias("blocks"))
    context = blocks.select("source_url", F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n").alias("context"))
    return table(spark, sf_dir, "answers").where("question IS NOT NULL").join(context, "source_url").select("answer_id", answers.messages(F.col("question"), F.col("context")).alias("messages"))


@query(f"SELECT answer_id, {text.strip_sql('text')} = '' OR regexp_matches(coalesce(text, ''), {rules.literal(rules.DECLINED)}) AS declined FROM answers")
def decline_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").select("answer_id", answers.declined(F.col("text")).alias("declined"))


@query(f"SELECT answer_id, {answers.clean_sql('text')} AS text FROM answers WHERE text IS NOT NULL")
def clean_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").where("text IS NOT NULL").select("answer_id", answers.clean(F.col("text")).alias("text"))


@query("SELECT answer_id, NOT regexp_matches(coalesce(text, ''), '\\p{L}') AS prose_free FROM answers")
def prose_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").select("answer_id", (~F.coalesce("text", F.lit("")).rlike(r"\p{L}")).alias("prose_free"))


@query()
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").where("text IS NOT NULL").select("answer_id", F.posexplode(answers.sentences(F.col("text"))).alias("nth", "sentence"))


@query()
def clamp_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "answers").where("text IS NOT NULL").select("answer_id", F.array_join(F.slice(answers.sentences(F.col("text")), 1, 3), " ").alias("text"))


@query(f"SELECT answer_id, array_to_string(list_sort({answers.numbers_sql('text')}), ';') AS numbers, array_to_string(list_sort({answers.numbers_sql('text', True)}), ';') AS figures FROM answers WHERE text IS NOT NULL")
def numbers_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each answer, and those with a unit."""
    joined = lambda unit: F.array_join(F.array_sort(answers.numbers(F.col("text"), unit)), ";")
    return table(spark, sf_dir, "answers").where("text IS NOT NULL").select("answer_id", joined(False).alias("numbers"), joined(True).alias("figures"))


@query(f"WITH a AS (SELECT DISTINCT answer_id, {text.strip_sql('source_url')} AS url, {answers.numbers_sql('text', True)} AS figures, unnest({answers.numbers_sql('text')}) AS number FROM answers WHERE mode = 'fact'), c AS (SELECT DISTINCT source_url AS url, unnest({answers.numbers_sql('text')}) AS number FROM chunks) SELECT answer_id, number FROM a ANTI JOIN c USING (url, number) WHERE contains(number, '.') OR length(number) >= 3 OR list_contains(figures, number)")
def ungrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of factual answers that stand in no chunk of the page they cite."""
    return answers.ungrounded(table(spark, sf_dir, "answers").where("mode = 'fact'"), table(spark, sf_dir, "chunks"))


@query()
def answer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn through guard, memory, search, assembly and post-checks; the reply quotes the cited chunk."""
    return pipeline.answered(table(spark, sf_dir, "chat_turns"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "sources"))


@query()
def trace_stopped_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which stage the turns of the pipeline stopped."""
    return answer_pipeline(spark, sf_dir).groupBy("stopped_at", "reason").agg(F.count("*").alias("n"))


# Relations between answers, pages and sources

_PAGES = f"(SELECT url, max({text.display_name_sql('scheme_name')}) AS owner FROM (SELECT {text.strip_sql('url')} AS url, scheme_name FROM sources) WHERE url <> '' GROUP BY url)"


@query(f"SELECT answer_id, {text.strip_sql('source_url')} AS url, owner FROM answers a LEFT JOIN {_PAGES} p ON p.url = {text.strip_sql('a.source_url')}")
def url_owner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers").select("answer_id", text.strip("source_url").alias("url"))
    return a.join(docs.owners(table(spark, sf_dir, "sources")), "url", "left").select("answer_id", "url", "owner")


@query(f"SELECT answer_id FROM answers a SEMI JOIN {_PAGES} p ON p.url = {text.strip_sql('a.source_url')}")
def citation_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "answers").select("answer_id", text.strip("source_url").alias("url"))
    return a.join(docs.owners(table(spark, sf_dir, "sources")), "url", "left_semi").select("answer_id")


@query(f"SELECT answer_id, {text.strip_sql('source_url')} AS url FROM {_CITED} a ANTI JOIN {_PAGES} p ON p.url = {text.strip_sql('a.source_url')} WHERE mode = 'fact'")
def citation_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = planted(table(spark, sf_dir, "answers"), "source_url", "citation").where("mode = 'fact'").select("answer_id", text.strip("source_url").alias("url"))
    return a.join(docs.owners(table(spark, sf_dir, "sources")), "url", "left_anti").select("answer_id", "url")


_GRADE = f"g AS (SELECT answer_id, {text.display_name_sql('scheme_name')} AS wanted, CASE WHEN mode <> 'fact' THEN 'refused' WHEN {text.strip_sql('source_url')} = '' THEN 'no url' WHEN owner IS NULL THEN 'unknown url' WHEN lower(owner) <> lower({text.display_name_sql('scheme_name')}) THEN 'other entity' WHEN NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') THEN 'bare figure' ELSE 'ok' END AS grade FROM answers a LEFT JOIN {_PAGES} p ON p.url = {text.strip_sql('a.source_url')})"


@query(f"WITH {_GRADE} SELECT answer_id, grade FROM g")
def citation_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.graded(table(spark, sf_dir, "answers"), docs.owners(table(spark, sf_dir, "sources"))).select("answer_id", "grade")


@query(f"WITH {_GRADE} SELECT wanted, count(*) AS answers, count_if(grade = 'ok') AS ok, round(count_if(grade = 'ok') / count(*), 4) AS rate FROM g GROUP BY wanted")
def citation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = answers.graded(table(spark, sf_dir, "answers"), docs.owners(table(spark, sf_dir, "sources")))
    return g.groupBy("wanted").agg(F.count("*").alias("answers"), F.count_if(F.col("grade") == "ok").alias("ok")).withColumn("rate", F.round(F.col("ok") / F.col("answers"), 4))


@query(f"SELECT url, min(origin) AS origin FROM (SELECT {text.strip_sql('url')} AS url, 'sources' AS origin FROM sources UNION ALL SELECT {text.strip_sql('source_url')}, 'chunks' FROM chunks) WHERE url <> '' GROUP BY url")
def allowlist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sources").select(text.strip("url").alias("url"), F.lit("sources").alias("origin"))
    c = table(spark, sf_dir, "chunks").select(text.strip("source_url").alias("url"), F.lit("chunks").alias("origin"))
    return s.unionByName(c).where("url <> ''").groupBy("url").agg(F.min("origin").alias("origin"))


@query(f"SELECT url, 'only chunks' AS side FROM (SELECT {text.strip_sql('source_url')} AS url FROM chunks EXCEPT SELECT {text.strip_sql('url')} FROM sources) UNION ALL SELECT url, 'only sources' FROM (SELECT {text.strip_sql('url')} AS url FROM sources EXCEPT SELECT {text.strip_sql('source_url')} FROM chunks)")
def corpus_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the chunks that the source list does not have, and the other way round."""
    c = table(spark, sf_dir, "chunks").select(text.strip("source_url").alias("url"))
    u = table(spark, sf_dir, "sources").select(text.strip("url").alias("url"))
    return c.subtract(u).withColumn("side", F.lit("only chunks")).unionByName(u.subtract(c).withColumn("side", F.lit("only sources")))


@query("SELECT (SELECT count(*) FROM chunks WHERE embedding IS NOT NULL) AS records, (SELECT count(DISTINCT source_url) FROM chunks) AS pages, (SELECT count(*) FROM chunks WHERE embedding IS NOT NULL) > 0 AS ready")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks")
    return c.agg(F.count("embedding").alias("records"), F.count_distinct("source_url").alias("pages"), (F.count("embedding") > 0).alias("ready"))


@query("SELECT (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM page_docs) AS documents, (SELECT CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM page_docs) AS chars, (SELECT count(*) FROM chunks) AS chunks")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.ingest_summary(*(table(spark, sf_dir, n) for n in ("sources", "page_docs", "chunks")))


@query("SELECT CAST(epoch_us(date_trunc('day', sent_at)) // 1000000 AS BIGINT) AS day, role, count(*) AS turns FROM (SELECT DISTINCT conv_id, turn, role, text, sent_at FROM chat_turns) GROUP BY 1, 2")
def live_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by day and role from a stream of the turns, repeated rows once."""
    return live.daily_turns(spark, f"{sf_dir}/chat_turns.parquet")
