"""Lines repeated across one site's documents (problem 2).

The host of a page's address is its site. Each line gets an identifier, the hash of the line without white space and decimal
digits and in one letter case. A site's pages are divided into shards of bounded size, and each shard's line
identifiers are concatenated, every page closed by an identifier of its own. Over each shard

1. a suffix array is built by prefix doubling,
2. common prefixes of neighbouring suffixes give the repeated blocks: every interval of suffixes with a common prefix that the
   suffixes beside it do not share is a block of that many lines,
3. blocks in fewer pages than the shard's part of the threshold are dropped.

A block in at least the threshold's share of a site's pages is in that share of the pages of at least one of its shards,
so no block is lost by the division. The candidates' lines are then counted over the whole site and held against
the exact thresholds; lines of frequent blocks go from every page.

Edge cases: pages with null or empty text or without an address belong to no site; they come out unchanged and have no found lines.
Lines of which nothing is left (blank lines, bare numbers) are never found and never cut a block. Repeated rows (one page id twice) count as one
page. A page that says a line twice counts once, and both places are found. Very long pages are one shard's work only if they
alone exceed it; shards are bounded in lines, not pages, by the average. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundline.runtime import cut, spread

MIN_PAGES, MIN_SHARE = 5, 0.10
#: Lines of one shard, about; a shard is one task's group.
SHARD_LINES = 100_000


def site_of(url: Column) -> Column:
    """The host in lower case without user, port and a leading "www."; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host != "", host)


def line_key(line: Column) -> Column:
    """What two equal lines have in common: no white space, no decimal digits, one letter case."""
    return F.lower(F.upper(F.regexp_replace(line, r"(?U)[\s\p{Nd}]+", "")))


def page_lines(pages: DataFrame, id_col: str, text_col: str, url: Column) -> DataFrame:
    """site, page, line_no and line (identifier, null for a line of which nothing is left) of every line of every page of a site."""
    named = pages.select(F.col(id_col).alias("page"), F.col(text_col).alias("text"), site_of(url).alias("site")).where("text <> '' AND site IS NOT NULL AND page IS NOT NULL")
    lines = spread(named).select("site", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    key = line_key(F.col("line"))
    return lines.select("site", "page", F.col("line_no").cast("long").alias("line_no"), F.when(key != "", F.xxhash64(key)).alias("line"))


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``s`` by prefix doubling, and the length of the common prefix of each suffix with the one before it."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else rank[:0]
        pair = rank * (n + 1) + after + 1
        order = np.argsort(pair, kind="stable")
        fresh = np.r_[0, np.cumsum(pair[order][1:] != pair[order][:-1])] if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            break
        ranks.append(rank)
        step *= 2
    # The ranks of each doubling tell whether two suffixes share that many: the common prefix, from the longest power of two down.
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        # equal ranks mean equal prefixes of full length: every page is closed by its own identifier
        a[same] += 1 << k
        b[same] += 1 << k
        common[1:][same] += 1 << k
    return order, common


def blocks(order: np.ndarray, common: np.ndarray, page: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, number of lines, number of pages) of each repeated block in at least ``least`` pages.

    Blocks are the intervals of the suffix array whose common prefix is longer than that of the suffixes around them. The pages of an
    interval are its suffixes less the neighbours of one page in it: each two suffixes of one page that follow one another in the
    array count at the innermost interval with both, and an interval hands its count on to the one around it.
    """
    lengths, lefts, again = [0], [0], [0]  # of the open intervals: common prefix, first suffix, repeated pages
    before: dict[int, int] = {}  # page -> its latest suffix
    for i in range(len(order) + 1):
        now = int(common[i]) if i < len(order) else 0
        left = max(i - 1, 0)
        while lengths[-1] > now:
            length, left, more = lengths.pop(), lefts.pop(), again.pop()
            pages = i - left - more
            if pages >= least:
                yield int(order[left]), length, pages
            if lengths[-1] < now:
                lengths.append(now)
                lefts.append(left)
                again.append(more)
            else:
                again[-1] += more
        if now > lengths[-1]:
            lengths.append(now)
            lefts.append(left)
            again.append(0)
        if i < len(order):
            p = int(page[order[i]])
            if p in before:
                again[bisect_right(lefts, before[p]) - 1] += 1
            before[p] = i


def longest_of(found: list[tuple[int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` places the lines of the longest block over it and that block's pages, 0 where there is none.

    Of the blocks that begin at one place the longest covers the others, so one number a place and one sweep are enough.
    """
    length, pages = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for start, k, p in found:
        if k > length[start]:
            length[start], pages[start] = k, p
    best, of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    free = list(range(n + 1))

    def next_free(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    # longest first: each place belongs to the first block that reaches it
    for start in sorted(np.flatnonzero(length).tolist(), key=lambda x: -length[x]):
        i, end = next_free(start), start + int(length[start])
        while i < end:
            best[i], of[i] = length[start], pages[start]
            free[i] = i + 1
            i = next_free(i)
    return best, of


def shard_blocks(min_pages: int, min_share: float):
    """applyInArrow function: the lines of one shard of a site to those in repeated blocks, each with its longest block."""

    def run(table: pa.Table) -> pa.Table:
        page, line_no, line = (table.column(c).to_numpy() for c in ("page", "line_no", "line"))
        site, whole = table.column("site")[0].as_py(), table.column("shards")[0].as_py() == 1
        order = np.lexsort((line_no, page))
        page, line = page[order], line[order]
        edge = np.flatnonzero(page[1:] != page[:-1]) + 1
        own = np.cumsum(np.r_[0, page[1:] != page[:-1]])
        # identifiers become small numbers; the closing one of page i is -1 - i
        s = np.insert(np.unique(line, return_inverse=True)[1].astype(np.int64), np.r_[edge, len(line)], -1 - np.arange(len(edge) + 1))
        at = np.insert(own, np.r_[edge, len(line)], np.arange(len(edge) + 1))
        ids = np.insert(line, np.r_[edge, len(line)], 0)
        n = len(edge) + 1
        least = max(1, int(np.ceil(min_share * n - 1e-9)), min_pages if whole else 0)
        found = list(blocks(*suffix_array(s), at, max(2, least)))
        if least == 1:  # so few pages in the shard that one is its part of the threshold: every line may be frequent
            found += [(int(i), 1, 1) for i in np.unique(np.where(s >= 0, s, -1), return_index=True)[1] if s[i] >= 0]
        best, pages = longest_of(found, len(s))
        at = np.flatnonzero(best)
        at = at[np.lexsort((-best[at], ids[at]))]
        at = at[np.r_[True, ids[at][1:] != ids[at][:-1]]] if len(at) else at
        return pa.table({"site": pa.array([site] * len(at), pa.string()), "line": pa.array(ids[at], pa.int64()), "block": pa.array(best[at]), "pages": pa.array(pages[at])})

    return run


def repeated_blocks(lines: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, shard_lines: int = SHARD_LINES) -> DataFrame:
    """site, line, block and pages of each line in a block that is repeated often enough in a shard of its site: lines and pages of the longest such block."""
    size = lines.groupBy("site").agg(F.count("line").alias("n"), F.approx_count_distinct("page").alias("p"))
    shards = size.select("site", F.greatest(F.lit(1), F.ceil(F.col("n") / shard_lines)).cast("int").alias("shards"))
    placed = lines.where("line IS NOT NULL").dropDuplicates(["site", "page", "line_no"]).join(shards, "site")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("page"), F.col("shards")).cast("int"))
    return placed.groupBy("site", "shard").applyInArrow(shard_blocks(min_pages, min_share), "site string, line long, block long, pages long")


def frequent_lines(lines: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, shard_lines: int = SHARD_LINES) -> DataFrame:
    """site, line, n_pages and longest_block (lines of the longest block with it) of the lines found, by exact counts over each site."""
    candidates = repeated_blocks(lines, min_pages, min_share, shard_lines).groupBy("site", "line").agg(F.max("block").alias("longest_block"))
    candidates = cut(candidates)
    pages = lines.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("site_pages"))
    seen = lines.join(candidates, ["site", "line"], "left_semi").select("site", "line", "page").distinct().groupBy("site", "line").agg(F.count("*").alias("n_pages"))
    return seen.join(candidates, ["site", "line"]).join(pages, "site").where((F.col("n_pages") >= min_pages) & (F.col("n_pages") >= F.col("site_pages") * min_share - 1e-9)).select("site", "line", "n_pages", "longest_block")


def repeated_lines(pages: DataFrame, id_col: str, text_col: str, url: Column, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, shard_lines: int = SHARD_LINES) -> DataFrame:
    """id_col and line_no of every line that is repeated across its site."""
    lines = cut(page_lines(pages, id_col, text_col, url))
    return lines.join(frequent_lines(lines, min_pages, min_share, shard_lines), ["site", "line"], "left_semi").select(F.col("page").alias(id_col), "line_no").distinct()


def without_repeated_lines(pages: DataFrame, id_col: str, text_col: str, url: Column, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Every row of ``pages`` with its text rid of the lines found, and n_removed; other columns stay."""
    found = repeated_lines(pages, id_col, text_col, url, min_pages, min_share).groupBy(F.col(id_col).alias("_page")).agg(F.collect_set(F.col("line_no").cast("int")).alias("_gone"))
    joined = pages.join(found, F.col(id_col) == F.col("_page"), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0))).drop("_page", "_gone")


def site_lines_sql(table: str, id_col: str, text_col: str, url: str, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> str:
    """repeated_lines as one statement of DuckDB: a plain count."""
    white = "\\s\\x{000B}\\x{001C}-\\x{001F}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
    return f"""WITH p AS (SELECT {id_col} AS page, {text_col} AS text, nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim({url})), '^(?:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1), '\\.$', ''), '^www\\.', ''), '') AS site FROM {table} WHERE {text_col} <> ''),
q AS (SELECT * FROM p WHERE site IS NOT NULL),
l AS (SELECT site, page, i AS line_no, lower(upper(regexp_replace(str_split(text, chr(10))[i + 1], '[{white}\\p{{Nd}}]+', '', 'g'))) AS line FROM q, unnest(generate_series(0, length(text) - length(replace(text, chr(10), '')))) AS u(i)),
n AS (SELECT site, count(DISTINCT page) AS site_pages FROM q GROUP BY site),
f AS (SELECT site, line, count(DISTINCT page) AS n_pages FROM l WHERE line <> '' GROUP BY site, line)
SELECT DISTINCT page AS {id_col}, CAST(line_no AS BIGINT) AS line_no FROM l JOIN f USING (site, line) JOIN n USING (site) WHERE n_pages >= {min_pages} AND n_pages >= site_pages * {min_share} - 1e-9"""
