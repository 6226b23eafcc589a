import numpy as np
from pyspark.sql import functions as F

from groundline.llm import site_lines

SCHEMA = "pd_id long, text string, url string, site string, line string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "l") for r in rows], SCHEMA)


def found(df, **kw):
    return {tuple(r) for r in site_lines.repeated_lines(df, "pd_id", "text", F.col("url"), **kw).collect()}


def test_lines_in_enough_pages_of_a_site(spark):
    rows = [(i, f"Header {i}\nBody of page number {'abcdefghij'[i]}\nLegal  NOTICE", f"https://{'www.' if i % 2 else ''}Site.test:80/{i}") for i in range(6)]
    rows += [(10 + i, "legal notice\nother", "https://else.test/a") for i in range(4)]
    got = found(frame(spark, rows))
    assert got == {(i, n) for i in range(6) for n in (0, 2)}


def test_share_of_the_site_counts(spark):
    rows = [(i, ("rare line\n" if i < 5 else "") + f"own {chr(97 + i % 26)}{chr(97 + i // 26)}", "http://a.test/") for i in range(60)]
    assert found(frame(spark, rows)) == set()  # five pages of sixty are under a tenth


def test_nulls_empties_repeats_and_several_places(spark):
    rows = [(i, "same\nx" + chr(97 + i) + "\nsame", "http://a.test/") for i in range(5)]
    rows += [(0, rows[0][1], "http://a.test/"), (20, None, "http://a.test/"), (21, "", "http://a.test/"), (22, "same", None), (23, "same", " "), (24, "12 \n 7", "http://a.test/")]
    assert found(frame(spark, rows)) == {(i, n) for i in range(5) for n in (0, 2)}
    assert found(frame(spark, [])) == set()


def test_shards_give_the_same_as_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "\n".join(f"line {chr(97 + int(x))}{chr(97 + int(y))}" for x, y in rng.integers(0, 9, (12, 2))), "http://a.test/") for i in range(80)]
    df = frame(spark, rows)
    assert found(df, shard_lines=60) == found(df) != set()


def test_texts_without_the_lines_keep_rows_and_columns(spark):
    rows = [(i, "menu\nbody " + chr(97 + i), "http://a.test/") for i in range(5)] + [(9, None, None)]
    out = {r.pd_id: r for r in site_lines.without_repeated_lines(frame(spark, rows), "pd_id", "text", F.col("url")).collect()}
    assert out[3].text == "body d" and out[3].n_removed == 1 and out[9].text is None and out[3].site == "s"


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        s = rng.integers(0, 4, n)
        s[n // 2 : n // 2 + 1] = -1
        order, common = site_lines.suffix_array(np.r_[s, -2] if n else s)
        full = list(np.r_[s, -2] if n else s)
        assert list(order) == sorted(range(len(full)), key=lambda i: full[i:])
        for k in range(1, len(full)):
            a, b = full[order[k - 1] :], full[order[k] :]
            assert common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def brute_blocks(order, common, page, least):
    """Every interval whose common prefix is longer than around it, with a plain count of its pages."""
    out = set()
    n = len(order)
    for length in set(common[1:]) - {0}:
        i = 1
        while i < n:
            if common[i] >= length:
                j = i
                while j < n and common[j] >= length:
                    j += 1
                if min(common[i:j]) == length and len(set(page[order[i - 1 : j]])) >= least:
                    out.add((int(order[i - 1]), int(length), len(set(page[order[i - 1 : j]]))))
                i = j
            i += 1
    return out


def test_blocks_against_plain_counts():
    rng = np.random.default_rng(3)
    for n, kinds, pages in ((40, 3, 4), (200, 2, 9), (300, 6, 30), (60, 1, 2)):
        s, page = rng.integers(0, kinds, n), np.sort(rng.integers(0, pages, n))
        edge = np.flatnonzero(page[1:] != page[:-1]) + 1
        s = np.insert(s, np.r_[edge, n], -1 - np.arange(len(edge) + 1))
        at = np.insert(page, np.r_[edge, n], page[np.r_[edge - 1, n - 1]])
        order, common = site_lines.suffix_array(s)
        got = list(site_lines.blocks(order, common, at, 2))
        assert set(got) == brute_blocks(order, common, at, 2) and len(set(got)) == len(got)
        best, of = site_lines.longest_of(got, len(s))
        for i in range(len(s)):
            over = [(k, p) for a, k, p in got if a <= i < a + k]
            assert best[i] == max([k for k, _ in over], default=0)


def test_two_pages_of_many_equal_lines(spark):
    text = "\n".join(["again"] * 50_000)
    rows = [(i, text, "http://a.test/") for i in range(2)] + [(9 + i, "again\nx", "http://a.test/") for i in range(3)]
    df = frame(spark, rows)
    assert site_lines.repeated_lines(df, "pd_id", "text", F.col("url")).count() == 100_003
