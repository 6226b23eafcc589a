import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.operators import answers, assemble, chunking, index, memory, search
from groundline.plans import pipeline
from groundline.sources import documents as docs


def vectors(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, f"e{i % 3}", [float(x) for x in rng.normal(size=8).round(3)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, entity string, vector array<float>")


@pytest.mark.parametrize("mode", ["all", "same", "named"])
def test_top_k_in_blocks_equals_brute_force(spark, monkeypatch, mode):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 17)
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rows, v = vectors(spark, 90)
    q = v.where("id % 10 = 0").withColumn("entity", F.when(F.col("id") % 20 == 0, "").otherwise(F.col("entity")))
    got = {(r.qid, r["rank"]): (r.id, r.similarity) for r in search.top_k(q, v, 4, mode).collect()}
    m = np.array([r[2] for r in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 90, 10):
        entity = "" if i % 20 == 0 else rows[i][1]
        ok = [j for j in range(90) if mode == "all" or rows[j][1] == entity or mode == "named" and entity == ""]
        best = sorted(ok, key=lambda j: (-round(float(m[i] @ m[j]), 4), j))[:4]
        assert [got[i, k + 1][0] for k in range(len(best))] == best
    if mode == "same":
        assert (0, 1) not in got


def test_fallback_and_empty_sides(spark):
    _, v = vectors(spark, 20)
    q = v.where("id < 2").withColumn("entity", F.lit("nowhere"))
    hits = search.with_fallback(q, v, 3).collect()
    assert len(hits) == 6 and all(h.fell_back for h in hits)
    assert search.top_k(q.limit(0), v).count() == 0 and search.top_k(q, v.limit(0)).count() == 0


def test_blocks_that_meet_are_those_of_the_entity(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 10)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    v = spark.range(1000).selectExpr("id", "concat('e', id % 10) AS entity", "array(float(id), 1f) AS vector")
    q = v.where("id % 100 IN (3, 4)")
    key = F.struct(F.lit(False).alias("all"), F.col("entity").alias("entity")).alias("key")
    a, b = search.cells(q.select("id", key, "vector"), v.select("id", key, "vector"))
    met = a.select("key", "q_block", "v_block").distinct()
    assert {r.key.entity for r in met.collect()} == {"e3", "e4"} and met.count() <= 2 * 3 * 10  # blocks of two entities of 100, not of 1000
    assert b.select("id").distinct().count() == 200
    groups = b.groupBy("key", "q_block", "v_block").count()
    assert groups.count() >= met.count() > 2 and groups.agg(F.max("count")).first()[0] < 40


def test_weak_reasons(spark):
    hits = [(1, 1, 5, 0.9, "general", False), (1, 2, 6, 0.8, "A", False), (1, 3, 7, 0.7, "B", False), (2, 1, 5, 0.9, "A", False), (2, 2, 6, 0.8, "B", False), (3, 1, 5, 0.4, "A", False), (4, 1, 5, 0.9, "B", True), (5, 1, 5, 0.9, "general", False)]
    h = spark.createDataFrame(hits, "qid long, rank int, id long, similarity double, entity string, fell_back boolean")
    q = spark.createDataFrame([(1, []), (2, []), (3, ["A"]), (4, ["A"]), (5, ["A"]), (6, []), (7, ["A", "B"])], "qid long, named array<string>")
    got = {r.qid: r.reasons for r in assemble.assembled(q, h).collect()}
    assert got == {1: "", 2: "spans 2 entities", 3: "below floor", 4: "other entities,fell back", 5: "", 6: "no hits", 7: "no hits"}


def test_context_is_in_rank_order(spark):
    h = spark.createDataFrame([(1, 2, "l2", "t2", "u2", "d2"), (1, 1, "l1", "t1", "u1", "d1")], "qid long, rank int, label string, text string, source_url string, fetched_at string")
    assert assemble.context_blocks(h).first().context == "[1] l1\nt1\nsource: u1\nfetched_at: d1\n\n[2] l2\nt2\nsource: u2\nfetched_at: d2"


def conversation(spark, texts):
    return spark.createDataFrame([(1, 2 * i + 1, "user", t) for i, t in enumerate(texts)] + [(1, 2, "assistant", "Beta Fund")], "conv_id long, turn int, role string, text string")


def aliases(spark):
    return memory.entities(spark.createDataFrame([("Alpha Fund - Direct Growth",), ("Beta Fund",), (None,), ("general",)], "scheme_name string"))


def resolve(spark, texts, last=10):
    return [(r.entity, r.origin) for r in memory.resolved(conversation(spark, texts), aliases(spark), last).orderBy("turn").collect()]


def test_memory_precedence_and_donors(spark):
    got = resolve(spark, ["fee of alpha fund?", "and its load?", "alpha fund or beta fund?", "and now?", "the Beta Fund, please", "load?", ""])
    assert got == [("Alpha Fund", "question"), ("Alpha Fund", "memory"), ("Alpha Fund, Beta Fund", "question"), ("Alpha Fund", "memory"), ("Beta Fund", "question"), ("Beta Fund", "memory"), ("Beta Fund", "memory")]


def test_memory_reaches_back_n_clean_turns_for_every_length(spark):
    for n in range(0, 14):
        got = resolve(spark, ["alpha fund?"] + [f"q{i}" for i in range(n)])
        assert [o for _, o in got[1:]] == ["memory" if i <= 9 else "none" for i in range(n)]


def test_turns_with_personal_data_donate_nothing(spark):
    assert resolve(spark, ["alpha fund, my PAN is ABCDE1234F", "load?"])[1] == ("", "none")
    assert memory.screened(conversation(spark, ["a", "PAN ABCDE1234F", " ", "b"]), 1).first().text == "b"


def test_blocks_part_tables_and_paragraphs(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nx | y\nz | w\nc"), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.block_no, r.is_table, r.body) for r in chunking.blocks(df.where("text IS NOT NULL"), "doc_id", "text").orderBy("doc_id", "block_no").collect()]
    assert got == [(1, 0, False, "a\nb"), (1, 1, True, "x | y\nz | w"), (1, 2, False, "c")]


def test_chunks_keep_size_rows_and_words(spark):
    rng = random.Random(3)
    sentence = lambda: "The fund reports " + " ".join(rng.choice(["units", "fees", "loads", "rules"]) for _ in range(rng.randint(3, 20))) + "."
    text = "\n".join(["# Head one", *(sentence() for _ in range(25)), "## Table", *(f"row {i} | {i * 7}% | value {i}" for i in range(60)), "### Last", "x" * 900, sentence()])
    df = spark.createDataFrame([(1, text, "Alpha Fund"), (2, "short", ""), (3, None, "A"), (4, " \n", "A")], "d long, text string, entity string")
    rows = chunking.chunked(df, "d", "text", "entity").orderBy("d", "chunk_index").collect()
    own = [r for r in rows if r.d == 1]
    assert [r.chunk_index for r in own] == list(range(len(own))) and {r.chunk_count for r in own} == {len(own)}
    assert all(len(r.text) <= 512 or "x" * 900 in r.text for r in own)
    joined = "\n".join(r.text for r in own)
    assert all(f"row {i} | {i * 7}% | value {i}" in joined for i in range(60))
    assert [r.text for r in rows if r.d == 2] == ["general | overview\nshort"] and not [r for r in rows if r.d > 2]


def test_index_is_checked_written_and_appended(spark, tmp_path):
    rows = [("a-0", "A", "http://a", "t", [1.0, 2.0]), ("a-1", "A", "http://a", "t", [1.0, 0.0])]
    schema = "id string, scheme_name string, source_url string, text string, embedding array<float>"
    path = str(tmp_path / "index")
    df = spark.createDataFrame(rows, schema)
    assert index.write(df, path) == 2
    assert index.append(df.unionByName(spark.createDataFrame([("b-0", None, "http://b", "t", [0.0, 1.0])], schema)), path) == 1
    assert index.append(df, path) == 0 and spark.read.parquet(path).count() == 3
    for bad in (df.limit(0), df.unionByName(df), df.withColumn("source_url", F.lit(" ")), df.withColumn("embedding", F.lit(None).cast("array<float>"))):
        with pytest.raises(ValueError):
            index.write(bad, path)
    assert spark.read.parquet(path).count() == 3


def test_embeddings_have_length_one(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, "two three one")], "id long, text string")
    got = {r.id: r.embedding for r in index.embedded(df, "id", "text").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5 and got[1] == got[4] and got[2] is None and got[3] is None


def test_clean_sentences_numbers(spark):
    df = spark.createDataFrame([("The ratio is 1.03%. See https://x.example/y for it, as of 2024-01-05. It costs Rs. 1,030 (2024-02-03) approx. 3 times.",)], "t string")
    r = df.select(answers.clean(F.col("t")).alias("c"), answers.sentences(F.col("t")).alias("s"), answers.numbers(F.lit("1,030 and 1.03 and 1,030")).alias("n")).first()
    assert "http" not in r.c and "2024" not in r.c
    assert r.s[0] == "The ratio is 1.03%." and r.s[-1].startswith("It costs Rs. 1,030")
    assert r.n == ["1030", "1.03"]


def test_declined_and_grades(spark):
    for x, want in [("I don't know.", True), ("Not mentioned here", True), ("", True), (None, True), ("The load is 1%.", False)]:
        assert spark.createDataFrame([(x,)], "t string").select(answers.declined(F.col("t"))).first()[0] is want
    a = spark.createDataFrame([(1, "fact", "x", "http://a", "A"), (2, "fact", "x", "http://b", "A"), (3, "fact", "x", "", "A"), (4, "fact", "x", "http://z", "A"), (5, "refuse", "x", "", "A"), (6, "fact", "1.2", "http://a", "A")], "answer_id long, mode string, text string, source_url string, scheme_name string")
    owners = docs.owners(spark.createDataFrame([("http://a", "A"), ("http://b ", "B"), (None, "C")], "url string, scheme_name string"))
    assert {r.answer_id: r.grade for r in answers.graded(a, owners).collect()} == {1: "ok", 2: "other entity", 3: "no url", 4: "unknown url", 5: "refused", 6: "bare figure"}


def test_source_list(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("﻿url,scheme_name,scheme_category,doc_type\n https://a.test/x ,A,c,d\n,B,c,d\nftp://a/b,C,c,d\n", encoding="utf-8")
    bad.write_text("url,scheme_name\nx,y\n")
    rows = docs.read_source_list(spark, str(good))
    assert rows.count() == 3 and [r.url for r in docs.public(rows).collect()] == ["https://a.test/x"]
    with pytest.raises(ValueError):
        docs.read_source_list(spark, str(bad))


def test_quarantine(spark):
    pages = spark.createDataFrame([(1, "t", {"source_url": "u"}), (2, "  ", {"source_url": "u"}), (3, "t", {"source_url": " "}), (4, None, None)], "pd_id long, text string, metadata map<string,string>")
    kept, failed = docs.split(pages)
    assert [r.pd_id for r in kept.collect()] == [1]
    assert {r.pd_id: r.reason for r in failed.collect()} == {2: "no text", 3: "no source", 4: "no text"}


def test_sections_and_partial_rows(spark):
    df = spark.createDataFrame([(1, "intro\n# One\nbody\n## Empty\n### Two  \n a\nb"), (2, "#no heading"), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.section_no, r.heading, r.body) for r in chunking.sections(df, "doc_id", "text").orderBy("doc_id", "section_no").collect()]
    assert got == [(1, 0, "overview", "intro"), (1, 1, "One", "body"), (1, 2, "Two", "a\nb"), (2, 0, "overview", "#no heading")]
    cases = {"| 1% |\n| a | b |\n| c | d |": "| a | b |\n| c | d |", "| a | b |\n| c | d |": "| a | b |\n| c | d |", "x\n| a | b |\n| c |": "x\n| a | b |\n| c |", "| 1% |": "| 1% |"}
    for text, want in cases.items():
        assert spark.createDataFrame([(text,)], "t string").select(chunking.trim_partial_row(F.col("t"))).first()[0] == want


def test_units_stay_within_their_room(spark):
    text = "\n".join(["# Head", "Word and more. " * 80, "a | b", "c | d" * 200])
    rows = chunking.units(spark.createDataFrame([(1, text, "E")], "d long, text string, entity string"), "d", "text", "entity").collect()
    assert all(len(r.piece) <= 512 - len("E | Head") - 1 for r in rows if "c | d" not in r.piece) and {r.section for r in rows} == {"Head"}


def test_pipeline_searches_whole_chunks(spark):
    sources = spark.createDataFrame([("http://a", "Alpha Fund"), ("http://b", "Beta Fund"), ("http://c", "Gamma Fund")], "url string, scheme_name string")
    body = "Overview\nFirst line\nThe exit load is 1.25% within ninety days."
    chunks = [("a-0", body, "Alpha Fund", "http://a"), ("b-0", "Overview\nFirst line\nThe benchmark index follows 250 companies.", "Beta Fund", "http://b"), ("g-0", "Guide\nIntro\nWhat does riskometer mean: it shows the grade of risk.", None, "http://g")]
    chunks = spark.createDataFrame([(*c[:3], c[3], "s", "2025-01-01") for c in chunks], "id string, text string, scheme_name string, source_url string, section string, fetched_at string")
    asked = ["Alpha Fund exit load within ninety days", "what does riskometer mean", "Gamma Fund exit load", "", "unrelated zebra umbrella"]
    turns = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(asked)], "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in pipeline.answered(turns, chunks, sources).collect()}
    assert got[0].mode == "fact" and "1.25%" in got[0].text and got[0].source_url == "http://a"
    assert got[1].mode == "fact" and got[1].source_url == "http://g"
    assert [got[i].reason for i in (2, 3, 4)] == ["weak_retrieval", "empty", "weak_retrieval"]
    made = {r.conv_id: r for r in pipeline.answered(turns, chunks, sources, lambda q, t: F.lit("The load is 7.77%.")).collect()}
    assert made[0].reason == "ungrounded" and made[0].stopped_at == "generate" and made[0].text == ""
    blocked = spark.createDataFrame([(9, 0, "user", "My PAN is ABCDE1234F, Alpha Fund exit load")], turns.schema)
    stages = {r.stopped_at for r in [*got.values(), *made.values(), *pipeline.answered(blocked, chunks, sources).collect()]}
    assert stages == {"answered", "trim", "guard", "assemble", "generate"}


def test_missing_index(spark, tmp_path):
    with pytest.raises(index.MissingIndex):
        index.opened(spark, str(tmp_path / "none"))


def test_aliases_of_any_length(spark):
    name = "One Two Three Four Five Six Seven Eight Fund"
    aliases = memory.entities(spark.createDataFrame([(name,), ("Alpha",)], "scheme_name string"))
    texts = spark.createDataFrame([(1, f"ask of {name.upper()} now"), (2, "alpha and beta"), (3, None)], "k int, text string")
    assert {(r.k, r.entity) for r in memory.named_entities(texts, aliases, ["k"]).collect()} == {(1, name), (2, "Alpha")}
    assert memory.named_entities(texts, aliases.limit(0), ["k"]).count() == 0


def test_figures_need_a_context(spark):
    a = spark.createDataFrame([(1, "u", "It is 5 % of A12 and 7 units, 1,030.5 in all, 250 more."), (2, "u", "It is 9%.")], "answer_id long, source_url string, text string")
    c = spark.createDataFrame([("u", "We say 9 and 1030.5 here.")], "source_url string, text string")
    assert {(r.answer_id, r.number) for r in answers.ungrounded(a, c).collect()} == {(1, "5"), (1, "250")}


def test_append_of_grown_pages(spark):
    text = "\n".join(f"# Part {i}\n" + f"Words of part {i}. " * 40 for i in range(4))
    pages = spark.createDataFrame([("http://a ", text, "A"), ("http://a", text, "A"), ("", text, "A"), ("http://b", None, "B")], "source_url string, text string, scheme_name string")
    made = index.page_chunks(pages)
    ids = {r.id for r in made.collect()}
    assert len(ids) == made.count() > 3
    first = made.where("chunk_index = 0").select("id")
    assert {r.id for r in index.to_append(made, first).collect()} == ids - {first.first().id}


def test_short_chunks_take_what_fits_from_the_next():
    pack = chunking.Packer("E", size=300, least=200, overlap=0)
    text = "\n".join(["# A", "a" * 120, "", "a" * 150, "", "# B", "b" * 30, "", "b" * 200, "", "# C", "c" * 10])
    # both "a" pieces fit (272 of 293 characters), both "b" pieces too, then 200 are reached and the next heading cuts
    assert pack.chunks(text) == [("A", "E | A\n" + "a" * 120 + "\n\n" + "a" * 150), ("B", "E | B\n" + "b" * 30 + "\n\n" + "b" * 200), ("C", "E | C\n" + "c" * 10)]
    # greedy packing leaves 150 characters alone because the next block, of two pieces, begins another chunk; its first piece still fits
    parts = [chunking.Group.of([("A", "a" * 150)]), chunking.Group.of([("B", "b" * 100), ("B", "b" * 180)]), chunking.Group.of([("C", "c" * 20)])]
    assert [g.items for g in pack.filled(parts)] == [[("A", "a" * 150), ("B", "b" * 100)], [("B", "b" * 180), ("C", "c" * 20)]]
    for n in range(1, 30):
        many = pack.chunks("\n\n".join(f"# S{i}\n" + "x" * (7 * i % 90 + 5) for i in range(n)))
        assert all(len(t) <= 300 for _, t in many)
        # a chunk under the least size could not take the first piece of the next
        for (s, t), (s2, t2) in zip(many, many[1:], strict=False):
            body, piece = t.split("\n", 1)[1], t2.split("\n", 1)[1].split("\n\n")[0]
            assert len(body) >= 200 or len(body) + 2 + len(f"## {s2}") + 2 + len(piece) > pack.room(s)


def test_group_lengths_are_those_of_the_bodies():
    g = chunking.Group("A")
    for i, section in enumerate("AABBCA"):
        g.add(section, "p" * i)
        assert g.length == len(g.body())


def test_partial_rows_of_the_overlap_go():
    rows = "1% |\n| Exit load | 1% |\n| Fee | 2% |"
    assert chunking.whole_rows("| " + rows) == "| Exit load | 1% |\n| Fee | 2% |"
    assert chunking.whole_rows("prose " + rows) == "prose " + rows


def test_chunk_sizes_of_the_pages(spark):
    pages = spark.createDataFrame([(i, "\n\n".join(f"# Part {j}\n" + "Word and more. " * (j % 7 + 1) for j in range(40)), "Fund") for i in range(5)], "d long, text string, entity string")
    rows = chunking.chunked(pages, "d", "text", "entity").collect()
    sizes = [len(r.text) for r in rows if r.chunk_index + 1 < r.chunk_count]
    assert max(sizes) <= 512 and sum(n < 400 for n in sizes) <= 0.1 * len(sizes)
