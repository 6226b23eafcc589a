import random

import pytest
from tokenizers import Tokenizer

from groundline.llm import encode, mix


def test_ids_equal_the_library(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n \t x  ", "aaa" * 3000, "I'll can't 'sd", "<|endoftext|> x", "naïve café — “q” 漢字 ελλ 🙂🙂", "12345 1,000.5", "x" * 20_001]
    texts += ["".join(rng.choice("abc dé1.,\n") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    rows = [(i, t, [0]) for i, t in enumerate(texts)] + [(0, None, [0])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    lib = Tokenizer.from_file(encode.VOCABULARY)
    lib.encode_special_tokens = True
    got = [(r.doc_id, r.ids) for r in encode.encode(df).collect()]
    assert len(got) == len(rows)
    for i, ids in got:
        assert ids == lib.encode(texts[i] or "", add_special_tokens=False).ids
        assert lib.decode(ids) == (texts[i] or "")
    counts = {r.doc_id: r.n_tokens for r in encode.encode(df, count_only=True).collect()}
    assert counts == {i: len(ids) for i, ids in got}
    assert encode.encode(df.limit(0)).count() == 0


def tables(spark, sizes, targets):
    rows = [(f"{s}", i * 1000 + j, "word " * (1 + j % 7), 3) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    rows += [(None, 999_999, "word", 3), ("other", 999_998, "word", 3), ("a", 999_997, None, 3), ("a", 999_996, "", 3)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string, copies int")
    return docs, spark.createDataFrame([(s, *v) for s, v in targets.items()], "source string, target_share double, max_repeats int")


def test_shares_are_reached_as_far_as_repeats_allow(spark):
    docs, targets = tables(spark, {"a": 700, "b": 700, "c": 20}, {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 2), "none": (0.0, 4)})
    chosen, report = mix.mix(docs, targets, total_tokens=4000)
    r = {x.source: x for x in report.collect()}
    assert r["c"].limited and r["c"].mix_tokens == 2 * r["c"].available_tokens and r["none"].mix_tokens == 0
    # what c can't give is divided 5 : 3
    rest = 4000 - r["c"].mix_tokens
    assert abs(r["a"].mix_tokens - rest * 5 / 8) <= 8 and abs(r["b"].mix_tokens - rest * 3 / 8) <= 8
    assert abs(sum(x.reached_share for x in r.values()) - 1) < 1e-9
    assert all(x.copies <= 3 for x in chosen.collect())


def test_choices_are_nested_and_repeated(spark):
    docs, targets = tables(spark, {"a": 300}, {"a": (1.0, 3)})
    picks = [{r.doc_id: r.copies for r in mix.mix(docs, targets, total_tokens=t)[0].collect()} for t in (300, 900, 2500)]
    for small, large in zip(picks, picks[1:], strict=False):
        assert all(large.get(k, 0) >= n for k, n in small.items())
    assert max(picks[2].values()) <= 3


@pytest.mark.parametrize("empty", ["docs", "targets"])
def test_empty_tables(spark, empty):
    docs, targets = tables(spark, {"a": 5}, {"a": (1.0, 3)})
    docs, targets = (docs.limit(0), targets) if empty == "docs" else (docs, targets.limit(0))
    chosen, report = mix.mix(docs, targets)
    assert chosen.count() == 0 and report.count() == (1 if empty == "docs" else 0)
