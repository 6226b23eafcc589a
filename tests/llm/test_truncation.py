import random

from groundline.llm import truncation as tr

RNG = random.Random(7)
NAMES = ["Velkarn", "Ostrinda", "Quilmor", "Tarnobel", "Zandrok"]
TERMS = ["stamp charge", "exit load", "tax certificate", "redemption slip"]


def sentence():
    return f"The {RNG.choice(TERMS)} of {RNG.choice(NAMES)} repeats the wording of the second annex without a new form."


def item():
    return f"- {RNG.choice(NAMES)}{RNG.choice('abcdefgh')} {RNG.choice(TERMS)} {RNG.choice(NAMES)}{RNG.choice('klmnop')}"


def row():
    return f"{RNG.choice(TERMS)} {RNG.choice(NAMES)} | 4.{RNG.randint(1, 99)}% | {RNG.randint(10, 9999)}"


def doc():
    return "\n".join(RNG.choice((sentence, item, row))() for _ in range(8))


def lost(spark, extra, n=300):
    rows = [(i, doc() + "\n" + sentence(), "s", "e") for i in range(n)] + [(1000 + i, t, s, "e") for i, (t, s) in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, evidence string")
    return {r.doc_id - 1000 for r in tr.lost_ends(df).collect()}


WHOLE = ["A whole one.", f"{sentence()}\n{item()}", f"{sentence()}\n{row()}", f"{sentence()}\n— Velkarn", f"{sentence()}\nhttps://a.example/b", f"{sentence()}\nRef: ABC/12", f"{sentence()} (It has 5 rows.)", "“It stays at 4.5%.”", "终了。", f"{sentence()}\n(Velkarn)"]
CUT = ["The stamp charge of Velkarn repeats the wor", "The stamp charge of Velkarn repeats the", f"{sentence()}\n- Velkarn redemp", f"{sentence()}\nVelkarn | 45 | exit lo", f"{sentence()} The exit…", f"{sentence()} The exit l [more]", f"{sentence()} The ex�", 'He says "Keep the slip.', f"{sentence()}\nstamp charge Velkarn | 4.5%"]


def test_whole_and_cut(spark):
    cases = WHOLE + CUT
    got = lost(spark, [(t, "s") for t in cases])
    assert got == set(range(len(WHOLE), len(cases))), ([cases[i] for i in got if i < len(WHOLE)], [cases[i] for i in range(len(WHOLE), len(cases)) if i not in got])


def test_blank_null_copies(spark):
    assert lost(spark, [(None, "s"), ("", "s"), (" \n", "s"), ("The stamp cha", None), ("The stamp cha", None)]) == {3, 4}


def test_length_limit_of_a_source(spark):
    texts = []
    while len(texts) < 30:
        t = (doc() + "\n" + doc())[:500]
        if len(t) == 500:
            texts.append((t, "short_field"))
    listed = (sentence() + "\n" + item()).rjust(500, "A")
    got = lost(spark, [*texts, (listed, "short_field"), (listed, "s"), ("B" * (500 - 9) + " is done.", "short_field")])
    assert 30 in got and 31 not in got and 32 not in got


def test_rates_and_empty_table(spark):
    rows = [(1, "One.", "a"), (2, "The whole of th", "a"), (3, "Two.", None), (4, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.source, r.texts, r.lost, r.rate) for r in tr.loss_rates(df).collect()} == {("a", 2, 1, 0.5), (None, 1, 0, 0.0)}
    assert tr.lost_ends(df.limit(0)).count() == 0


def test_very_long_text(spark):
    assert lost(spark, [((sentence() + " ") * 20_000, "s"), ((sentence() + " ") * 20_000 + "The", "s")], 50) == {1}


def test_length_limit_in_a_source_of_copies(spark):
    texts = []
    while len(texts) < 6:
        t = "\n".join(item() for _ in range(20))[:300]
        if len(t) == 300 and t[-1] != " ":
            texts.append(t)
    listed = (sentence() + "\n" + item()).rjust(300, "A")
    rows = [(i, doc() + "\n" + sentence(), "short_field") for i in range(100)] + [(1000 + i, t, "short_field") for i, t in enumerate([*texts, listed])]
    rows += [(2000 + i, "The same whole text.", "short_field") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert 1006 in {r.doc_id for r in tr.lost_ends(df).collect()}
