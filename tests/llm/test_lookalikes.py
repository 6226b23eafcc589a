import duckdb

from groundline.llm import lookalikes


def pairs(spark, texts, **extra):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "pd_id long, text string, skeleton string")
    return {tuple(r) for r in lookalikes.look_alike_pairs(df, "pd_id").collect()}


def test_what_looks_the_same_pairs(spark):
    base = "Café Modern 12 - ガル x"
    same = [base, "Café Modern 12 - ガル x", "Ｃafé Ｍodern １２ － ガル x", "Café Modern 12 - ガル x", "Café Mo​dern 12 - ｶﾞﾙ x", "Сafé Mоdern 12 - ガル х"]
    assert pairs(spark, same) == {(i, j) for i in range(6) for j in range(i + 1, 6)}


def test_visible_differences_do_not(spark):
    assert pairs(spark, ["Cafe 12", "cafe 12", "Café 12", "Cafe 13", "Cafe 1²", "Cafe  12", "Cafe, 12", "Cafe\n12", "ı", "i"]) == set()


def test_equal_rows_are_no_pair_but_each_pairs_with_the_other(spark):
    assert pairs(spark, ["ab c", "ab c", "ab c"]) == {(0, 2), (1, 2)}


def test_null_empty_and_invisible_texts_pair_with_nothing(spark):
    assert pairs(spark, [None, "", "​", "​‍", "a"]) == set()
    assert pairs(spark, []) == set()


def test_form_gives_words_their_own_script_back_and_keeps_the_key(spark):
    text = "Новая памятка Ром; Ηλικία; plain Рaypal word"
    con = duckdb.connect()
    form, key, again = con.execute(f"SELECT form, skeleton, {lookalikes.skeleton_sql('form')} FROM (SELECT skeleton, {lookalikes.form_sql()} AS form FROM (SELECT {lookalikes.skeleton_sql('?')} AS skeleton))", [text]).fetchone()
    assert "Новая" in form and "Paypal" in form and "Ηλικία" in form
    assert key == again


def test_very_long_texts(spark):
    long = "wörd " * 200_000
    assert pairs(spark, [long, long.replace("ö", "ö")]) == {(0, 1)}


def test_accented_twins_by_rule(spark):
    cases = [("sch\u043e\u0308n", "schön"), ("\u0386x", "Áx"), ("\u1f78x", "òx"), ("\u04ef", "ȳ"), ("\u040c", "Ḱ")]
    assert pairs(spark, [t for pair in cases for t in pair]) == {(2 * n, 2 * n + 1) for n in range(len(cases))}


def test_many_copies_of_one_text_and_one_look_alike(spark):
    df = spark.range(100_000).selectExpr("id AS pd_id", "IF(id = 7, 'p\u0430y', 'pay') AS text")
    got = lookalikes.look_alike_pairs(df, "pd_id")
    assert got.count() == 99_999 and got.where("pd_id_a = 7 OR pd_id_b = 7").count() == 99_999


def test_copies_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "HOT", 2)
    texts = ["pay"] * 5 + ["p\u0430y"] * 4 + ["\u0440ay"] + ["other"] * 3
    want = {(i, j) for i in range(10) for j in range(i + 1, 10) if texts[i] != texts[j]}
    assert pairs(spark, texts) == want
