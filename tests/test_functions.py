from pyspark.sql import functions as F

from groundline.functions import rules, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_strip_takes_white_space_of_every_kind(spark):
    assert one(spark, text.strip, "   a b　\n") == "a b"
    assert one(spark, text.strip, None) == ""


def test_display_name_and_entity_key(spark):
    assert one(spark, text.display_name, "Alpha Mid Cap Fund - Direct Plan Growth") == "Alpha Mid Cap Fund"
    assert one(spark, text.display_name, "Alpha Fund - Direct Growth ") == "Alpha Fund - Direct Growth"
    assert one(spark, text.entity_key, " Alpha  MID-Cap Fund - Direct Growth") == "alpha mid cap fund"


def test_clean_lines(spark):
    assert one(spark, text.clean_lines, "a  \t b\r\n\r\n  c d \n\n") == "a b\nc d"


def test_word_runs(spark):
    assert set(one(spark, lambda c: text.word_runs(c, 2), "One two, three")) == {"one", "two", "three", "one two", "two three"}
    assert one(spark, lambda c: text.word_runs(c, 3), "") == []


def test_pack_never_exceeds_and_keeps_every_piece(spark):
    pieces = ["aaa", "bb", "c" * 12, "d", "ee", "f"]
    got = one(spark, lambda c: text.pack(c, 7, " "), pieces, "array<string>")
    assert got == ["aaa bb", "c" * 12, "d ee f"]
    assert one(spark, lambda c: text.pack(c, 7, " "), [], "array<string>") == []


def test_overlap_tail(spark):
    assert one(spark, text.overlap_tail, "short") == ""
    long = "x" * 100 + " first part. Second sentence is here"
    assert one(spark, text.overlap_tail, long) == "Second sentence is here"
    assert one(spark, text.overlap_tail, "y" * 60 + " " + "word " * 20).startswith("word")


def test_personal_data(spark):
    cases = {"pan": "my PAN is ABCDE1234F", "aadhaar": "1234 5678 9012", "email": "write to a.b@c-d.example now", "phone": "+91 98765 43210", "otp": "OTP is 4321", "account_number": "folio no. 1234567", "long_number": "x 1234567 y"}
    for kind, message in cases.items():
        assert kind in one(spark, lambda c: rules.matches(c, rules.PERSONAL), message)
    for clean in ("ratio of 1.03%", "NAV 45.67 on 2024-01-05", "code 123456", "9 a.m."):
        assert one(spark, lambda c: rules.matches(c, rules.PERSONAL), clean) == []


def test_redaction_is_in_order_and_keeps_the_rest(spark):
    got = one(spark, rules.redact, "mail a@b.example, call 9876543210, folio 12345678.")
    assert "a@b" not in got and "9876543210" not in got and "12345678" not in got and got.startswith("mail [redacted]")


def test_neighbours_are_both_redacted(spark):
    assert one(spark, rules.redact, "9876543210 9876543211,9876543212") == "[redacted] [redacted],[redacted]"


def test_the_sql_of_the_rules_says_the_same(spark):
    import duckdb

    texts = ["9876543210 9876543211,9876543212", "mail a@b.example, call +91 98765 43210.", "OTP is 4321; folio no. 12345678", "PAN ABCDE1234F 1234-5678-9012", "x12345678 1.03% 123456", "Should I buy? best funds", "highest return of all"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(rules.redact(t), F.array_join(rules.matches(t, rules.PERSONAL), ","), rules.verdict(t)).collect()
    con = duckdb.connect()
    for text, row in zip(texts, got, strict=True):
        sql = f"SELECT {rules.redact_sql('t')}, array_to_string({rules.matches_sql('t', rules.PERSONAL)}, ','), {rules.verdict_sql('t')} FROM (SELECT ? AS t)"
        assert tuple(row) == con.execute(sql, [text]).fetchone()


def test_verdict_precedence(spark):
    assert one(spark, rules.verdict, "Should I buy it? PAN ABCDE1234F") == "pii"
    assert one(spark, rules.verdict, "Should I buy Alpha Fund?") == "advice"
    assert one(spark, rules.verdict, "Which had the highest return?") == "returns"
    for x in ("What is the expense ratio?", "", None, "what does buy and hold mean?"):
        assert one(spark, rules.verdict, x) == "allow"


def test_secret_shapes(spark):
    assert one(spark, lambda c: F.regexp_count(c, F.lit(rules.SECRET)), "k=sk-abcdefghij0123456789 and AIza" + "x" * 30) == 2
