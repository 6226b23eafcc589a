import random

from groundline.llm import sentences as st

NAMES = ["Velkar", "Ostrin", "Quil", "Tarno"]


def corpus():
    rng = random.Random(2)
    ends = ["reports {} units at {}.", "closes the book of {} in {}.", "pays 4.{}% to {} and so on, etc."]
    out = []
    for _ in range(600):
        s = [f"The fund of {rng.choice(NAMES)} " + rng.choice(ends).format(rng.randint(1, 99), rng.choice(NAMES)) if rng.random() < 0.7 else f"Mr. {rng.choice(NAMES)} signed note No. {rng.randint(1, 50)} for {rng.choice(NAMES)} Ltd. last year." for _ in range(4)]
        out.append(" ".join(s[:2]) + "\n" + " ".join(s[2:]))
    return out


def tagged(spark, texts):
    rows = [("chunks", f"t{i}", t, "x") for i, t in enumerate(texts)] + [("train", f"c{i}", t, "x") for i, t in enumerate(corpus())]
    df = spark.createDataFrame(rows, "rec_table string, rec_id string, text string, end_pos string")
    out = {}
    for r in st.sentence_units(df).where("rec_table = 'chunks'").collect():
        out.setdefault(int(r.rec_id[1:]), []).append(r.end_pos)
    return {i: [texts[i][a:b].strip() for a, b in zip([0, *sorted(e)], sorted(e), strict=False)] for i, e in out.items()}


def test_units(spark):
    cases = [
        ["The rate is 4.63% vs. 0.29% at Velkar Ltd. last year.", "Mr. Tarno signed No. 7 for Quil."],
        ['The note says "Keep it. Ask for form 9." and gives no date.', "The desk opens at 9 a.m."],
        ["(The Quil table has 54 rows.)", "It holds."],
        ['"Is it final?" asked the clerk.', "Why wait ... until 2005?", "iFolio shows it."],
        ["阳东的告示写道：“请保留回执。请索取2号表。”但没有日期。", "不要签署No.6表！"],
        ["Ισχύει και στη Λομεναβα;", "Το φυλλάδιο γράφει τρία."],
        ["See www.a.example/faq.v2.html for it.", "Done?!", "Yes."],
    ]
    texts = [" ".join(c) if "的" not in c[0] else "".join(c) for c in cases]
    got = tagged(spark, texts)
    for i, c in enumerate(cases):
        assert got[i] == c, (got[i], c)


def test_lines_end_units_and_blank_texts_have_none(spark):
    got = tagged(spark, ["Head | line\nOne two\n\n  - item \n", None, "", " \n\t", "word", "x" * 100_000 + ". End."])
    assert got == {0: ["Head | line", "One two", "- item"], 4: ["word"], 5: ["x" * 100_000 + ".", "End."]}


def test_thai_blank(spark):
    got = tagged(spark, ["สำนักงานแสดงราคา สำนักงานแก้ไขราคา 327 ฉบับ"])
    assert all("327" not in u or "สำนักงาน" in u for u in got[0])


def test_empty_table(spark):
    assert st.sentence_units(spark.createDataFrame([], "rec_table string, rec_id string, text string")).count() == 0


def test_viterbi_against_all_chains():
    import itertools

    rng = random.Random(4)
    for _ in range(50):
        n = rng.randint(1, 7)
        s = [rng.uniform(-2, 2) for _ in range(n)]
        t = tuple(tuple(rng.uniform(-1, 1) for _ in range(2)) for _ in range(2))

        def total(c):
            return sum(x for x, v in zip(s, c) if v) + sum(t[int(a)][int(b)] for a, b in zip((True, *c), c))

        best = max(itertools.product((False, True), repeat=n), key=total)
        assert abs(total(st.viterbi(s, t)) - total(best)) < 1e-9


def test_thai_boundaries_of_unbroken_text_are_learned():
    """Places between letters, learned from stripped text: held-out sentences are parted where they were put together."""
    rng = random.Random(6)
    names = ["สุขกา", "พรมา", "ลาดี", "บุญชัย", "แก้วทอง", "ราฟ้า"]
    starts, acts, objects = ["สำนักงาน{}ระบุว่า", "ผู้ถือหน่วยจาก{}", "รายงานของ{}"], ["แสดง", "แก้ไข", "ยืนยัน", "อธิบาย"], ["ราคาของแต่ละหน่วย", "สัดส่วนเงินสด", "เวลาทำการของเคาน์เตอร์", "วันประชุมของผู้ดูแล"]
    sentence = lambda: rng.choice(starts).format(rng.choice(names) + rng.choice(names)) + rng.choice(acts) + rng.choice(objects)
    model = st.train_thai(["\n".join(" ".join(sentence() for _ in range(3)) for _ in range(2)) for _ in range(60)])
    right = wrong = lost = 0
    for _ in range(40):
        parts = [sentence() for _ in range(4)]
        want = {sum(map(len, parts[: i + 1])) for i in range(3)}
        got = set(st.thai_ends("".join(parts), model, at_blanks=False))
        right, wrong, lost = right + len(got & want), wrong + len(got - want), lost + len(want - got)
    assert right >= 0.95 * (right + lost) and right >= 0.95 * (right + wrong), (right, wrong, lost)
    line = " ".join(parts)
    assert st.thai_ends(line, model) == [sum(map(len, parts[: i + 1])) + i for i in range(3)]
    assert st.thai_ends("".join(parts), model) == [] and st.thai_ends("ราคา 12 ฉบับ", model) == []


def test_thai_text_in_a_table_row_has_no_inner_end(spark):
    assert tagged(spark, ["ระยะเวลา พรสุข | 12 | ราคา หน่วย", "ราคา หน่วย\nราคา"]) == {0: ["ระยะเวลา พรสุข | 12 | ราคา หน่วย"], 1: ["ราคา", "หน่วย", "ราคา"]}
