import itertools
import random

import numpy as np

from groundline.llm import main_body as mb


def cost(odds, edges, side):
    return sum(max(0, o) for o, s in zip(odds, side) if not s) + sum(max(0, -o) for o, s in zip(odds, side) if s) + sum(w for a, b, w in edges if side[a] != side[b])


def test_min_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        odds = np.array([rng.uniform(-2, 2) for _ in range(n)])
        edges = [(i, j, rng.uniform(0, 1.5)) for i, j in itertools.combinations(range(n), 2) if j - i <= 2]
        best = min(cost(odds, edges, s) for s in itertools.product((True, False), repeat=n))
        assert abs(cost(odds, edges, mb.min_cut(odds, edges)) - best) < 1e-6


def test_min_cut_of_a_very_long_page():
    n = 50_000
    odds = np.where(np.arange(n) % 5000 < 4990, 1.0, -1.0)
    side = mb.min_cut(odds, [(i, i + 1, 0.3) for i in range(n - 1)])
    assert (side == (odds > 0)).mean() > 0.99


MENU = ["Home | Funds | Sign in", "Read all terms here", "Share this page", "Accept all cookies now"]
BODY = ["The fund of {} reports {} units and lists the rules for all holders.", "No fee is shown for {} because the sheet {} explains the charge in full."]


def page(rng):
    lines = [(rng.choice(MENU), False) for _ in range(3)]
    lines += [(rng.choice(BODY).format("Qu" + rng.choice("aeiou") * 3, rng.randint(1, 999)), True) for _ in range(5)]
    return lines + [(rng.choice(MENU), False) for _ in range(2)]


def tables(spark):
    rng = random.Random(1)
    labelled = [(p, i, x, m, "e") for p in range(30) for i, (x, m) in enumerate(page(rng))]
    pages = [page(rng) for _ in range(40)]
    rows = [(p, "\n".join(x for x, _ in lines), False, 0) for p, lines in enumerate(pages)] + [(90, None, True, 0), (91, "", True, 0), (92, " \n ", True, 0), (0, "\n".join(x for x, _ in pages[0]), False, 0)]
    return spark.createDataFrame(rows, "pd_id long, text string, is_main boolean, line_no int"), spark.createDataFrame(labelled, "page_no int, line_no int, line string, is_main boolean, pd_id string"), pages


def test_held_out_pages(spark):
    docs, labels, pages = tables(spark)
    got = {(r.pd_id, r.line_no): r.is_main for r in mb.labelled_lines(docs, labels).collect()}
    truth = {(p, i): m for p, lines in enumerate(pages) for i, (_, m) in enumerate(lines)}
    assert sum(got[k] == m for k, m in truth.items()) / len(truth) > 0.97
    assert not any(p in (90, 91) for p, _ in got)
    bodies = {r.pd_id: r.body for r in mb.main_bodies(docs, labels).collect()}
    assert "reports" in bodies[0] or "No fee" in bodies[0]


def test_no_labels_one_label_no_pages(spark):
    docs, labels, _ = tables(spark)
    assert mb.labelled_lines(docs, labels.limit(0)).count() > 0
    assert all(r.is_main for r in mb.labelled_lines(docs, labels.where("is_main")).collect())
    assert mb.labelled_lines(docs.limit(0), labels).count() == 0


def test_ends_of_long_lines_count():
    long = "word " * 100
    a, b = mb.gram_places([long + "share this"])[0], mb.gram_places([long + "share that"])[0]
    assert sorted(a) != sorted(b)
    assert mb.templates_of("- the same long line " * 8 + "one", frozenset())[0] != mb.templates_of("- the same long line " * 8 + "(", frozenset())[0]
