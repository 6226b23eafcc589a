from pyspark.sql import functions as F

from groundline.sources import html

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav>Home</nav><p>Next</p><div class="cookie-bar">Accept</div>
<h1>Alpha <b>Fund</b></h1><p>Ratio &amp; load<br>are low<p>nearby <table><tr><th>Name</th><td>1.03%</td></tr><tr><td>Load</td><td> </td><td>nil</td></tr></table>
<div role="banner">x</div><h3>Exit</h3><p id="main">Ends<footer>Terms</footer></body></html>"""


def test_content_is_kept_and_frames_are_not(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>open <b>never closed"), (4, "")], "id long, html string")
    got = {r.id: r.text for r in html.with_text(df).collect()}
    assert got[1] == "# T\n# Alpha Fund\nRatio & load\nare low\nnearby\nName | 1.03%\nLoad | nil\n### Exit\nEnds"
    assert got[2] == "" and got[3] == "open never closed" and got[4] == ""


def test_nested_tables_inline_elements_and_open_frames():
    nested = "<table><tr><td>a <i>b</i></td><td><table><tr><td>c</td><td>d</td></tr></table></td></tr><tr><td>e<td>f</table>after"
    assert html.html_text(nested) == "a b | c | d\ne | f\nafter"
    assert html.html_text("<div><p class='share'>x<p>kept <a>one</a>, <b>two</b></div>") == "kept one, two"
    assert html.html_text("<div><nav>menu<ul><li>x</div><p>body") == "body"
    assert html.html_text("<div role='menu'>x</div><div role='complementary'>y</div>") == "y"


def test_headings(spark):
    r = spark.createDataFrame([(PAGE,)], "h string").select(html.headings(F.col("h")).alias("x")).first().x
    assert [(x.level, x.text) for x in r] == [(1, "Alpha Fund"), (3, "Exit")]
