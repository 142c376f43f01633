import html.parser
import random

from pyspark.sql import functions as F

from siftwright.llm import topk
from siftwright.llm.html_text import extract_text, page_text


def test_top_k_with_ties_zero_queries_and_small_blocks(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.randint(-3, 3) for _ in range(4)]) for i in range(300)] + [(300, [0, 0, 0, 0]), (301, [1, 2]), (302, [5, 5]), (None, [1, 1, 1, 1]), (303, None), (304, [])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    asked = df.where("id % 10 = 0 or id > 299")
    got = {}
    for r in topk.exact_top_k(asked, df, 5, block=40, query_block=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = {}
    for q, v in [(r.id, r.v) for r in asked.collect() if r.id is not None and r.v is not None]:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i is not None and w is not None and len(w) == len(v) and i != q))[:5]
        if best:
            want[q] = {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_large_components_stay_exact(spark):
    rows = [(i, [2**40 + i, -(2**40), 3]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = {(r.query_id, r["rank"]): r.score for r in topk.exact_top_k(df.where("id = 0"), df, 3).where("score > 0").collect()}
    assert all(isinstance(s, int) for s in got.values())


def test_grid_vector(spark):
    rows = [([0.5, -0.001],), ([float("nan"), 1.0],), ([None, 1.0],), (None,), ([float("inf")],), ([],)]
    df = spark.createDataFrame(rows, "v array<float>").select(topk.grid_vector(F.col("v")).alias("g"))
    assert [r.g for r in df.collect()] == [[128, -1], None, None, None, None, []]


def test_layout():
    page = """<title>no</title><h1>A &amp; b</h1><p>one <b>t</b>wo<br>three<p>next<ul><li>x<li>y<ol start=9><li>p<li>q</ol></ul>
    <table><caption>cap</caption><tr><th>name<th>qty<tr><td>long name<td>3<tr><td colspan=2>a wide cell over both<tr><td rowspan=2>r<td>1<tr><td>2</table>
    <pre>\n a\n   b</pre><div hidden>no</div><i style="color:red; display: none">no</i><script>no</script><details><summary>S</summary>no</details>end"""
    assert page_text(page) == "\n".join([
        "A & b", "", "one two", "three", "", "next", "", "- x", "- y", "", "  9. p", "  10. q", "", "cap", "name       qty", "long name  3",
        "a wide cell over both", "r          1", "           2", "", " a", "   b", "", "S", "", "end"])


class Words(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")
        self.out.append("" if tag in ("a", "b") else " ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")
        self.out.append("" if tag in ("a", "b") else " ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_all_visible_words_of_the_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    for r in extract_text(pages, "html").collect():
        words = Words()
        words.feed(r.html)
        words.close()
        assert [w for w in r.text.split() if w != "-"] == [w for w in "".join(words.out).split() if w != "-"]


def test_odd_pages(spark):
    pages = [None, "", "plain", "<", "<<p", "<p", "</p>", "<!-- open", "<a href='x", "<script>x", "<td>c<tr><td>d", "<table>" * 60 + "deep",
             "<div>" * 5000 + "x", "<ul><li><ul><li>a", "&#0;&bogus;&amp", "<p>" + "y" * 100_000, "<td rowspan=99999999999 colspan=0>z", "<svg><text>no</svg>ok"]
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(pages)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in extract_text(df, "html").collect()}
    assert len(got) == len(pages) and got[0] == got[1] == "" and got[2] == "plain" and "deep" in got[11] and got[12] == "x" and got[17] == "ok"
    assert got[10].split() == ["c", "d"] and len(got[15]) == 100_000
    assert extract_text(df.limit(0), "html").count() == 0
