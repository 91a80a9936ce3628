import hashlib
import html
import re
from collections import Counter

import helpers
import numpy as np

from flowlens.llm import fingerprint, pages

SF = "/root/testdata/sf0.01"


def _article(source):
    inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
    return " ".join(p for p in parts if p)


def test_pages_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: _article(r.html) for r in table.collect()}
    got = {r.page_id: r for r in pages.extracted(table).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_page_parts_that_are_no_article():
    source = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><div id=topNav>menu</div>
    <header>site</header><div class="cookie-notice">ok?</div><main><h1>Title &amp; more</h1><p>First <b>bo</b>ld&nbsp;text<p>Second <a href="x>y">link</a>
    <ul><li>one<li>two</ul><form>field<input name=q></form><div class="ad-slot">buy</div><table><tr><td>c1<td>c2</table><br>tail &lt;b&gt;<!-- p > -->
    <script>var a = "</p>";</script><section class="Comments"><p>reader</p></section></main><aside>side</aside><footer>end</footer></body>"""
    assert pages.main_text(source) == "Title & more First bold text Second link one two c1 c2 tail <b>"
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<div></div>") == ""
    assert pages.main_text("plain words") == "plain words"
    assert pages.main_text("<p title=\"x>y\">a<p t='b>c</p>") .startswith("a")


def test_host_vote_decides(spark):
    good = "<body><div class='story-{0}'><p>{1}</p></div><div class='box'><p>{2}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", good.format(i, "long text " * 20, "short")) for i in range(5)]
    rows += [(9, "http://H.example:80/9", good.format(9, "short one", "much longer box text " * 20)), (10, None, None), (None, "x", "<p>alone</p>"), (9, "http://h.example/9", "")]
    got = Counter((r.page_id, r.text) for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[9, "short one"] == 1 and got[10, ""] == 1 and got[None, "alone"] == 1 and got[9, ""] == 1
    assert pages.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_fingerprints_follow_edits():
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"], 900)) + "é"
    words = text.split(" ")
    words[100] = "changed"
    del words[500]
    near = " ".join(words)
    other = " ".join(rng.choice(["uno", "due", "tre"], 900))
    a, b, c = fingerprint.fingerprints([text, near, other])
    assert fingerprint.fingerprints([text])[0] == a
    assert fingerprint.likeness(a, b) > 0.8 > 0.1 > fingerprint.likeness(a, c)
    empty = fingerprint.fingerprints(["", "x"])
    assert fingerprint.likeness(empty[0], empty[0]) == 1 and fingerprint.likeness(empty[0], empty[1]) == 0


def test_edit_comparison_equals_brute_force(spark):
    rows = [(d, t or "") for d, t, *_ in helpers.ROWS]
    rows.sort(key=lambda r: r[1])
    rows.sort(key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    want = Counter()
    prints = fingerprint.fingerprints([t for _, t in rows])
    for i, (doc, text) in enumerate(rows):
        edited = fingerprint.edited_text(text, rows[(i + 1) % len(rows)][1])
        print_ = fingerprint.fingerprints([edited])[0]
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i].hex(), print_.hex(), round(fingerprint.likeness(prints[i], print_), 9), round(fingerprint.likeness(prints[i], prints[(i + 1) % len(rows)]), 9)] += 1
    got = Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprint.edit_comparison(helpers.docs(spark)).collect())
    assert got == want
    assert fingerprint.edit_comparison(helpers.docs(spark, [])).collect() == []
    one = fingerprint.edit_comparison(helpers.docs(spark, [(1, "abcd", None, None)])).collect()
    assert one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_near_classes(spark):
    rng = np.random.default_rng(6)
    base = rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"], 500).tolist()
    rows = [(k, " ".join(base[: 40 * k + 3] + ["edit"] + base[40 * k + 4 :])) for k in range(10)] + [(50, " ".join(base)), (51, " ".join(base)), (60, "other " * 300), (61, None)]
    got = {r.id: r.class_id for r in fingerprint.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in (*range(10), 50, 51)} == {0} and got[60] == 60 and 61 not in got
