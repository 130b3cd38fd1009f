"""Media round trips and main texts."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest

from gradeloom.llm import html_consensus as H
from gradeloom.llm import media as M


def _overlaps(n, m):
    out = np.zeros((m, n))
    for k in range(m):
        lo, hi = k * n / m, (k + 1) * n / m
        for i in range(int(lo), min(n, int(np.ceil(hi)))):
            out[k, i] = max(0, min(hi, i + 1) - max(lo, i))
    return out / (n / m)


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (8, 9), (100, 64), (9_000, 64), (17, 33)])
def test_images_round_trip_and_area_means(shape):
    a = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (M.decode(M.encode_pgm(a))[:, :, 0] == a).all() and (M.decode(M.encode_bmp(a))[:, :, 0] == a).all()
    assert np.allclose(M.area_resize(a, 8, 9), _overlaps(shape[0], 8) @ a @ _overlaps(shape[1], 9).T)


def test_other_forms():
    assert M.decode(b"P1 # c\n2 2\n1 0\n0 1").reshape(2, 2).tolist() == [[0, 255], [255, 0]]
    assert M.decode(b"P4\n9 1\n\x80\x00").reshape(-1).tolist() == [0] + [255] * 8
    assert M.decode(b"P2\n2 1\n15\n0 15").reshape(-1).tolist() == [0, 255]
    assert M.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]] == M.decode(b"P6 1 1 255\n\x01\x02\x03").tolist()
    assert M.decode(b"P5 1 1 65535\n\xff\xff").reshape(-1).tolist() == [255]
    head = b"BM" + np.array([58, 0, 54, 40, 1, 1], "<u4").tobytes() + np.array([1, 24], "<u2").tobytes() + bytes(24)
    assert M.decode(head + b"\x03\x02\x01\x00").tolist() == [[[1, 2, 3]]]
    with pytest.raises(ValueError):
        M.decode(b"GIF89a")


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_texts_as_media(spark, odd, nothing, form):
    rows = M.text_media(odd, form=form, with_media=True, with_tile=True, also="bmp").collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], (r["text"] or "").encode())
    assert len(rows) == odd.count()
    for r in rows:
        b = texts[r["doc_id"]]
        p = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) and M.decode(bytes(r["media"])).tobytes() == p
        assert bytes(r["tile"])[:6] == b"\x93NUMPY" and r["bmp_intact"] and (form == "pgm" or r["bmp_sha256"] == r["media_sha256"])
    assert M.text_media(nothing).count() == 0


def test_image_features_bear_what_is_no_image(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5 1 1 255\n\x07")), (2, bytearray(b"?")), (3, None), (4, bytearray(b"P5 9 9 255\n\x07")), (5, bytearray(b"P5 1 1 0\n\x07")), (6, bytearray(b"P5 99999999999 99999999999 255\n\x07")), (7, bytearray(b"P2 1 1 255 70000")), (8, bytearray(b"P2 1 1 255 " + b"9" * 30)), (9, bytearray(b"P6 0 1 255\n")), (10, bytearray(b"BM" + bytes(16) + b"\xff" * 8 + b"\x01\x00\x08\x00" + bytes(30)))], "id long, m binary")
    got = {r["id"]: (r["height"], r["error"] is None) for r in M.image_features(df, "id", "m").collect()}
    assert got == {1: (1, True)} | {i: (None, False) for i in range(2, 11)}


def test_main_text_equals_the_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}

    def article(h):
        h = re.sub(r"</?(p|h1|br|li|ul|div|article)\b[^>]*>", " ", h[h.index("<article>") : h.index("</article>")])
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", h)).split())

    got = {r["page_id"]: r["text"] for r in H.op5_html_text(spark, sf).collect()}
    assert got == {k: article(h) for k, h in pages.items()}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav class="menu"><a href=x>Home</a></nav><div id="wrap"><div class="sidebar">Side text that is rather long, as side texts are</div>
<div class="post-content p%d"><h1>The title</h1><p>First &amp; para <b>bold</b>x.<p>Second&nbsp;para<div class="ad-box">BUY now</div><ul><li>one<li>two</ul><form>Name <input></form></div><section id="comments"><p>I like this very much, thank you for all of it, and so on and on</p></section></div><div class="cookie-notice">We use cookies</div><footer>foot</footer>"""


def test_templates_and_votes(spark):
    short = '<body><div id="wrap"><div class="post-content p3"><p>Tiny</p></div><div class="more"><p>A longer teaser that would win on its own page</p></div></div>'
    rows = [(i, f"http://h.example/{i}", PAGE % i) for i in range(5)] + [(9, "http://h.example/9", short), (10, None, None), (11, "nonsense", ""), (12, "http://o.example", "plain &lt;b&gt; only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.main_text(df).collect()}
    assert all(got[i] == "The title First & para boldx. Second para one two" for i in range(5))
    assert got[10] == got[11] == "" and got[12] == "plain <b> only"
    assert H.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [("<p>a<p>b<br>c<script>if(a<b)x</script>d", "a b cd"), ("<div title='a>b'>x<!-- c --> y</div>", "x y"), ("<style>p{", ""), ("a&#65;&eacute;&bogus;", "aAé&bogus;"), ("</div></p>z", "z")])
def test_broken_markup(page, text):
    assert H.extract(page, []) == text


def test_articles_in_several_containers_are_whole():
    two = "<body><div class='list'><div class='entry'><p>%s</p></div><div class='entry'><p>%s</p></div></div></body>" % ("first part " * 6, "second part " * 4)
    assert H.extract(two, [H.path_hash(">body>div.list>div.entry")]) == " ".join(["first part"] * 6 + ["second part"] * 4)
    led = "<article><h1>Title</h1><p>lead</p><div class='text'><p>%s</p></div></article><div><a href=x>one link</a> <a href=y>another</a></div>" % ("long body " * 40)
    assert H.extract(led, []) == H.extract(led, [H.path_hash(">article>div.text")]) == "Title lead " + " ".join(["long body"] * 40)


@pytest.mark.parametrize("wrapper", ["div class='site with-sidebar'", "div class='content no-comments'", "div id='page-header-wrap'", "form action=x"])
def test_marks_and_forms_do_not_drop_the_main_part(wrapper):
    page = f"<body><{wrapper}><div class='sidebar'>side text</div><div class='entry'><p>{'the article ' * 20}</p></div><div class='comments'>a comment</div></{wrapper.split()[0]}><p>after it</p></body>"
    assert H.extract(page, []) == " ".join(["the article"] * 20) + " after it"
    assert H.extract("<div class='sidebar'>one</div><div class='comments'>two</div>", []) == "one two"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>one</p><section id='related'><p>Related work</p></section><div class='form-factor'>two</div><div class='ad-slot'>BUY</div><div id='comments'>hm</div></article>", "one Related work two"),
        ("<main><p>one</p><div class='copyright-law'><p>the law</p></div><div class='related-posts'>more</div><div class='left-sidebar'>side</div></main>", "one the law"),
        ("<div class='content'><p>one and some more words</p><div class='right-sidebar'>side</div></div>", "one and some more words"),
        ("<div role='main'><p>one</p><div class='legal-history'>two</div><div role='search'>find</div></div>", "one two"),
    ],
)
def test_names_tell_less_inside_an_article(page, text):
    assert H.extract(page, []) == text


def test_linked_articles_and_loose_marks_are_kept():
    law = " ".join(f"This is sentence number {i} about the law." for i in range(10))
    assert H.extract("<article><p><a>All of the text is linked here</a></p></article><div><div></div></div>", []) == "All of the text is linked here"
    assert H.extract(f"<div class='post'><p>Short.</p></div><div class='comment-policy-law'><p>{law}</p></div>", []) == f"Short. {law}"
    for name in ("comments", "comment-list", "sidebar", "share-buttons"):
        assert H.extract(f"<div class='post'><p>Short post text here.</p></div><div class='{name}'><p>{law}</p></div>", []) == "Short post text here."


def test_deep_and_broken_pages_take_time_in_proportion(spark):
    import time

    start = time.process_time()
    assert H.extract("<div>" * 100_000 + "deep text", []) == "deep text"
    assert H.extract("<div>" * 50_000 + "x" + "</span>" * 50_000, []) == "x"
    assert H.extract("<b>" * 50_000 + "<div>y</div>" * 50_000, []).startswith("y y")
    assert H.extract("<p>z" + '<a "' * 50_000, []).startswith("z")
    assert H.extract("<!" * 50_000, []) == "<!" * 50_000
    assert H.extract("".join(f"<div class=c{i % 7}>t{i}</div>" for i in range(20_000)), []).count(" ") == 19_999
    assert time.process_time() - start < 30


def test_paths_with_a_share_of_the_votes_win(spark):
    page = "<body><div class='%s'><p>some words of text</p></div>"
    rows = [("h", page % "entry")] * 40 + [("h", page % f"x{chr(97 + i)}") for i in range(2)] + [("g", page % "only")]
    got = {r["host"]: r["paths"] for r in H.host_paths(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert got == {"h": [H.path_hash(">body>div.entry")], "g": [H.path_hash(">body>div.only")]}
