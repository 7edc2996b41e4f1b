"""Tokenizer and page operators on hand-written HTML."""

import pytest
from pyspark.sql import functions as F

from funnelscope.operators import discovery, features, render
from funnelscope.sources.html import read_page

CAPTURES = "url string, mode string, status_code int, content_type string, final_url string, html string, error string"


def texts(html, tag):
    return [e["text"] for e in read_page(html, "https://a.b/")[0] if e["tag"] == tag]


@pytest.mark.parametrize("html, text", [
    ("<p>a<p>b</p>c", "a b c"),
    ("<title>T</title><b>x<!-- no -->y</b>", "T x y"),
    ("<script>var a='</p>'</script>z<style>s</style><noscript>n</noscript><svg><text>v</text></svg><template>t</template>", "z"),
    ("a &amp; b&nbsp;c &copy; &#150; &nosuch; d", "a & b c © – &nosuch d"),
    ("x</div></b>y<br>z<hr/>w", "x y z w"),
    ("<![CDATA[kept]]>", "kept"),
    ("<ruby>r<rt>no</rt></ruby>", "r"),
    ("", ""),
])
def test_visible_text(html, text):
    assert read_page(html, "https://a.b/")[2] == text


def test_nested_and_unclosed_elements():
    assert texts("<h1>A <b>B</b></h1><h1>open<a href=x>in", "h1") == ["A B", "open in"]
    assert texts("<button>one<script>no()</script> two</button>", "button") == ["one two"]
    assert texts("<title>a<b>b</b></title>", "title") == ["ab"]


def test_link_addresses():
    got = [e["href_abs"] for e in read_page('<a href="">1</a><a href="/p">2</a><a href="//c.d">3</a><a href="mailto:x">4</a><a>5</a>', "https://a.b/q?x#f")[0]]
    assert got == ["https://a.b/q?x#f", "https://a.b/p", "https://c.d", "mailto:x", None]


def test_json_ld_depth_and_bad_json():
    html = ('<script type="application/ld+json">{"@type":["FAQPage",1],"x":[{"@type":"Question"}]}</script>'
            '<script type="application/ld+json">{bad</script><script type="application/ld+json"></script>')
    assert sorted(read_page(html, "")[1]) == ["FAQPage", "Question"]


def test_malformed_address_is_a_value():
    assert read_page('<a href="http://[x">a</a>', "https://a.b")[3].startswith("ValueError")
    assert read_page(None, None) == (None, None, None, None)


def page(spark, html, mode="standard", url="https://a.b/"):
    df = spark.createDataFrame([(url, mode, 200, "text/html", url, html, None)], CAPTURES)
    return features.page_features(df).first()


def test_ctas_first_spelling_wins(spark):
    assert page(spark, '<a href="">Start</a><button>start</button><a href="/x">Buy  now</a>')["ctas"] == ["Start [button]", "Buy now -> https://a.b/x"]
    many = "".join(f"<button>buy {i}</button>" for i in range(40))
    assert len(page(spark, many)["ctas"]) == 25
    assert page(spark, f"<button>buy {'x' * 60}</button>")["ctas"] == []


def test_forms(spark):
    assert page(spark, '<form><input type=hidden><textarea required id="m"></textarea></form>')["forms"] == ["form 1: 1 fields (m*)"]
    nested = '<form><input name=a><form><input name="" id=b><input type="reset"></form></form><select name=out></select>'
    assert page(spark, nested)["forms"] == ["form 1: 3 fields (a, b, input)", "form 2: 2 fields (b, input)"]
    wide = "<form>" + "".join(f"<input name=f{i}>" for i in range(17)) + "</form>"
    assert page(spark, wide)["forms"][0].startswith("form 1: 17 fields (f0, ") and page(spark, wide)["forms"][0].endswith("f14)")


def test_headings_keep_empty_slots(spark):
    got = page(spark, "<h1></h1>" * 4 + "<h1>five</h1><h1>six</h1>")
    assert got["h1"] == ["", "", "", "", "five"]


def test_schema_types(spark):
    got = page(spark, '<div itemtype="https://schema.org/QAPage/"></div><script type="application/ld+json">{"@type":"Answer"}</script>')
    assert got["schema_types"] == ["Answer", "QAPage"] and got["has_faq_schema"]


def test_word_count_and_meta(spark):
    got = page(spark, '<title> T </title><meta name="Description" content="no"><meta name="description" content=" d ">one two \x1c three')
    assert (got["word_count"], got["meta_description"], got["title"]) == (4, "d", "T")
    assert page(spark, "")["word_count"] == 0


def resolve(spark, raw, shown, raw_status=200, shown_status=200):
    rows = [("u", "standard", raw_status, "text/html", "u", raw, None)]
    if shown is not None:
        rows.append(("u", "rendered", shown_status, None, "u", shown, None))
    df = features.page_features(spark.createDataFrame(rows, CAPTURES))
    return render.capture_resolve(df.filter("mode = 'standard'"), df.filter("mode = 'rendered'")).first()


def test_resolve_same_page_has_no_gap(spark):
    got = resolve(spark, "<h1>x</h1>", "<h1>x</h1>")
    assert got["js_missing"] == [] and got["fetch_method"] == "standard"
    assert got["render_note"] == "headless browser retry found no extra content (1 words)"


def test_resolve_cases(spark):
    long = "w " * 600
    assert resolve(spark, long, "<h1>x</h1>")["render_note"] == ""
    assert resolve(spark, "a", "b", shown_status=500)["render_note"] == "headless browser retry failed: HTTP 500"
    assert resolve(spark, "a", None)["fetch_method"] == "standard"
    blocked = resolve(spark, "a", "b", raw_status=403)
    assert blocked["ok"] and blocked["render_note"] == "plain request was blocked (HTTP 403)" and blocked["raw_word_count"] is None
    assert resolve(spark, "a", "b", raw_status=404)["error"] == "HTTP 404"


def test_gap_order_and_wording(spark):
    shown = ("<h1>Head</h1><h2>a</h2><button>Buy</button><form><input name=x></form><p>0.5% and $10 and $10 per month</p>"
             '<div itemtype="s/Product"></div>' + "w " * 1200)
    got = resolve(spark, "<p>hi</p>", shown)
    assert [m["short"] for m in got["js_missing"]] == ["pricing", "CTAs", "the main headline", "forms", "structured data", "body copy"]
    detail = {m["short"]: m["detailed"] for m in got["js_missing"]}
    assert detail["pricing"] == "pricing (4 price mentions, e.g. $10, 0.5%, per month)"
    assert detail["CTAs"] == "calls to action such as 'Buy'"
    assert detail["body copy"] == "most of the body copy (1 of 1,210 words are in the raw HTML)"
    headings = resolve(spark, "<h1>x</h1>", "<h1>x</h1>" + "<h2>y</h2>" * 3)
    assert [tuple(m) for m in headings["js_missing"]] == [("section headings", "3 section headings")]


def test_candidates_fragment_quirk(spark):
    links = [("Pricing", "https://a.b/p#a"), ("Pricing", "https://a.b/p#b"), ("Pricing", "https://a.b/p"), ("fees", "https://x.y/fees"),
             ("Pricing", "https://a.b/q"), ("Pricing", "https://a.b/q")]
    df = spark.createDataFrame([("https://a.b", links)], "site_url string, links array<struct<text:string,href:string>>")
    got = [r["url"] for r in discovery.page_candidates(df).filter("page_type = 'pricing'").orderBy("rank").collect()]
    assert got == ["https://a.b/p", "https://a.b/p", "https://a.b/q", "https://a.b/pricing", "https://a.b/fees", "https://a.b/plans"]


def test_discover_takes_first_good_one(spark):
    found = spark.createDataFrame([("s", "pricing", 1, 1, "u1"), ("s", "pricing", 1, 2, "u2"), ("s", "pricing", 1, 3, "u3"), ("s", "signup", 4, 1, "u1"),
                                   ("s", "signup", 4, 2, "u9")], "site_url string, page_type string, type_ord int, rank int, url string")
    pages = spark.createDataFrame([("u1", False, "HTTP 404"), ("u2", True, None), ("u3", True, None)], "url string, ok boolean, error string")
    got = {r["page_type"]: r for r in discovery.page_discover(found, pages).collect()}
    assert got["pricing"]["ok"] and got["pricing"]["page_url"] == "u2"
    assert got["signup"]["page_url"] == "u1"
    assert got["signup"]["error"] == "No reachable page found. Tried: u1, u9 (last error: not captured)"
