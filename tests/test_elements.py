from pyspark.sql import functions as F

from pagewright.functions import elements
from pagewright.functions.elements import Collector, json_logos, stylesheet_urls


def scan(html, base="https://a.com/x/"):
    found = Collector(base)
    found.feed(html)
    found.close()
    return [(r[1], r[2]) for r in found.rows]


def test_element_sources():
    assert scan('<picture><source srcset="b.webp 2x, c.webp" media="(x)"><img src="a.png" srcset="a1.png 300w, a2.png 600w" data-src="l.png"></picture><img src="/d.png#f">') == [
        ("img", "https://a.com/x/a.png"), ("img", "https://a.com/x/a1.png"), ("img", "https://a.com/x/a2.png"), ("lazy-attribute", "https://a.com/x/l.png"), ("picture", "https://a.com/x/b.webp"), ("picture", "https://a.com/x/c.webp"), ("img", "https://a.com/d.png"),
    ]
    assert scan('<video poster=p.jpg></video><svg><image xlink:href="s.png"/></svg><object data="o.svg"></object><iframe src="page.html"></iframe><embed src=e type="image/png"><div style="background:url(bg.png)" data-bg="url(\'z.png\')"></div>') == [
        ("video-poster", "https://a.com/x/p.jpg"), ("svg-image", "https://a.com/x/s.png"), ("object-embed", "https://a.com/x/o.svg"), ("object-embed", "https://a.com/x/e"), ("css-background", "https://a.com/x/bg.png"), ("lazy-attribute", "https://a.com/x/z.png"),
    ]
    assert scan('<img src="javascript:x"><img src=""><img>') == [] and scan('<base href="https://b.com/"><img src="a.png">') == [("img", "https://b.com/a.png")]


def test_metadata():
    html = """<link rel="shortcut icon" href=/i.ico><link rel=image_src href=s.png><meta property="og:image" content=o.png><meta name="twitter:image:src" content=t.png><meta name=msapplication-TileImage content=m.png>
    <script type="application/ld+json">{"@graph":[{"logo":"l.svg"},{"a":{"logo":{"url":"l2.svg"}}}]}</script><script>var logo="x.png"</script><style>a{background:url(k.png)}</style>"""
    assert [(p, u.rsplit("/", 1)[1]) for p, u in scan(html)] == [("icon-link", "i.ico"), ("og-image", "s.png"), ("og-image", "o.png"), ("twitter-image", "t.png"), ("meta-icon", "m.png"), ("json-ld", "l.svg"), ("json-ld", "l2.svg"), ("stylesheet", "k.png")]
    assert json_logos("nonsense") == [] and json_logos("[" * 10 + '{"logo":"deep"}' + "]" * 10) == []


def test_stylesheet_urls():
    css = "@import url(no.css); a{background:url(a.png),image-set('b.png' 1x);color:red} @media x{b{--Brand: url('c;}.png')}} @font-face{src:url(f.woff)} c{mask:url(data:image/png;base64,AA)} /* d{background:url(z)} */ e{background:url(e.png)"
    assert [(f["url"], f["property"], f["declaration"], f["image_set"]) for f in stylesheet_urls(css)] == [("a.png", "background", 0, True), ("b.png", "background", 0, True), ("c;}.png", "--Brand", 1, False), ("data:image/png;base64,AA", "mask", 2, False), ("e.png", "background", 3, False)]


def test_candidates_and_manifests(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", '<img src=a.png><link rel=manifest href="/m.json">'), (2, "https://a.com/", None), (3, None, "<img src=a.png>")], "page_id long, url string, html string")
    assert [(r["page_id"], r["found_in"], r["url"]) for r in elements.candidates(pages).orderBy("page_id", "ord").collect()] == [(1, "img", "https://a.com/a.png"), (1, "manifest-link", "https://a.com/m.json")]
    bodies = spark.createDataFrame([(1, '{"icons":[{"src":"i.png","sizes":"8x8"},{"sizes":"1x1"}]}'), (2, "junk"), (3, None)], "page_id long, body string")
    assert [tuple(r) for r in elements.manifest_icons(bodies).collect()] == [(1, 0, "i.png", "8x8", None)]


def test_css_colors(spark):
    rows = [("rgb(255, 0, 128)", "#ff0080"), ("rgba(0,0,0,.5)", "#808080"), ("#0a0b0c", "#0a0b0c"), ("#00000080", "#7f7f7f"), ("rgba(1,2,3,0.01)", None), ("red", None), (None, None)]
    white = F.struct(*[F.lit(255.0).alias(n) for n in "rgb"])
    got = spark.createDataFrame(rows, "c string, want string").select(elements.over(elements.css_color(F.col("c")), white).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
