import pytest
from pyspark.sql import functions as F

from pagewright.functions import names
from pagewright.functions.originals import originals, variant_key

PAGE = "https://site.example/"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.a.example/_next/image?url=%2Ffront%2Fa.png&w=256&q=75", "https://www.a.example/front/a.png"), ("https://a.example/x/_next/image?url=https%3A%2F%2Fb.example%2Fimage%2Fupload%2Fx.png&w=1", "https://b.example/image/upload/x.png"),
        ("https://framerusercontent.com/images/abc.jpg?scale-down-to=512", "https://framerusercontent.com/images/abc.jpg"), ("https://cdn.prod.website-files.com/a/b-p-500.avif", "https://cdn.prod.website-files.com/a/b.avif"),
        ("https://static.wixstatic.com/media/11_abc~mv2.png/v1/fill/w_200,h_40,al_c/logo.png", "https://static.wixstatic.com/media/11_abc~mv2.png"), ("https://cdn.shopify.com/s/files/1/shoe_600x.jpg?v=12&width=600", "https://cdn.shopify.com/s/files/1/shoe.jpg?v=12"),
        ("https://images.unsplash.com/photo-1?ixid=abc&w=400&q=80&fit=crop", "https://images.unsplash.com/photo-1?ixid=abc"), ("https://images.squarespace-cdn.com/c/a.jpeg?content-type=image%2Fjpeg?format=500w", "https://images.squarespace-cdn.com/c/a.jpeg?format=2500w"),
        ("https://site.example/.netlify/images?url=/img/a.jpg&w=300", "https://site.example/img/a.jpg"), ("https://nuxt.com/_ipx/w_400&f_webp/images/a.png", "https://nuxt.com/_ipx/_/images/a.png"), ("https://ipx.example.com/s_200x200/images/a.png", "https://ipx.example.com/_/images/a.png"),
        ("https://g.example/_gatsby/image/abc/def/hero.png?u=https%3A%2F%2Fimages.ctfassets.net%2Fs%2Fhero.png&a=w%3D800", "https://images.ctfassets.net/s/hero.png"), ("https://site.example/cdn-cgi/image/width=400/https://other.example/a.jpg", "https://other.example/a.jpg"),
        ("https://res.cloudinary.com/demo/image/fetch/w_300,f_auto/https://upload.example.org/a.png", "https://upload.example.org/a.png"), ("https://res.cloudinary.com/acme/image/upload/if_w_gt_400,c_scale,w_400/if_end/logo.png", "https://res.cloudinary.com/acme/image/upload/logo.png"),
        ("https://images.prismic.io/repo/a.png?auto=compress,format&w=400", "https://images.prismic.io/repo/a.png"), ("https://a.storyblok.com/f/1234/3260x1774/abc/a.jpg/m/1280x0", "https://a.storyblok.com/f/1234/3260x1774/abc/a.jpg"),
        ("https://www.x.example/hs-fs/hubfs/a.png?width=200&name=a.png", "https://www.x.example/hubfs/a.png"), ("https://site.example/wp-content/uploads/2024/01/big-scaled.jpg", "https://site.example/wp-content/uploads/2024/01/big.jpg"),
        ("https://i0.wp.com/site.example/wp-content/uploads/a.jpg", "https://site.example/wp-content/uploads/a.jpg"), ("https://g.example/content/images/size/w600/format/webp/2024/01/a.png", "https://g.example/content/images/2024/01/a.png"),
        ("https://ik.imagekit.io/demo/tr:w-300,h-300/a.jpg", "https://ik.imagekit.io/demo/a.jpg"), ("https://p.example/image?image=aHR0cHM6Ly9wdWJsaWMuYm5iLmNvbS9pbWFnZS9hLnBuZw&w=500", "https://public.bnb.com/image/a.png"),
        ("https://gohugo.io/images/hero_hu3f9ab1c2e4a5b6c7_123456_300x0_resize_q75_box.webp", "https://gohugo.io/images/hero.png"), ("https://cdn.unknown.example/a/photo.png?width=400&height=300&fit=cover", "https://cdn.unknown.example/a/photo.png"), ("/_next/image?url=%2Fa.png&w=64", "https://site.example/a.png"),
        ("https://n.example/front/agentTop.png?v=2", None), ("https://cdn.example/a.jpg?w=400&sig=abcdef", None), ("https://cdn.example/resize?w=400", None), ("https://cdn.unknown.example/a/photo.jpg?rect=0,0,100,100", None),
        ("https://res.cloudinary.com/x/image/upload/s--abcdefgh--/w_300/a.jpg", None), ("https://assets.imgix.net/a.jpg?w=320&s=abcdef", None), ("https://res.cloudinary.com/acme/image/upload/img_light/logo.svg", None),
        ("https://i0.wp.com/.example/a.jpg", None), ("data:image/png;base64,AAAA", None), ("https://a.example/_next/image?url=javascript%3Aalert(1)", None), ("https://i0.wp.com/" + "a." * 100_000, None), ("https://s.example/a" + "_hu00000000_1_x_fit" * 9000 + "-", None), (None, None),
    ],
)
def test_originals(url, want):
    assert next(iter(originals(url, PAGE)), None) == want


def test_originals_by_depth_and_server():
    wrapped = "https://w.example/_next/image?url=https%3A%2F%2Fimages.ctfassets.net%2Fs%2Fc.png%3Fw%3D400%26fm%3Davif&w=1920"
    assert originals(wrapped) == ["https://images.ctfassets.net/s/c.png", "https://images.ctfassets.net/s/c.png?w=400&fm=avif"]
    assert originals("https://own.example/s/c?w=400", server="Contentful Images API") == ["https://own.example/s/c"]


def test_variant_keys():
    for a, b in (("https://a.com/hero_small_2x.jpg", "https://a.com/hero_large.jpg"), ("https://a.com/x.png?w=300&q=80", "https://a.com/x.png?w=1200"), ("https://a.com/s-100w.webp", "https://a.com/s-1500w.webp"), ("https://s.example/_next/image?url=%2Fa.png&w=640", "https://s.example/a.png")):
        assert variant_key(a) == variant_key(b)
    for a, b in (("https://a.com/x.png", "https://a.com/x.jpg"), ("https://a.com/x.png?id=1", "https://a.com/x.png?id=2"), ("https://a.com/apple-touch-icon-180.png", "https://a.com/apple-touch-icon-152.png")):
        assert variant_key(a) != variant_key(b)
    assert variant_key("https://is1-ssl.mzstatic.com/image/thumb/AAA/220x54.png") == "https://is1-ssl.mzstatic.com/image/thumb/AAA"


def test_base_names():
    want = {"https://a.com/img/hero-banner.3f9ab1c2e4.png": "hero-banner", "https://a.com/x/Logo_large_2x.svg": "Logo", "https://a.com/6964d40aecc2aafdea1a8419_mcc-logo.svg": "mcc-logo", "https://b.example.com/CDrbG9w8RVujxhmrDWHJ.png": None, "https://a.com/HeroBackground2x.png": "HeroBackground2x", "https://a.com/caf%C3%A9.png": "café", "data:x": None, None: None}
    assert {k: names.base_name(k) for k in want} == want


def test_display_names():
    name = lambda **row: names.display_name({"kind": "image", "role": "image", "kind_index": 3, "site": "Acme", **row})
    assert [name(), name(label="  Our\nteam "), name(role="favicon"), name(link_text="Go"), name(base_name="hero"), name(link_href="https://a.com/customers/hertz-rental"), name(link_href="https://a.com/customers"), name(markup='<g id="bsport-linear-gradient-a">'), name(label="https://x.y")] == ["image 3", "Our team", "Acme favicon", "Go", "hero", "hertz rental", "image 3", "bsport", "image 3"]
    assert name(label="Acme logo", link_text="Acme Academy") == "Acme Academy" and name(json_ld=True, role="site-logo") == "Acme logo"
    assert len(names.usable("word " * 40)) == 79


def test_file_names(spark):
    rows = [(1, i, n, e, "Acmé Co") for i, (n, e) in enumerate([("Hero", "png"), ("hero!", "png"), ("Acmé co logo", "svg"), ("", "jpg"), ("Ünï 日本", "png"), ("x" * 100, "webp"), ("x" * 100, "webp")])] + [(2, 0, "Hero", "png", None)]
    got = names.with_file_names(spark.createDataFrame(rows, "page_id long, ord long, name string, extension string, site string"), [F.asc("ord")])
    assert [r["filename"] for r in got.orderBy("page_id", "ord").collect()] == ["acme-co-hero.png", "acme-co-hero-2.png", "acme-co-logo.svg", "acme-co.jpg", "acme-co-uni-日本.png", "acme-co-" + "x" * 67 + ".webp", "acme-co-" + "x" * 65 + "-2.webp", "site-hero.png"]
