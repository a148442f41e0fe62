from pyspark.sql import functions as F

from pagewright.functions import parsers, rules
from pagewright.operators import palette
from pagewright.sources import ndjson
from pagewright.streaming import admission


def column(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression).first()[0]


def test_srcset():
    assert parsers.parse_srcset("a.png 1x, b.png 2x") == [{"url": "a.png", "w": None, "x": 1.0}, {"url": "b.png", "w": None, "x": 2.0}]
    assert [c["w"] for c in parsers.parse_srcset("a,b.png 300w,c.png 600w")] == [300.0, 600.0]
    assert parsers.parse_srcset("a.png, b.png") == [{"url": "a.png", "w": None, "x": 1.0}, {"url": "b.png", "w": None, "x": 1.0}]
    assert parsers.parse_srcset(None) == parsers.parse_srcset("  ") == []


def test_css_urls():
    css = """/* url(no.png) */ a{background:url("a.png#f") , url( b.png )} b{content:"url(c.png)"} c{background:url(a.png)}"""
    assert parsers.css_urls(css) == ["a.png", "b.png"]
    assert parsers.css_urls(None) == []


def test_font_faces():
    css = "@font-face{font-family:'Inter';src:url(i.woff2) format('woff2'),local('Inter');font-weight:bold;unicode-range:U+0-FF} @font-face{src:url(x.woff)}"
    (face,) = parsers.font_faces(css)
    assert face["family"] == "Inter" and face["weight"] == "bold"
    assert face["sources"] == [{"url": "i.woff2", "format": "woff2", "local": None}, {"url": None, "format": None, "local": "Inter"}]


def test_entities_and_percent():
    assert parsers.decode_entities("&amp;lt; &#65;&#x42; &copy;") == "&lt; AB &copy;"
    assert parsers.percent_decode("a%20b%zz%") == b"a b%zz%"


def test_head_tags():
    page = "<!-- <title>no</title> --><title>A &amp; B</title><link rel='shortcut icon' href=/i.ico><meta property=og:image content='x.png'>"
    assert parsers.head_tags(page) == {"title": "A & B", "icons": ["/i.ico"], "social": ["x.png"]}


def test_size_score(spark):
    score = lambda **v: column(spark, rules.size_score(*[F.lit(v.get(k)).cast("double") for k in ("decoded", "natural", "declared", "w", "x", "b")]), one=1)
    assert [score(natural=10000.0), score(w=100.0), score(x=2.0), score(b=500000.0), score()] == [10000.0, 6000.0, 2.0, 0.5, 0.0]


def test_latin_ranges(spark):
    rows = [("U+0000-00FF", True), ("U+0100-024F", False), (None, True), ("U+4?, U+6?", True), ("U+41", False), ("junk", True)]
    got = spark.createDataFrame(rows, "d string, want boolean").select(rules.covers_latin(F.col("d")), "want").collect()
    assert all(a == b for a, b in got)


def test_license(spark):
    assert column(spark, rules.license_kind(F.lit("self-hosted"), F.col("c"), F.lit(""), F.lit(None).cast("string")), c="SIL Open Font License") == "open"
    assert column(spark, rules.license_kind(F.lit("self-hosted"), F.col("c"), F.lit(""), F.lit("")), c="") == "unknown"


def test_clusters_join_near_colors(spark):
    rows = [(1, "cta", "#0047f0", 50.0, 5), (1, "cta", "#0049f2", 10.0, 1), (1, "cta", "#e02020", 40.0, 4)]
    got = palette.clusters(palette.salience(spark.createDataFrame(rows, "page_id long, source string, hex string, weight double, n long"))).collect()
    assert sorted((r["hex"], r["members"]) for r in got) == [("#0047f0", 2), ("#e02020", 1)]


def test_oversized_row_is_alone_in_its_batch(spark):
    rows = [(1, i, b) for i, b in enumerate([3, 4, 20, 1, 9])]
    got = ndjson.batches(spark.createDataFrame(rows, "page_id long, ord long, b long"), "page_id", ["ord"], "b", 10)
    assert [r["batch"] for r in got.orderBy("ord").collect()] == [0, 0, 1, 2, 2]


def test_stream_admits_what_the_batch_admits(spark, tmp_path):
    rows = [(i, 1 + i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "request_id long, client long").withColumn("ts", F.timestamp_seconds(F.col("request_id") * 60 + 1_700_000_000))
    df.write.parquet(str(tmp_path / "in"))
    stream = admission.client_admission_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), per_client=5)
    q = stream.writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r["request_id"]: r["verdict"] for r in admission.admitted(df, per_client=5).collect()}
    assert {r["request_id"]: r["verdict"] for r in spark.table("verdicts").collect()} == want
