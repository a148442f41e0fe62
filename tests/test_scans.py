"""Folds over scans against plain loops, archives, and summaries."""

import datetime
import io
import json
import zipfile

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pagewright import catalog
from pagewright.operators import palette as palettes
from pagewright.operators import scans


def test_proxy_takes_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), int(rng.integers(5)), int(rng.integers(1, 60)) if i % 17 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, day long, client long, bytes long").withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400 + F.col("request_id")))
    shared, own, want = {}, {}, {}
    for i, day, client, n in sorted(rows, key=lambda r: (r[1], r[0])):
        n = n or 0
        want[i] = own.get((day, client), 0) + n <= 300 and shared.get(day, 0) + n <= 1000
        if want[i]:
            own[day, client] = own.get((day, client), 0) + n
            shared[day] = shared.get(day, 0) + n
    assert {r["request_id"]: r["served"] for r in scans.proxy_takes(df, 300, 1000).collect()} == want and len(set(want.values())) == 2


def test_near_duplicate_pictures_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, base = [], [rng.integers(0, 2, 256) for _ in range(4)]
    thumbs = [rng.integers(0, 256, 64) for _ in range(4)]
    for i in range(60):
        k = i % 4
        bits = base[k].copy()
        bits[rng.integers(0, 256, int(rng.integers(0, 30)))] ^= 1
        rows.append((i % 3, i, None if i % 13 == 0 else f"{int(''.join(map(str, bits)), 2):064x}", 1.5 if i % 7 else 2.0, np.clip(thumbs[k] + rng.integers(-2, 3, 64) * (1 if i % 5 else 4), 0, 255).tolist()))
    want = {}
    for page in range(3):
        leaders = []
        for p, i, h, aspect, thumb in rows:
            if p != page:
                continue
            if h is None:
                want[i] = None
                continue
            for j, h2, a2, t2 in leaders:
                far = bin(int(h, 16) ^ int(h2, 16)).count("1")
                if far <= 20 and abs(aspect - a2) / max(aspect, a2) <= 0.15 and np.sqrt(np.mean((np.array(thumb) - t2) ** 2)) <= 3:
                    want[i] = j
                    break
            else:
                leaders.append((i, h, aspect, np.array(thumb)))
                want[i] = i
    got = scans.near_duplicates(spark.createDataFrame(rows, "page_id long, id long, hash string, aspect double, thumb array<long>"), [F.asc("id")])
    assert {r["id"]: r["leader"] for r in got.collect()} == want and any(a != b and b is not None for a, b in want.items())


def test_archive_entries(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/logo.svg", "<svg/>")
        z.writestr("../evil.txt", "x")
        z.writestr("b/", "")
        z.writestr("big.bin", b"0" * 500)
    df = spark.createDataFrame([("kit.zip", bytearray(out.getvalue())), ("no.zip", bytearray(b"junk")), ("null.zip", None)], "path string, content binary")
    got = {(r["path"], r["entry"]): (r["reason"], r["content"] and bytes(r["content"])) for r in scans.archive_entries(df, 400).collect()}
    assert got == {("kit.zip", "a/logo.svg"): (None, b"<svg/>"), ("kit.zip", "../evil.txt"): ("unsafe-path", None), ("kit.zip", "b/"): ("folder", None), ("kit.zip", "big.bin"): ("too-large", None), ("no.zip", None): ("not-an-archive", None), ("null.zip", None): ("not-an-archive", None)}


def test_summaries_fit(spark):
    rows = [(1, f"id{i}", "logo" if i < 20 else "image", "svg", "image", "n" * 400 if i < 20 else "x", 5, 1.0 * i, i) for i in range(30)]
    assets = spark.createDataFrame(rows, "page_id long, id string, role string, format string, kind string, name string, bytes long, score double, ord long")
    palette = spark.createDataFrame([(1, i, f"#{i:06x}", None) for i in range(20)], "page_id long, place long, hex string, role string")
    families = spark.createDataFrame([(1, f"f{i}", "F" * 300, 0.1, True) for i in range(20)], "page_id long, id string, name string, usage double, used_on_page boolean")
    got = scans.summaries(assets, palette, families, spark.createDataFrame([(1, "tracker", 3)], "page_id long, reason string, n long")).collect()
    text = json.loads(got[0]["summary"])
    assert len(got) == 1 and len(got[0]["summary"].encode()) <= 4096 and text["counts"] == {"assets": 30, "svg": 0, "images": 30, "fonts": 20, "hidden": 3}
    assert len(text["logos"]) == 8 and text["other_assets"] == 22 and len(text["palette"]) == 12 and 0 < len(text["fonts"]) < 12


def test_summary_of_a_page_without_a_palette(spark):
    assets = spark.createDataFrame([(p, f"id{p}", "image", "png", "image", "x", 5, 1.0, 1) for p in (1, 2)], "page_id long, id string, role string, format string, kind string, name string, bytes long, score double, ord long")
    colors = spark.createDataFrame([(1, "bg", "#ffffff", 9.0, 5), (2, "pix", "#ff0000", 1.0, 1)], "page_id long, source string, hex string, weight double, n long")
    families = spark.createDataFrame([], "page_id long, id string, name string, usage double, used_on_page boolean")
    got = scans.summaries(assets, palettes.build_palettes(colors), families, spark.createDataFrame([], "page_id long, reason string, n long")).collect()
    assert {r["page_id"]: [x["hex"] for x in json.loads(r["summary"])["palette"]] for r in got} == {1: ["#ffffff"], 2: []}


def test_ttl_counters_round_as_the_sql_does(spark, tmp_path):
    start, path = datetime.datetime(2024, 1, 1), f"{tmp_path}/events.parquet"
    seconds = [0.6, 259_200.2, 0.5, 259_200.4, 1.5, 259_202.4, 0.4, 259_199.5]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
        con.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', 1)", [(i, start + datetime.timedelta(seconds=s), i // 2) for i, s in enumerate(seconds)])
        con.execute(f"COPY events TO '{path}'")
        want = dict(con.execute(catalog.oracle_sql()["t8_ttl_counters"]).fetchall())
    got = {r["id"]: r["n"] for r in catalog.queries()["t8_ttl_counters"](spark, str(tmp_path)).collect()}
    assert got == want and want[1] == 2
