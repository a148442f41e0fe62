"""Scans as rows: lookups, manifests, output limits, brand files, steps, summaries."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import pictures, rules, urls
from ..session import reachable
from . import folds

# Fixed values.
STEPS = ("queue", "open", "scroll", "collect", "process")
MOST_BRAND_FILES, MOST_SCRIPT_PATHS, MOST_PROBES, MOST_SUMMARY_BYTES = 16, 64, 150, 4096
FILE_LITERAL = r"""(?i)(["'`])((?:https?://[^\s"'`<>\\?#]{1,300}?|/[^\n"'`<>\\?#]{0,300}?)\.(?:zip|pdf|ai|eps|svg|png))(?:[?#][^\s"'`<>\\]{0,200})?\1"""
TRIMMED = ("warnings", "fonts", "brand_files", "logos", "palette")


def page_key(url: Column) -> Column:
    """What two addresses of one page share: scheme, host without www, path without slashes at its end, query."""
    return F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)), rules.display_host(url), F.regexp_replace(rules.url_path(url), "/+$", ""), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))


def recent_scans(scans: DataFrame, wanted: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """url, origin and scan_id of the newest scan of each wanted page (url, origin) that is from the same origin and younger than the TTL; the first url of a scan that fits counts."""
    young = scans.filter((F.unix_timestamp("scanned_at") >= F.unix_timestamp(now) - ttl_seconds) & (F.unix_timestamp("scanned_at") <= F.unix_timestamp(now)))
    known = young.select("scan_id", "origin", "scanned_at", F.explode(F.array_distinct(F.array(page_key(F.col("url")), page_key(F.col("final_url"))))).alias("key"))
    best = known.groupBy("origin", "key").agg(F.max_by("scan_id", F.struct("scanned_at", "scan_id")).alias("scan_id"))
    asked = wanted.select("url", "origin").distinct().withColumn("key", page_key(F.col("url")))
    return asked.join(best, ["origin", "key"]).select("url", "origin", "scan_id")


def manifest_rows(kept: DataFrame, profile: str = "deck", explicit: bool = False) -> DataFrame:
    """What a manifest says of each file."""
    why = F.lit("explicit id") if explicit else F.concat(F.lit(f"{profile} profile (role "), F.col("role"), F.lit(")"))
    return kept.select("page_id", "id", "name", F.col("filename").alias("file"), "url", "kind", "role", "format", "bytes", why.alias("kept_because"))


def merged_manifest(new: DataFrame, earlier: DataFrame, present: DataFrame) -> DataFrame:
    """The new rows, and the earlier ones whose file no new row has and that is still there."""
    old = earlier.join(new.select("file"), "file", "left_anti").join(present.select("file"), "file", "left_semi")
    return new.unionByName(old)


def fitted(items: DataFrame, key: str, most: int, rest: Column | None = None) -> DataFrame:
    """``items`` (with list, index, url and size) that fit into ``most`` with ``rest``: repeats of a URL go first, then the largest, then the latest."""
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy("list", "index"))
    rows = items.withColumn("repeat", F.col("url").isNotNull() & (first > 1)).withColumn("total", F.sum("size").over(Window.partitionBy(key)) + (F.lit(0) if rest is None else rest))
    order = Window.partitionBy(key).orderBy(F.desc("repeat"), F.desc("size"), F.desc("index"), F.desc("list")).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum("size").over(order), F.lit(0))
    return rows.withColumn("gone", gone).filter(F.col("total") - F.col("gone") <= most).drop("repeat", "total", "gone")


def quoted_paths(script: Column, most: int = MOST_SCRIPT_PATHS) -> Column:
    """The distinct file paths and URLs that a script quotes, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(script, F.lit(FILE_LITERAL), 2)), 1, most)


def _absolute(path: Column, page_url: Column) -> Column:
    return F.when(path.rlike("(?i)^https?://"), path).otherwise(F.concat(F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), path))


def brand_files(links: DataFrame, scripts: DataFrame, known: DataFrame, most: int = MOST_BRAND_FILES) -> DataFrame:
    """page_id, place, id, url, type and found_in of the files of each page's brand kit: linked ones in page order, then those that only scripts name.

    ``links`` has page_id, page_url, ord, href, ``scripts`` page_id, page_url, script.  Two links to one file are one.  A script's archive or document needs a
    brand word in its path, a picture one in a folder's name; a picture that the page shows (``known``: page_id, url) is none."""
    linked = links.select("page_id", F.lit(0).alias("tier"), F.col("ord").cast("long").alias("ord"), _absolute(F.col("href"), F.col("page_url")).alias("url"), F.lit("link").alias("found_in"))
    named = scripts.select("page_id", "page_url", F.posexplode(quoted_paths(F.col("script"))).alias("ord", "path")).select("page_id", F.lit(1).alias("tier"), F.col("ord").cast("long").alias("ord"), _absolute(F.col("path"), F.col("page_url")).alias("url"), F.lit("script").alias("found_in"))
    rows = linked.unionByName(named).withColumn("type", urls.brand_file_type(rules.url_path(F.col("url")))).filter("type is not null")
    segments = F.filter(F.split(rules.url_path(F.col("url")), "/"), lambda s: s != "")
    word = lambda s: urls.is_brand_word(s) | s.rlike("(?i)wordmark|lockup")
    picture = F.col("type").isin("svg", "png")
    folders = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    rows = rows.filter((F.col("found_in") == "link") | F.when(picture, F.exists(folders, word)).otherwise(F.exists(segments, word)))
    one = rows.withColumn("key", urls.link_key(F.col("url"))).withColumn("n", F.row_number().over(Window.partitionBy("page_id", "key").orderBy("tier", "ord", "url"))).filter("n = 1")
    seen = known.select("page_id", F.col("url").alias("known_url")).distinct()
    fresh = one.join(seen, (one["page_id"] == seen["page_id"]) & (one["url"] == F.col("known_url")) & one["type"].isin("svg", "png"), "left_anti")
    placed = fresh.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("tier", "ord", "url")).cast("long")).filter(F.col("place") <= most)
    return placed.select("page_id", "place", F.substring(F.sha1("url"), 1, 12).alias("id"), "url", "type", "found_in")


def step_states(events: DataFrame) -> DataFrame:
    """scan_id, step and state after all events (scan_id, seq, step, state): done once it was, or once a later step starts (which a queue inside of a step never is); else active."""
    place = lambda c: F.array_position(F.array(*map(F.lit, STEPS)), c)
    seen = events.groupBy("scan_id", "step").agg(F.min("seq").alias("first"), F.max(F.col("state") == "done").alias("finished"))
    starts = events.filter((F.col("state") == "start") & (F.col("step") != "queue")).groupBy("scan_id", F.col("step").alias("later")).agg(F.max("seq").alias("started"))
    passed = seen.join(starts, "scan_id").filter((place(F.col("later")) > place(F.col("step"))) & (F.col("started") > F.col("first"))).select("scan_id", "step", F.lit(True).alias("passed")).distinct()
    out = seen.join(passed, ["scan_id", "step"], "left")
    return out.select("scan_id", "step", F.when(F.col("finished") | F.coalesce("passed", F.lit(False)), "done").otherwise("active").alias("state"))


def proxy_takes(requests: DataFrame, per_client: int, per_day: int) -> DataFrame:
    """request_id and served of byte requests (request_id, ts, client, bytes) in order: a take that would pass its client's or the day's limit is refused and takes nothing.

    A fold over a day's requests, which keeps one number for each client of the day."""

    def step(state: tuple[int, dict], row: dict) -> tuple[tuple[int, dict], int]:
        shared, clients = state if state else (0, {})
        own = clients.get(row["client"], 0)
        fits = own + row["bytes"] <= per_client and shared + row["bytes"] <= per_day
        if fits:
            clients[row["client"]] = own + row["bytes"]
            shared += row["bytes"]
        return (shared, clients), int(fits)

    rows = requests.select(F.to_date("ts").cast("string").alias("day"), "ts", "request_id", F.struct("client", F.coalesce("bytes", F.lit(0)).alias("bytes")).alias("take"))
    return folds.folded(rows, "day", [F.asc("ts"), F.asc("request_id")], "take", None, step, "n").select("request_id", (F.col("n") == 1).alias("served"))


def ttl_counts(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """``events`` (key, at in seconds, id) with n: the counter's value, which starts anew with the first event after its time is up."""

    def step(state: tuple[int, int] | None, at: int) -> tuple[tuple[int, int], int]:
        began, n = state if state and at < state[0] + ttl_seconds else (at, 0)
        return (began, n + 1), n + 1

    return folds.folded(events.select("key", "at", "id"), "key", [F.asc("at"), F.asc("id")], "at", None, step, "n")


def near_duplicates(prints: DataFrame, order: list[Column]) -> DataFrame:
    """``prints`` (page_id, id, hash, aspect, thumb) with leader: in the order of preference, a picture joins the first leader that shows the same, or leads.

    A fold over a page's pictures, which keeps its leaders.  A picture without a hash leads none and joins none (null)."""

    def same(a: dict, b: dict) -> bool:
        if bin(int(a["hash"], 16) ^ int(b["hash"], 16)).count("1") > pictures.MOST_DISTANCE or abs(a["aspect"] - b["aspect"]) > pictures.MOST_DRIFT * max(a["aspect"], b["aspect"]):
            return False
        pairs = list(zip(a["thumb"], b["thumb"], strict=True)) if len(a["thumb"]) == len(b["thumb"]) else []
        return bool(pairs) and (sum((x - y) ** 2 for x, y in pairs) / len(pairs)) ** 0.5 <= pictures.MOST_RMSE

    def step(leaders: tuple, row: dict) -> tuple[tuple, int | None]:
        if row["hash"] is None:
            return leaders, None
        for i, leader in enumerate(leaders):
            if same(leader, row):
                return leaders, i
        return (*leaders, row), len(leaders)

    rows = prints.withColumn("print", F.struct("hash", "aspect", "thumb"))
    numbered = folds.folded(rows, "page_id", order, "print", (), step, "group").drop("print")
    first = F.first("id").over(Window.partitionBy("page_id", "group").orderBy(*order))
    return numbered.withColumn("leader", F.when(F.col("group").isNotNull(), first)).drop("group")


def probe_budget(rows: DataFrame, most: int = MOST_PROBES) -> DataFrame:
    """``rows`` with probe: whether a declared file that was not captured is checked, in the order of provisional scores, or passed over."""
    need = F.col("needs_probe")
    place = F.row_number().over(Window.partitionBy("page_id", need).orderBy(F.desc("score"), "ord", "id"))
    return rows.withColumn("probe", F.when(need, place <= most).otherwise(False))


def blob_bytes(records: DataFrame, bodies: DataFrame, blobs: DataFrame) -> DataFrame:
    """Records of blob: URLs with their bytes: of the network's body, else of what the page read."""
    one, two = (df.select("page_id", "url", F.col("bytes").alias(n)) for df, n in ((bodies, "body"), (blobs, "blob")))
    return records.join(one, ["page_id", "url"], "left").join(two, ["page_id", "url"], "left").withColumn("bytes", F.coalesce("body", "blob")).drop("body", "blob")


def wordmark_assets(marks: DataFrame, assets: DataFrame) -> DataFrame:
    """page_id and asset_id of each page's wordmark picture, by its drawing's hash or its element group: the most relevant asset of several."""
    by = lambda column: marks.filter(F.col(column).isNotNull()).join(assets.select("page_id", "id", "score", "ord", column), ["page_id", column]).select("page_id", "id", "score", "ord")
    found = by("svg_hash").unionByName(by("grp"))
    return found.groupBy("page_id").agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), "ord", "id")).alias("asset_id"))


def selected_range(items: DataFrame, ends: DataFrame) -> DataFrame:
    """page_id and id of the visible items (page_id, id, item) between two of them (page_id, a, b), both included, whichever comes first."""
    at = lambda c: items.select("page_id", F.col("id").alias(c), F.col("item").alias(f"at_{c}"))
    spans = ends.join(at("a"), ["page_id", "a"]).join(at("b"), ["page_id", "b"]).select("page_id", F.least("at_a", "at_b").alias("lo"), F.greatest("at_a", "at_b").alias("hi"))
    return items.join(spans, "page_id").filter(F.col("item").between(F.col("lo"), F.col("hi"))).select("page_id", "id").distinct()


def toggled(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """The selection with each of ``ids`` taken out if it is in, and put in if it is not."""
    return selection.join(ids, ["page_id", "id"], "left_anti").unionByName(ids.join(selection, ["page_id", "id"], "left_anti"))


@F.pandas_udf(StringType())
def _fit(document: pd.Series) -> pd.Series:
    """JSON documents of MOST_SUMMARY_BYTES at most: rows of the lists go from their ends, one list after the other."""

    def one(text: str | None) -> str | None:
        if text is None or len(text.encode()) <= MOST_SUMMARY_BYTES:
            return text
        found = json.loads(text)
        dump = lambda: json.dumps(found, ensure_ascii=False, separators=(",", ":"))
        for name in TRIMMED:
            while found.get(name) and len(dump().encode()) > MOST_SUMMARY_BYTES:
                found[name].pop()
                if name == "logos":
                    found["other_assets"] = found["counts"]["assets"] - len(found["logos"])
        return dump()

    return document.map(one)


def summaries(assets: DataFrame, palette: DataFrame, families: DataFrame, hidden: DataFrame) -> DataFrame:
    """page_id and summary: a JSON document of counts, the eight most relevant logos, twelve swatches and twelve fonts, within 4,096 bytes.

    Each list is cut by rank before it is collected."""
    top = lambda df, order, n: df.withColumn("at", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).filter(F.col("at") <= n)
    listed = lambda df, name, *columns: df.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(*columns).alias("x")))), lambda e: e["x"]).alias(name))
    logos = listed(top(assets.filter(F.col("role").isin("site-logo", "logo")), [F.desc("score"), "ord", "id"], 8), "logos", "id", F.substring("name", 1, 80).alias("name"), "kind", "format", "bytes")
    swatches = listed(top(palette, ["place"], 12), "palette", "hex", "role")
    fonts = listed(top(families, [F.desc("usage"), "id"], 12), "fonts", F.col("name").alias("family"), "used_on_page")
    counts = assets.groupBy("page_id").agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("kind") == "svg").alias("svg"), F.count_if(F.col("kind") == "image").alias("images"))
    out = counts.join(families.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_fonts")), "page_id", "left").join(hidden.groupBy("page_id").agg(F.sum("n").alias("hidden")), "page_id", "left")
    for part in (logos, swatches, fonts):
        out = out.join(part, "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    document = F.struct(F.struct("assets", "svg", "images", zero("n_fonts").alias("fonts"), zero("hidden").alias("hidden")).alias("counts"), F.coalesce("palette", F.array()).alias("palette"), F.coalesce("fonts", F.array()).alias("fonts"), F.coalesce("logos", F.array()).alias("logos"), (F.col("assets") - F.greatest(F.size(F.coalesce("logos", F.array())), F.lit(0))).alias("other_assets"))
    return out.select("page_id", _fit(F.to_json(document)).alias("summary"))


def archive_entries(archives: DataFrame, most_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """path, entry, bytes, reason and content of each entry of ZIP files (path, content): a reason for what is not read (folder, encrypted, unsafe-path, too-large, broken), content for what is.

    An archive that is none gives one row with the reason not-an-archive; entries are read one at a time."""
    reachable(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "entry", "bytes", "reason", "content"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    yield one(path, None, None, "not-an-archive", None)
                    continue
                for info in archive.infolist():
                    parts = info.filename.replace("\\", "/").split("/")
                    unsafe = info.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]
                    reason = "folder" if info.is_dir() else "encrypted" if info.flag_bits & 1 else "unsafe-path" if unsafe else "too-large" if info.file_size > most_bytes else None
                    data = None
                    if reason is None:
                        try:
                            data = archive.read(info)
                        except (zipfile.BadZipFile, NotImplementedError, OSError, EOFError):
                            reason = "broken"
                    yield one(path, info.filename, info.file_size, reason, data)

    return archives.select("path", "content").mapInArrow(run, "path string, entry string, bytes long, reason string, content binary")
