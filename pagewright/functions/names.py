"""Display names and unique file names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reachable
from .originals import originals, read_url

MOST_CHARS = 80
# Fixed values.
ID_FILLER = frozenset(
    """clip clippath mask filter paint pattern gradient linear radial stop defs use path fill stroke shape vector frame group layer element lottie uuid id svg
    graphic icon image img logo logotype wordmark mark brand xmlid symbol
    capa capas calque calques ebene ebenen livello livelli laag lager camada warstwa
    rect rectangle oval ellipse circle square triangle polygon polyline star line artboard board page canvas slice combined union subtract intersect difference
    outline compound isolation mode component instance copy untitled button bouton""".split()
)
GENERIC_SEGMENT = re.compile(r"(?:[a-z]{2}(?:[-_][a-z]{2,4})?|index|home|default|page|pages|assets?|images?|img|media|static|www|v?\d+)", re.I)
HEX_HASH = re.compile(r"[.\-_](?=[0-9a-f]*\d)[0-9a-f]{8,}$", re.I)
BUILD_HASH = re.compile(r"[.\-_](?=\w*\d)(?=\w*[A-Z])(?=\w*[a-z])\w{8}$", re.A)
SIZE_END = re.compile(r"(?:_(?:xsmall|small|medium|large|xlarge|xxlarge)(?:_[23]x)?|@[23]x|_[23]x|-scaled)$", re.I)
UPLOAD_ID = re.compile(r"^(?=[0-9a-f]*\d)[0-9a-f]{16,}[-_](?=[^-_])", re.I)
ID_NOISE = re.compile(r"(?:[-_]{1,2}:[^:]*:|[-_]{1,2}[0-9a-f]{6,})$", re.I)
NOTION = re.compile(r"(?:^|\.)(?:notion\.site|notion\.so|notionusercontent\.com)$", re.I)
ROLE_NAMES = {"site-logo": "logo", "favicon": "favicon", "social": "social image"}


def usable(text: str | None) -> str | None:
    """One trimmed line without control characters, cut at a word within 80 characters; None without letters or digits, and for a URL."""
    clean = " ".join(re.sub(r"[\x00-\x1f\x7f-\x9f]+", " ", text or "").split())
    if not any(unicodedata.category(c)[0] in "LN" for c in clean) or re.match(r"[a-z][a-z0-9+.-]*://", clean, re.I):
        return None
    if len(clean) <= MOST_CHARS:
        return clean
    space = clean.rfind(" ", 0, MOST_CHARS + 1)
    return clean[: space if space > MOST_CHARS / 2 else MOST_CHARS].strip()


def reads_as_random(run: str) -> bool:
    """Few vowels, five consonants in a row, or digits in several places with two capitals side by side."""
    letters = re.sub("[^a-z]", "", run.lower())
    rare = len(re.findall("[aeiou]", letters)) < 0.22 * len(letters)
    return rare or bool(re.search("[bcdfghjklmnpqrstvwxz]{5}", run, re.I)) or bool(re.search(r"\d[A-Za-z]+\d", run) and re.search("[A-Z]{2}", run))


def is_id(base: str) -> bool:
    """Nothing but a hash, an encoded blob or random letters and digits."""
    if re.search("[A-Za-z0-9]{40}", base) or re.fullmatch(r"(?=[0-9a-f]*[0-9])[0-9a-f]{16,}", base, re.I):
        return True
    mixed = re.fullmatch("[A-Za-z0-9]{16,}", base) and all(re.search(x, base) for x in ("[a-z]", "[A-Z]", "[0-9]"))
    return bool(mixed) and reads_as_random(base)


def _notion_name(host: str, path: str) -> str | None:
    """The name a file was uploaded with, which this host puts inside a segment."""
    if NOTION.search(host):
        for raw in reversed(path.split("/")):
            attached = re.fullmatch(r"attachment:[0-9a-f-]{36}:(.+)", unquote(raw), re.I)
            name = (attached[1] if attached else unquote(raw)).split("/")[-1]
            if re.search(r"\.[a-z0-9]{2,5}$", name, re.I):
                return name
    return None


def base_name(url: str | None) -> str | None:
    """The name of an http(s) URL's file, unwrapped, without extension, hashes and size suffixes."""
    if not url or not re.match("https?:", url, re.I):
        return None
    u = read_url(next(iter(originals(url)), url))
    if not u:
        return None
    segment = _notion_name(u.host, u.path) or unquote(next((x for x in reversed(u.path.split("/")) if x), ""))
    base = UPLOAD_ID.sub("", re.sub(r"\.[a-z0-9]{1,5}$", "", segment, flags=re.I))
    for end in (HEX_HASH, BUILD_HASH, HEX_HASH, BUILD_HASH, SIZE_END):
        base = end.sub("", base)
    return None if is_id(base) else usable(base)


def href_name(href: str | None) -> str | None:
    """The last meaningful path segment of a link that points inside a section."""
    u = read_url(href) if href and re.match("https?:", href, re.I) else None
    parts = [re.sub(r"\.[a-z0-9]{1,5}$", "", unquote(x), flags=re.I) for x in u.path.split("/")] if u else []
    telling = [x for x in parts if x and not GENERIC_SEGMENT.fullmatch(x)]
    return usable(re.sub("[-_]+", " ", telling[-1])) if len(telling) > 1 else None


def markup_name(markup: str | None) -> str | None:
    """The words of the symbol that a vector draws, else of its first telling id."""
    drawn = re.search(r'(?:xlink:)?href="#([^"]+)"', markup or "", re.I)
    for found in [drawn[1]] if drawn else re.findall(r'\bid="([^"]+)"', markup or "", re.I):
        spaced = re.sub(r"([a-z\d])(?=[A-Z])", r"\1-", ID_NOISE.sub("", found))
        words = (re.sub(r"(?<!\d)\d+$", "", w).lower() for w in re.split(r"[-_\s]+", spaced))
        name = usable(" ".join(w for w in words if len(w) > 1 and w not in ID_FILLER))
        if name:
            return name
    return None


def _bare(text: str) -> str:
    return " ".join(re.sub(r"\b(?:logo(?:type)?|wordmark)\b", " ", text.lower()).split())


def _sub_brand(label: str | None, link: str | None, site: str | None, role: str) -> str | None:
    """The link's text, where the label names the site alone and the link one of its brands."""
    if not (label and link and site) or role == "site-logo":
        return None
    return link if _bare(label) == _bare(site) and link.lower() != _bare(site) and _bare(site) in link.lower() else None


def display_name(row: dict) -> str:
    """The first that is usable of what stands on, in and around an asset; else its kind and number.

    ``row`` has kind, role, kind_index, site and, where known, label, json_ld, link_text, base_name, ancestor_label, link_href, markup and nearby_text."""
    get = row.get
    site, role, label, link = usable(get("site")), get("role") or "", usable(get("label")), usable(get("link_text"))
    from_role = f"{site} {ROLE_NAMES[role]}" if site and role in ROLE_NAMES else None
    choices = (
        lambda: _sub_brand(label, link, site, role), lambda: label, lambda: f"{site} logo" if get("json_ld") and site and role == "site-logo" else None, lambda: from_role, lambda: link,
        lambda: get("base_name"), lambda: usable(get("ancestor_label")), lambda: href_name(get("link_href")), lambda: markup_name(get("markup")), lambda: usable(get("nearby_text")),
    )
    return next((name for name in (choice() for choice in choices) if name), f"{'svg' if get('kind') == 'svg' else 'image'} {get('kind_index')}")


def slug(text: str | None) -> str:
    """Lower-case words joined by dashes; Latin letters lose their accents, other scripts keep theirs."""
    kept, latin = [], False
    for c in unicodedata.normalize("NFKD", text or ""):
        if unicodedata.category(c)[0] != "M":
            latin = unicodedata.name(c, "").startswith("LATIN")
        elif latin:
            continue
        kept.append(c)
    plain = unicodedata.normalize("NFC", "".join(kept)).lower()
    return "-".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in plain).split())


def file_base(name: str | None, site: str | None) -> str:
    """The slug of a name behind the slug of its site, unless it starts with it."""
    front, own = slug(site) or "site", slug(name)
    return front if not own or own == front else own if own.startswith(f"{front}-") else f"{front}-{own}"


def file_names(stream: Iterator[tuple], most: int = MOST_CHARS) -> Iterator[str]:
    """File names for (page, name, extension, site) in order: within 80 characters, and unique on a page by -2, -3 and so on."""
    page, used, upto = None, set(), {}
    for at, name, extension, site in stream:
        if at != page:
            page, used, upto = at, set(), {}
        base, end = file_base(name, site), slug(extension) or "bin"
        n = upto.get((base, end), 1)  # the numbers below are taken
        while True:
            suffix = f"-{n}" if n > 1 else ""
            found = f"{base[: most - len(suffix) - len(end) - 1].rstrip('-')}{suffix}.{end}"
            if found not in used:
                break
            n += 1
        upto[base, end] = n
        used.add(found)
        yield found


INPUTS = "kind role kind_index site label json_ld link_text base_name ancestor_label link_href markup nearby_text".split()


def named(assets: DataFrame) -> DataFrame:
    """``assets`` with name; reads those of INPUTS that there are."""
    reachable(assets.sparkSession)
    inputs = [c for c in INPUTS if c in assets.columns]
    at = [assets.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in at), strict=True)
            got = pa.array([display_name(dict(zip(inputs, row, strict=True))) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, "name"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in assets.schema.fields)
    return assets.mapInArrow(run, f"{schema}, name string")


def with_file_names(assets: DataFrame, order: list) -> DataFrame:
    """``assets`` (page_id, name, extension, site) with filename: a page's names are given out in ``order``; a task holds one page's names."""
    reachable(assets.sparkSession)
    columns = assets.columns
    at = [columns.index(c) for c in ("page_id", "name", "extension", "site")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = file_names(iter(held.pop, None))
        for batch in batches:
            got = []
            for row in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                held.append(row)
                got.append(next(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*columns, "filename"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in assets.schema.fields)
    return assets.repartition("page_id").sortWithinPartitions("page_id", *order).mapInArrow(run, f"{schema}, filename string")


def host_folder(host):
    """A host as a folder name: other characters than letters, digits, dots and dashes become dashes."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(host), r"[^a-z0-9.-]+", "-"), r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("site"))
