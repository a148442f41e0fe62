"""URL rules as Column expressions: typed-in addresses, home links, link identity, brand links, public addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import display_host, url_host, url_path

# Fixed values.
OPENING, CLOSING = r"^[\s<(\[\"'`“‘«]+", r"[\s>\]\"'`”’»]"
DOMAIN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$|^localhost$"
BRAND_WORD = r"(?i)(?:^|[^a-z])(?:brand|press(?!ure)|media[- _]?kit|newsroom|identity|logo(?!ut|n(?![a-z]))|guidelines)"
STRONG_BRAND = r"(?i)(?:^|[^a-z])(?:(?:brand|media|press|logo)[- _]?(?:kits?|packs?|assets?|resources?|guidelines?|guides?|books?|manuals?|portals?|hubs?|cent(?:er|re)s?|files?|toolkits?)|(?:brand|visual)[- _]identity|identity[- _]guidelines?)(?![a-z])"
LOGO_WORD = r"logo(?!ut|n(?![a-z]))|wordmark|logotype|(?<!(?:^|[^a-z])(?:bg|text|border|ring|fill|stroke|outline|from|via|to|shadow|accent|caret|decoration|divide|placeholder)-)brand(?:s|mark)?(?![a-z\d]|[-_][a-z\d])"
PORTALS = ["frontify.com", "standards.site", "visualbook.pro", "brandfolder.com", "brandfolder.io", "brandpad.io", "corebook.io", "lingoapp.com", "bynder.com"]
BRAND_FILE = r"(?i)\.(zip|pdf|ai|eps|svg|png)$"
GENERIC_WORDS = "download downloads view open get see here click now save preview link go file files all the this and or to it a an as in format formats version zip pdf ai eps svg png jpg jpeg kb mb gb".split()


def typed_url(raw: Column) -> Column:
    """The http(s) URL that a typed or pasted address means, or null: wrappers and the punctuation behind it go, https is the scheme where none is given.

    A closing bracket goes while there are more of them than opening ones; credentials and fragments that are no routes go."""
    text = F.regexp_replace(F.trim(raw), OPENING, "")
    surplus = F.greatest(F.regexp_count(text, F.lit(r"\)")) - F.regexp_count(text, F.lit(r"\(")), F.lit(0))
    tail = F.regexp_extract(text, rf"(?:{CLOSING}|[).,;])+$", 0)
    # Of the brackets at the end the last ones are surplus: what stands behind the others goes.
    kept = F.regexp_count(tail, F.lit(r"\)")) - surplus
    end = F.when(kept > 0, F.concat(F.call_function("substring_index", tail, F.lit(")"), kept.cast("int")), F.lit(")"))).otherwise("")
    text = F.concat(F.left(text, F.length(text) - F.length(tail)), end)
    schemed = text.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~text.rlike(r"(?i)^[a-z0-9.-]+:\d+(?:[/?#]|$)")
    full = F.when(schemed, text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    port = F.regexp_extract(full, r"(?i)^https?://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
    scheme = F.lower(F.regexp_extract(full, r"(?i)^(https?)://", 1))
    rest = F.regexp_extract(full, r"(?i)^https?://[^/?#]*([^#]*)", 1)
    fragment = F.regexp_extract(full, r"(#!?/.*)$", 1)
    good = ~text.rlike(r"\s") & (scheme != "") & host.rlike(DOMAIN) & port.isin("", "80", "443")
    shown = F.when((port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(good & (text != ""), F.concat(scheme, F.lit("://"), host, shown, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)), fragment))


def is_home(href: Column, page_url: Column) -> Column:
    """Whether an absolute or root-relative link leads to the page's own home, or to that of a language."""
    h = F.trim(F.coalesce(href, F.lit("")))
    own = h.rlike("^/(?!/)")
    there = own | (display_host(h) == display_host(page_url))
    path = F.regexp_extract(F.when(own, h).otherwise(F.when(url_path(h) == "", F.lit("/")).otherwise(url_path(h))), r"^([^?#]*)", 1)
    return (h != "") & ~h.startswith("#") & there & path.rlike(r"(?i)^/(?:[a-z]{2}(?:[-_][a-z]{2,4})?/?)?$")


def link_key(url: Column) -> Column:
    """What two links to one page have in common: no fragment, credentials or slash at the path's end."""
    origin = F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)), url_host(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*(:\d+)", 1))
    path = url_path(url)
    path = F.when(path == "", F.lit("/")).when((path != "/") & path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)
    return F.concat(origin, path, F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))


def _either(text: Column, pattern: str) -> Column:
    return text.rlike(pattern) | F.regexp_replace(text, "([a-z])(?=[A-Z])", "$1 ").rlike(pattern)


def is_brand_word(text: Column) -> Column:
    return _either(text, BRAND_WORD)


def is_strong_brand(text: Column) -> Column:
    return _either(text, STRONG_BRAND)


def has_logo_word(text: Column) -> Column:
    return F.lower(text).rlike(LOGO_WORD)


def is_brand_portal(url: Column) -> Column:
    """A page of a host that serves brand books alone: of a subdomain, or under a path of the vendor's own host."""
    host, names = url_host(url), "|".join(p.replace(".", r"\.") for p in PORTALS)
    return host.rlike(rf"(?:^|\.)(?:{names})$") & (~host.rlike(rf"^(?:www\.)?(?:{names})$") | (F.regexp_replace(url_path(url), "/+$", "") != ""))


def brand_file_type(name: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(name), BRAND_FILE, 1)), F.lit(""))


def is_generic_label(text: Column) -> Column:
    """No word but those that any download button says."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    return F.forall(words, lambda w: w.isin(*GENERIC_WORDS))


def is_public_ipv4(address: Column) -> Column:
    """Whether a dotted address is one of the public internet; null for anything else."""
    parts = F.transform(F.split(address, r"\."), lambda p: p.try_cast("int"))
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    special = ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | ((a == 192) & (b == 88) & (c == 99))
    return F.when(address.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255), ~(private | special))
