"""Scalar rules as Column expressions: formats, hosts, noise, roles, scores, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIME_FORMATS = {
    "image/svg+xml": "svg", "image/png": "png", "image/apng": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/pjpeg": "jpg", "image/webp": "webp",
    "image/avif": "avif", "image/gif": "gif", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "image/ico": "ico", "image/bmp": "bmp", "image/x-ms-bmp": "bmp",
}
EXTENSION_FORMATS = {"svg": "svg", "png": "png", "apng": "png", "jpg": "jpg", "jpeg": "jpg", "jfif": "jpg", "webp": "webp", "avif": "avif", "gif": "gif", "ico": "ico", "cur": "ico", "bmp": "bmp"}
TRACKER_HOSTS = """
google-analytics.com googletagmanager.com doubleclick.net googleadservices.com googlesyndication.com adservice.google.com
facebook.com facebook.net bat.bing.com clarity.ms px.ads.linkedin.com snap.licdn.com analytics.twitter.com t.co
ads-twitter.com ct.pinterest.com analytics.tiktok.com sc-static.net tr.snapchat.com alb.reddit.com hotjar.com hotjar.io
segment.io segment.com mixpanel.com amplitude.com heapanalytics.com fullstory.com mc.yandex.ru scorecardresearch.com
quantserve.com adnxs.com criteo.com criteo.net taboola.com outbrain.com rlcdn.com demdex.net omtrdc.net
everesttech.net bluekai.com krxd.net adsrvr.org rubiconproject.com pubmatic.com casalemedia.com agkn.com liadm.com
bidswitch.net mathtag.com tapad.com zemanta.com mktoresp.com marketo.net track.hubspot.com hs-analytics.net
hsforms.com bounceexchange.com cquotient.com dotomi.com ads.yahoo.com analytics.yahoo.com
sentry.io datadoghq.com browser-intake-datadoghq.com nr-data.net newrelic.com pardot.com pi.pardot.com qualaroo.com
rs6.net pinimg.com/ct cloudflareinsights.com plausible.io usefathom.com posthog.com intercomcdn.com/tracking
adroll.com bizible.com bizographics.com clearbit.com clearbitscripts.com g2crowd.com sharethis.com addthis.com
rudderstack.com attn.tv klaviyo.com/onsite trustpilot.com/stats smartlook.com mouseflow.com crazyegg.com vwo.com
optimizely.com demandbase.com 6sc.co reb2b.com cookieyes.com/log tiktokw.us ipredictive.com contentsquare.net
""".split()
CONSENT_HOSTS = """
cookielaw.org onetrust.com cookiebot.com privacy-mgmt.com usercentrics.eu privacy-center.org osano.com trustarc.com
termly.io iubenda.com didomi.io consentmanager.net cookieyes.com transcend.io ketch.com truste.com
""".split()
WIDGET_HOSTS = """
intercom.io intercomassets.com intercomcdn.com driftt.com drift.com zdassets.com zendesk.com crisp.chat tawk.to
livechatinc.com hubspot.com/conversations usemessages.com gstatic.com/recaptcha hcaptcha.com challenges.cloudflare.com
maps.googleapis.com maps.gstatic.com ytimg.com i.vimeocdn.com
""".split()
TRACKING_PATH = r"(?i)/(?:tr|collect|pixel|beacon|track|impression|__imp|b/ss|g/collect|j/collect)(?:/|\?|$)"
SPACER = r"(?i)/(?:pixel|spacer|blank|transparent|clear|1x1|trans|empty)\.(?:gif|png)$"
BLANK = r"(?i)/blank\.(?:jpe?g|webp|svg)$"
DRAWABLE = r"(?i)<(?:path|circle|rect|ellipse|line|polyline|polygon|text|image|use)\b"
CHALLENGE_TITLE = r"(?i)\b(?:just a moment|attention required|access to this page has been denied|are you a robot|verify you are (a )?human|please verify you are a human|pardon our interruption|checking your browser)\b"
GENERIC_CHALLENGE_TITLE = r"(?i)\b(?:access denied|request unsuccessful|security check|one more step)\b"
CHALLENGE_MARKUP = r"(?i)cf-chl-|/cdn-cgi/challenge-platform/|captcha-delivery\.com|px-captcha|_Incapsula_Resource|perimeterx\.net|_pxAppId|ak-challenge|sec-cpt"
CAPTCHA = r"(?i)hcaptcha|recaptcha|turnstile"
OPEN_LICENSE = r"(?i)SIL Open Font License|\bOFL\b|openfontlicense|scripts\.sil\.org/OFL|Apache License|Ubuntu Font Licen[cs]e"
VARIANT_SUFFIX = r"[@._-](?:\d+x|\d{2,5}x\d{2,5}|large|larger|small|smaller|medium|thumb|thumbnail|scaled|resized|full|original|orig|min|hd|retina|mobile|tablet|desktop)"
#: Greatest area and length-to-width ratio of a logo, score that promotes to the site's logo, characters of a label that names a logo, side of an icon.
LOGO_AREA, LOGO_RATIO, PROMOTED, LABEL_CHARS, ICON_SIDE = 120_000, 30, 6, 60, 48
ROLE_WEIGHTS = {"site-logo": 1000.0, "logo": 500.0, "favicon": 300.0, "social": 200.0, "illustration": 100.0, "image": 100.0, "sprite-symbol": 20.0, "icon": 10.0}


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for value in sorted(set(table.values())):
        out = F.when(key.isin(*[k for k, v in table.items() if v == value]), value).otherwise(out)
    return out


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def display_host(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def site_label(url: Column) -> Column:
    """The label before the public suffix; a two-letter suffix behind a short second level (co.uk) counts as one."""
    parts = F.split(display_host(url), r"\.")
    n = F.size(parts)
    second = F.element_at(parts, F.when(n > 1, -2).otherwise(-1))
    deep = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & second.isin("co", "com", "org", "net", "gov", "edu", "ac")
    return F.when(deep, F.element_at(parts, F.when(n > 2, -3).otherwise(-1))).otherwise(second)


def format_from_url(url: Column) -> Column:
    extension = F.lower(F.regexp_extract(url_path(url), r"\.([A-Za-z0-9]+)$", 1))
    mime = F.lower(F.trim(F.regexp_extract(url, r"(?i)^data:([^;,]*)", 1)))
    return F.when(url.rlike("(?i)^data:"), _lookup(mime, MIME_FORMATS, "other")).otherwise(_lookup(extension, EXTENSION_FORMATS, "other"))


def format_of(content_type: Column, url: Column) -> Column:
    mime = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    known = _lookup(mime, MIME_FORMATS, "")
    return F.when(known != "", known).otherwise(format_from_url(url))


def in_hosts(url: Column, entries: list[str]) -> Column:
    """Equal to or under a listed host, with the entry's path prefix if it has one."""
    host, path = url_host(url), F.lower(url_path(url))
    plain = [e for e in entries if "/" not in e]
    suffix = r"(?:^|\.)(?:" + "|".join(e.replace(".", r"\.") for e in plain) + ")$"
    out = host.rlike(suffix)
    for e in (e for e in entries if "/" in e):
        name, prefix = e.split("/", 1)
        out = out | ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
    return out


def noise_reason(url: Column, content_type: Column, width: Column, height: Column, n_bytes: Column, svg_text: Column, blob_captured: Column) -> Column:
    """The first rule that makes a candidate noise, or null."""
    data, path = url.rlike("(?i)^data:"), url_path(url)
    svg = url.rlike(r"(?i)^data:image/svg")
    both = width.isNotNull() & height.isNotNull()
    small, size = both & (F.greatest(width, height) < 64), F.coalesce(n_bytes, 0.75 * F.length(url))
    kind = F.trim(F.coalesce(content_type, F.lit("")))
    blurred = svg_text.rlike("(?i)feGaussianBlur") & svg_text.rlike(r"(?i)<image\b")
    return (
        F.when(svg, F.when(svg_text.isNotNull() & (~svg_text.rlike(DRAWABLE) | blurred), "placeholder"))
        .when(data, F.when(F.coalesce(small | (size < 1024), F.lit(False)), "tiny-data-uri"))
        .when(url.rlike("(?i)^blob:"), F.when(~F.coalesce(blob_captured, F.lit(False)), "blob-unavailable"))
        .when(~url.rlike("(?i)^https?://"), "not-image")
        .when(in_hosts(url, TRACKER_HOSTS) | (path.rlike(TRACKING_PATH) & F.coalesce(width <= 2, F.lit(False))), "tracker")
        .when(path.rlike(SPACER) | path.rlike(BLANK), "spacer")
        .when(both & (width <= 2) & (height <= 2), "pixel")
        .when((kind != "") & ~kind.rlike("(?i)^image/") & ~kind.rlike("(?i)octet-stream|binary"), "not-image")
        .when(in_hosts(url, CONSENT_HOSTS), "consent")
        .when(in_hosts(url, WIDGET_HOSTS), "widget")
    )


def block_reason(status: Column, title: Column, mitigated: Column, markup: Column, elements: Column) -> Column:
    """Why a page looks like a bot wall, or null."""
    generic = title.rlike(GENERIC_CHALLENGE_TITLE)
    return (
        F.when(F.lower(F.trim(F.coalesce(mitigated, F.lit("")))) == "challenge", "cloudflare-challenge")
        .when(title.rlike(CHALLENGE_TITLE) | ((status >= 400) | (elements < 300)) & generic, "challenge-title")
        .when(((status >= 400) | (elements < 60)) & markup.rlike(CHALLENGE_MARKUP), "challenge-markup")
        .when((elements < 80) & markup.rlike(CAPTCHA), "captcha-only-page")
        .when(status.isin(403, 429, 503) & (elements < 300), F.concat(F.lit("http-"), status.cast("string")))
    )


def logo_score(logo_word: Column, home_link: Column, header: Column, nav: Column, site_word: Column, visible: Column, y: Column, footer: Column) -> Column:
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return 3 * one(logo_word) + 3 * one(home_link) + 2 * one(header | nav) + 2 * one(site_word) + one(visible & (y < 160)) + one(footer)


def size_score(decoded: Column, natural: Column, declared: Column, descriptor_w: Column, descriptor_x: Column, n_bytes: Column) -> Column:
    """The first of the sizes that is known and not 0: areas, squared width descriptor, density, megabytes."""
    known = lambda c: F.when(c > 0, c)
    return F.coalesce(known(decoded), known(natural), known(declared), known(descriptor_w * descriptor_w * 0.6), known(descriptor_x), known(n_bytes / 1e6), F.lit(0.0))


def role(kind: Column, fmt: Column, found_in: Column, logo: Column, logo_word: Column, logo_wall: Column, label: Column, sprite: Column, w: Column, h: Column, rw: Column, rh: Column, cropped: Column, partly_hidden: Column) -> Column:
    """The role of the first rule that holds; sizes are intrinsic (w, h) and rendered (rw, rh), 0 where unknown."""
    no, ico = F.lit(False), fmt == "ico"
    found = lambda *places: F.arrays_overlap(found_in, F.array(*map(F.lit, places)))
    drawn = (rw > 0) & (rh > 0)
    # What a logo can look like: of a modest area, no line, no frame of a video, whole. An area that is only intrinsic says nothing of a vector or a likely logo.
    area = F.when(drawn, rw * rh).otherwise(F.when((kind == "svg") | logo_wall | (logo >= PROMOTED), 0.0).otherwise(w * h))
    sides = [F.when(drawn, f(rw, rh)).otherwise(f(w, h)) for f in (F.greatest, F.least)]
    stripe = F.coalesce((sides[1] > 0) & (sides[0] > LOGO_RATIO * sides[1]), no)
    poster = (F.size(found_in) > 0) & (F.size(F.array_remove(found_in, "video-poster")) == 0)
    fits = (area <= LOGO_AREA) & ~(stripe | poster | partly_hidden | cropped)
    named = F.coalesce(label.rlike("(?i)logo") & (F.length(label) <= LABEL_CHARS), no)
    side = F.coalesce(F.nullif(F.greatest(rw, rh), F.lit(0.0)), F.greatest(w, h))
    table = {
        "site-logo": ~ico & (found("json-ld") | (fits & (logo >= PROMOTED))),
        "favicon": found("icon-link", "meta-icon", "manifest") | (ico & found("json-ld")),
        "social": found("og-image", "twitter-image"),
        "logo": ~ico & fits & (logo_word | logo_wall | named),
        "sprite-symbol": sprite,
        "icon": (side > 0) & (side <= ICON_SIDE),
        "illustration": kind == "svg",
    }
    return F.coalesce(*[F.when(holds, name) for name, holds in table.items()], F.lit("image"))


def relevance(role_name: Column, rw: Column, rh: Column, visible: Column, order: Column) -> Column:
    weight = F.lit(0.0)
    for name, value in ROLE_WEIGHTS.items():
        weight = F.when(role_name == name, value).otherwise(weight)
    return weight + F.when(visible, F.least(rw * rh / 1000, F.lit(90.0)) + 50).otherwise(0.0) - 0.01 * order


def small_icon(role_name: Column, rw: Column, rh: Column, w: Column, h: Column) -> Column:
    """48 px or less on its longest side, rendered if known, else intrinsic; logo, favicon and social roles are exempt."""
    side = F.when(F.greatest(rw, rh) > 0, F.greatest(rw, rh)).otherwise(F.greatest(w, h))
    return ~role_name.isin("site-logo", "logo", "favicon", "social") & (side > 0) & (side <= 48)


def normalized_name(name: Column) -> Column:
    """Without extension and, again and again, size-variant suffixes, as a lower-case slug."""
    base = F.regexp_replace(F.lower(F.trim(name)), r"\.[a-z0-9]{2,5}$", "")
    base = F.regexp_replace(base, f"(?:{VARIANT_SUFFIX})+$", "")
    return F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def format_bytes(n: Column) -> Column:
    """1024 units, a unit up before rounding would print 1000."""
    half_up = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    out = F.when(n < 999.5, F.concat(half_up(n), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / float(1024**i)
        text = F.concat(F.when(v < 9.95, F.format_string("%.1f", v)).otherwise(half_up(v)), F.lit(f" {unit}"))
        out = out.when(v < 999.5, text) if unit != "TB" else out.otherwise(text)
    return F.when(n >= 0, out).otherwise("")


def license_kind(source: Column, copyright_text: Column, description: Column, url: Column) -> Column:
    texts = F.concat_ws("\n", F.nullif(F.trim(copyright_text), F.lit("")), F.nullif(F.trim(description), F.lit("")), F.nullif(F.trim(url), F.lit("")))
    return F.when(source == "google-fonts", "open").when(source == "adobe-fonts", "commercial").when(texts.rlike(OPEN_LICENSE), "open").when(texts != "", "commercial").otherwise("unknown")


def covers_latin(descriptor: Column) -> Column:
    """A unicode-range that has both A and a; without a valid part, everything."""
    parts = F.transform(F.split(F.upper(F.coalesce(descriptor, F.lit(""))), ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: p.rlike(r"^U\+(?:[0-9A-F]{1,6}(?:-[0-9A-F]{1,6})?|[0-9A-F]{0,5}\?{1,6})$"))
    start = lambda p: F.conv(F.replace(F.regexp_extract(p, r"^U\+([0-9A-F?]+)", 1), F.lit("?"), F.lit("0")), 16, 10).cast("long")
    stop = lambda p: F.conv(F.replace(F.regexp_extract(p, r"([0-9A-F?]+)$", 1), F.lit("?"), F.lit("F")), 16, 10).cast("long")
    covers = lambda c: F.exists(good, lambda p: (start(p) <= c) & (stop(p) >= c))
    return (F.size(good) == 0) | covers(0x41) & covers(0x61)


def font_weight(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit("normal"))))
    return F.when(v.isin("normal", ""), "400").when(v == "bold", "700").otherwise(F.regexp_replace(v, r"\s+", " "))
