"""Font rules as Column expressions: families and stacks, the name a family is shown by, where a file comes from, face descriptors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import font_weight

# Fixed values.
GENERIC = "serif sans-serif monospace cursive fantasy system-ui ui-serif ui-sans-serif ui-monospace ui-rounded math emoji fangsong -apple-system blinkmacsystemfont inherit initial".split()
STYLE_WORD = r"(?i)\s+(?:thin|hairline|extra ?light|ultra ?light|light|book|regular|normal|roman|medium|semi ?bold|demi ?bold|bold|extra ?bold|ultra ?bold|black|heavy|italic|oblique|\d{3})$"
BAD_NAME = r"(?i)^(?:false|true|null|undefined|none|untitled|\.+|[-_ .]*)$|copyright|all rights reserved|licen[cs]e|trial|webfont|\(c\)|©|^[A-Z0-9]{16,}$"
MANGLED = r"(?i)^__.+_[0-9a-f]{6}$|(?:^|[_-])[0-9a-f]{10,}|^wf_|^wfont_|placeholder$"
GOOGLE_HOSTS, ADOBE_HOSTS = ["fonts.gstatic.com", "fonts.googleapis.com"], ["use.typekit.net", "p.typekit.net"]
SECOND_LEVEL = "ac co com edu go gov ne net or org".split()
CHECKABLE = r"^[A-Za-z0-9][A-Za-z0-9 .'-]{1,63}$"
FORMATS = {"woff2": 0, "woff": 1, "ttf": 2, "otf": 2, "other": 3, "eot": 4}


def stack_names(stack: Column) -> Column:
    """The names of a font stack, unquoted; a comma in quotes is part of its name."""
    parts = F.regexp_extract_all(F.coalesce(stack, F.lit("")), F.lit(r"""((?:"[^"]*"?|'[^']*'?|[^,"'])+)"""), 1)
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "[\"']", ""))), lambda p: p != "")


def clean_family(family: Column) -> Column:
    """A CSS family without what bundlers add: the frame and hash of next/font, or a long hash at its end."""
    framed, hashed = r"(?i)^__(.+?)_(?:Fallback_)?[0-9a-f]{6}$", r"(?i)^(.+?)[-_][0-9a-f]{10,}$"
    inner = F.regexp_extract(family, hashed, 1)
    return F.when(family.rlike(framed), F.replace(F.regexp_extract(family, framed, 1), F.lit("_"), F.lit(" "))).when(inner.rlike(r"\p{L}{2,}"), inner).otherwise(family)


def _valid(name: Column) -> Column:
    return F.when(F.length(name).between(2, 48) & name.rlike(r"\p{L}{2,}") & ~name.rlike(BAD_NAME), name)


def binary_family(typographic: Column, wws: Column, legacy: Column, postscript: Column) -> Column:
    """The name that a font file gives itself: the first record that is a name, the legacy one without its style words."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f�]", "")), F.lit(""))
    no_style = lambda c: F.regexp_replace(c, STYLE_WORD, "")
    script = F.regexp_replace(F.split_part(_valid(clean(postscript)), F.lit("-"), F.lit(1)), "([a-z])([A-Z])", "$1 $2")
    found = F.coalesce(_valid(clean(typographic)), _valid(clean(wws)), _valid(no_style(no_style(clean(legacy)))), _valid(script))
    return F.when(clean(typographic).isNull(), F.trim(no_style(found))).otherwise(found)


#: Latin letters with marks, and the letters that they have them on.
_MARKED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c) != c}


def _unaccented(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}+", "")


def shown_family(binary: Column, css: Column) -> Column:
    """name, basis and embedded: what a family is called, of its file's own name and the CSS family that declares it.

    The CSS name holds, unless a machine made it or the file's name is plainly what it stands for."""
    bare = F.regexp_replace(clean_family(css), r"(?i)\s+placeholder$", "")
    none = F.lit(None).cast("string")
    b, c = _unaccented(binary), _unaccented(bare)
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    words = lambda x: F.filter(F.split(F.lower(F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    shared = F.exists(words(c), lambda w: F.array_contains(words(b), w) | F.contains(plain(b), w))
    say = lambda name, basis, embedded=none: F.struct(name.alias("name"), F.lit(basis).alias("basis"), embedded.alias("embedded"))
    return (
        F.when(F.coalesce(bare, F.lit("")).isin("", *GENERIC) | F.lower(bare).isin(*GENERIC), say(F.coalesce(binary, F.nullif(bare, F.lit("")), F.lit("(unknown)")), "binary"))
        .when(binary.isNull(), say(bare, "css")).when(css.rlike(MANGLED), say(binary, "binary (css mangled)")).when(plain(b) == plain(c), say(binary, "both"))
        .when(F.startswith(plain(b), plain(c)), say(bare, "css (binary adds style words)")).when(F.contains(plain(c), plain(b)), say(binary, "binary (css is a renamed alias)"))
        .when(shared, say(binary, "binary (shared token)")).otherwise(say(bare, "css (binary name unrelated)", binary))
    )


def site_of(host: Column) -> Column:
    """The last two labels of a host, three below a suffix like co.uk; addresses stay whole."""
    parts = F.split(host, r"\.")
    deep = (F.size(parts) > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, F.size(parts) - 2).isin(*SECOND_LEVEL)
    return F.when(host.contains(":") | host.rlike(r"^\d+(?:\.\d+){3}$"), host).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - F.when(deep, 2).otherwise(1), F.lit(1)), F.lit(3)), "."))


def file_source(host: Column, page_host: Column) -> Column:
    return F.when(host.isin(*GOOGLE_HOSTS), "google-fonts").when(host.isin(*ADOBE_HOSTS), "adobe-fonts").when(site_of(host) == site_of(page_host), "self-hosted").otherwise("third-party")


def spellings(name: Column) -> Column:
    """Ways a catalogue may write a family: as declared, spaced, and with capitals."""
    declared = F.trim(name)
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(declared, "[_+-]+", " "), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.trim(F.regexp_replace(spaced, r"\s+", " "))
    capital = F.array_join(F.transform(F.split(spaced, " "), lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), " ")
    return F.filter(F.array_distinct(F.array(declared, spaced, capital)), lambda x: x.rlike(CHECKABLE))


def face_style(value: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(value)), r"\s+", " "), F.lit("")), F.lit("normal"))


def face_key(family: Column, weight: Column, style: Column, stretch: Column) -> Column:
    """What is one face: its family in lower case and its descriptors in one form."""
    wide = F.lower(F.trim(stretch))
    return F.to_json(F.array(F.lower(family), font_weight(weight), face_style(style), F.when(wide.isin("normal", "100%"), "").otherwise(F.coalesce(wide, F.lit("")))))


def format_rank(fmt: Column) -> Column:
    out = F.lit(3)
    for name, rank in FORMATS.items():
        out = F.when(fmt == name, rank).otherwise(out)
    return out
