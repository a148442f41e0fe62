"""What the name of a CSS custom property says of a colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOT_BRAND = r"(?i)(^|[-_])(text|fg|foreground|font|border|line|stroke|outline|shadow|overlay|scrim|backdrop|hover|hovered|active|pressed|focus|focused|visited|disabled|placeholder|muted|subtle|subdued|soft|tint|weak|faint|alpha|transparent|error|danger|warning|warn|success|info|destructive|critical|positive|negative|caution|attention|gray|grey|neutral|slate|zinc|stone|black|white|inverse|inverted|contrast|shade|ring|selection|scrollbar|code|syntax|chart|shiki|prism|hljs|skeleton|shimmer)(?=[-_A-Z0-9]|$)"
LIBRARIES = r"(?i)^(swiper|plyr|toastify|fa|bs-focus|tw|rdp|sonner|mantine-focus)[-_]"
KINDS = ((r"(?i)brand", 1.0), (r"(?i)(^|[-_])primary(?=[-_A-Z0-9]|$)", 0.8), (r"(?i)accent|(^|[-_])(cta|highlight|theme|key|main|signature)(?=[-_A-Z0-9]|$)", 0.6))
#: Steps of a scale outside of these are tints and shades, which count less.
STEPS, OFF_STEP = (400, 700), 0.3
#: Viewports down the page, and what an area in them weighs.
ZONES = ((0, 1, 1.0), (1, 2, 0.5), (2, 4, 0.25), (4, 8, 0.1))


def name_score(name: Column) -> Column:
    """How likely a property ('--name') is a brand colour, 0 to 1."""
    n = name.substr(F.lit(3), F.length(name))
    kind = F.lit(0.0)
    for pattern, value in reversed(KINDS):
        kind = F.when(n.rlike(pattern), value).otherwise(kind)
    step = F.regexp_extract(n, r"[-_](\d{2,3})[aA]?$", 1).try_cast("int")
    return F.when(n.rlike(NOT_BRAND) | n.rlike(LIBRARIES), 0.0).otherwise(kind * F.when(step.between(*STEPS) | step.isNull(), 1.0).otherwise(OFF_STEP))


def fold_area(top: Column, bottom: Column, width: Column, viewport: float) -> Column:
    """An area weighed by how far down the page it is."""
    part = lambda a, b: F.greatest(F.least(bottom, F.lit(b * viewport)) - F.greatest(top, F.lit(a * viewport)), F.lit(0.0))
    return sum((part(a, b) * w for a, b, w in ZONES[1:]), part(0, 1)) * width
