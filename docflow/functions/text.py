"""String functions and line predicates as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"(https?://[^\s<>()]+|www\.[^\s<>()]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_BLANK = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: white space other than a single space between words, so that usual text has no match
BLANKS = rf"(?:[{_BLANK}&&[^ ]]| (?=[{_BLANK}]))[{_BLANK}]*"
CJK = r"[\x{2E80}-\x{303F}\x{3040}-\x{30FF}\x{3100}-\x{312F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF01}-\x{FF60}]"
RTL = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
LATIN = r"[A-Za-z\x{00C0}-\x{024F}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x) -> Column:
    """Neither null nor NaN nor infinite."""
    x = _c(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def round_half_up(x, digits: int = 0) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits: halves go up, negative ones too."""
    k = 10.0**digits
    return F.floor(_c(x) * k + 0.5) / k


def collapse(x) -> Column:
    """White space collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), BLANKS, " "))


def normalize_text(x) -> Column:
    """Ligatures spelled out and white space collapsed. Full-width and presentation forms: normalize_forms."""
    x = spelled = _c(x)
    for a, b in LIGATURES.items():
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    return collapse(F.when(x.rlike("[\\x{FB00}-\\x{FB06}]"), spelled).otherwise(x))


def escape_markdown(x) -> Column:
    """& < > as entities; a backslash before itself and before ` * _ [ ]."""
    x = F.replace(F.replace(F.replace(_c(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(x, r"([\\`*_\[\]])", r"\\$1")


def escape_html(x) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(_c(x), F.lit(a), F.lit(b))
    return x


def links(x) -> Column:
    """Web and mail addresses of a text, without the punctuation at their ends."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(LINK), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def link_target(u: Column) -> Column:
    return F.when(u.rlike("^www[.]"), F.concat(F.lit("https://"), u)).when(u.rlike("^[^/]*@"), F.concat(F.lit("mailto:"), u)).otherwise(u)


def escape_inline(x) -> Column:
    """Text between links escaped, links as autolinks with what was stripped behind them."""
    x = _c(x)
    return F.when(x.contains("@") | x.contains("://") | x.contains("www."), _escape_linked(x)).otherwise(escape_markdown(x))


def _escape_linked(x: Column) -> Column:
    marked = F.regexp_replace(x, LINK, "\x01$1\x02")
    parts = F.split(marked, "[\x01]")
    head = escape_markdown(F.element_at(parts, 1))

    def piece(p: Column) -> Column:
        url, rest = F.substring_index(p, "\x02", 1), F.substring_index(p, "\x02", -1)
        bare = F.regexp_replace(url, r"[.,;:!?]+$", "")
        tail = F.substring(url, F.length(bare) + 1, F.length(url))
        web = F.when(bare.rlike("^www[.]"), F.concat(F.lit("["), escape_markdown(bare), F.lit("](https://"), bare, F.lit(")"))).otherwise(F.concat(F.lit("<"), bare, F.lit(">")))
        return F.concat(web, tail, escape_markdown(rest))

    return F.concat(head, F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))


def escape_paragraph(x) -> Column:
    """escape_inline, and what would begin a block at the start escaped: # - + and N."""
    x = escape_inline(x)
    return F.regexp_replace(F.regexp_replace(x, r"^([#+-])", r"\\$1"), r"^(\d+)([.)]\s)", r"$1\\$2")


def escape_cell(x) -> Column:
    return F.replace(escape_inline(x), F.lit("|"), F.lit("\\|"))


def csv_cell(x) -> Column:
    """Guarded against formulas, quoted where it must be."""
    x = F.coalesce(collapse(x), F.lit(""))
    x = F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_unguard(x) -> Column:
    """The text of a cell whose formula guard is taken off."""
    return F.regexp_replace(_c(x), r"^'([=+\-@])", "$1")


def truncate(x, limit: int = 80) -> Column:
    x = _c(x)
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 3), F.lit("..."))).otherwise(x)


def list_depth_text(level: Column, number: Column, text: Column) -> Column:
    """Two spaces a level; an ordered item keeps its number."""
    mark = F.when(number.isNull(), F.lit("- ")).otherwise(F.concat(number.cast("string"), F.lit(". ")))
    return F.concat(F.repeat(F.lit("  "), level), mark, text)


def code_fence(x) -> Column:
    """Back-ticks, or tildes if their longest run is the shorter one; one longer than it, three at least."""
    x = _c(x)
    run = lambda pattern: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.length)), F.lit(0))
    ticks, tildes = F.greatest(F.lit(3), run("`+") + 1), F.greatest(F.lit(3), run("~+") + 1)
    return F.when(ticks <= tildes, F.repeat(F.lit("`"), ticks)).otherwise(F.repeat(F.lit("~"), tildes))


def direction(x) -> Column:
    """rtl if it has more right-to-left than Latin letters, else ltr if it has any, else unknown."""
    x = _c(x)
    r, n = F.regexp_count(x, F.lit(RTL)), F.regexp_count(x, F.lit(LATIN))
    return F.when(r > n, "rtl").when(n > 0, "ltr").otherwise("unknown")


def part_separator(left: Column, right: Column) -> Column:
    """Nothing between two CJK characters, else a space."""
    return F.when(left.rlike(CJK + r"\s*$") & right.rlike(r"^\s*" + CJK), F.lit("")).otherwise(F.lit(" "))


def repairs_hyphen(left: Column, right: Column) -> Column:
    return left.rlike("[A-Za-z]-$") & right.rlike("^[a-z]")


def comparable_text(x) -> Column:
    """Markdown without anchors, heading and list marks, escapes, links and emphasis, in single spaces."""
    x = F.regexp_replace(_c(x), r'<a id="[^"]*"></a>', " ")
    x = F.regexp_replace(x, r"(?m)^#{1,6}\s+", "")
    x = F.regexp_replace(x, r"(?m)^\s*(?:[-*+]|\d+[.)])\s+", "")
    x = F.regexp_replace(x, r"\\([\\`*_\[\]#+.()|-])", "$1")
    x = F.regexp_replace(x, r"[|`*_<>]+", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def tokens(x) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a phrase that isn't empty."""
    return F.when(F.length(phrase) > 0, (F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).otherwise(0).cast("long")


def is_running_candidate(size, y) -> Column:
    return F.coalesce((_c(size) <= 10) & is_finite(y) & ((_c(y) >= 740) | (_c(y) <= 60)), F.lit(False))


def is_page_number(text, size, y) -> Column:
    return is_running_candidate(size, y) & F.trim(_c(text)).rlike(r"(?i)^(?:page\s*)?\d+(?:\s*/\s*\d+)?$")


def is_running_title(text, size, y) -> Column:
    return F.coalesce((_c(size) <= 10) & (_c(y) >= 740) & _c(text).rlike("[A-Za-z]"), F.lit(False))


LIST_ITEM = r"^(?:[-*]|(\d+)[.)])\s+(.+)$"


def is_list_item(x) -> Column:
    return F.trim(_c(x)).rlike(LIST_ITEM)


def list_number(x) -> Column:
    n = F.regexp_extract(F.trim(_c(x)), LIST_ITEM, 1)
    return F.when(n != "", n.cast("long"))


def list_text(x) -> Column:
    return F.regexp_extract(F.trim(_c(x)), LIST_ITEM, 2)


def starts_block(x) -> Column:
    return F.ltrim(_c(x)).rlike(r"^([#>]|\d+[.)]\s|[-+]\s)")


def is_numeric_cell(x) -> Column:
    return F.coalesce(F.trim(_c(x)).rlike(r"^[-+]?\d+(?:\.\d+)?%?$"), F.lit(False))


def ends_paragraph(x) -> Column:
    return F.rtrim(_c(x)).rlike(r"[.!?:;)\x{3002}\x{FF01}\x{FF1F}\x{FF0E}\x{FF61}]$")


def is_callout(x) -> Column:
    return _c(x).rlike(r"(?i)^(note|tip|warning|important|caution):\s+")


def is_footnote(x, size, y) -> Column:
    return F.coalesce((_c(y) <= 160) & (_c(size) <= 10) & _c(x).rlike(r"^(?:\d+|[a-z])[.)]\s+"), F.lit(False))


def caption_target(x) -> Column:
    """figure, table or null."""
    return F.when(_c(x).rlike(r"(?i)^fig(?:ure|\.)?\s+\d+\b"), "figure").when(_c(x).rlike(r"(?i)^table\s+\d+\b"), "table")


def is_monospace(font) -> Column:
    return F.coalesce(_c(font).rlike(r"(?i)(courier|mono|consolas|menlo|typewriter)"), F.lit(False))


def is_code_like(x) -> Column:
    return _c(x).rlike(r"(?:[{};]\s*$|^\s*(?:def|class|return|import|from|const|let|var|function|if|for|while|public|private|#include)\b|=>|\w+\([^)]*\)\s*[;{:]?$|^\s*[$>]\s+\w)")


def has_math(x) -> Column:
    """Has the structure of an equation: a relation between two operands, or an operator or script."""
    return _c(x).rlike(r"\S\s*[=<>\x{2248}\x{2260}\x{2264}\x{2265}]\s*\S") & _c(x).rlike(r"[A-Za-z0-9\x{0370}-\x{03FF}]")


def is_prose(x) -> Column:
    return F.size(F.filter(F.split(F.trim(_c(x)), r"\s+"), lambda w: w.rlike("^[A-Za-z]{3,}[,.;:]?$"))) >= 6


def is_equation(text, x, width, left, body_width) -> Column:
    """3 to 180 characters with the structure of an equation, neither code, link, HTML nor prose, and a strong symbol or set
    as display: 24 points indented, or at most 72 % of the body's width."""
    t = F.trim(_c(text))
    shape = (F.length(t).between(3, 180)) & has_math(t) & ~t.rlike(r"[{};]\s*$|=>") & ~t.rlike(LINK) & ~t.rlike(r"^</?[A-Za-z][^>]*>") & ~is_prose(t)
    display = (_c(x) - _c(left) >= 24) | (_c(width) <= 0.72 * _c(body_width))
    return shape & (t.rlike(r"[\x{0370}-\x{03FF}\x{2200}-\x{22CF}]") | F.coalesce(display, F.lit(False)))


def confidence_unit(x) -> Column:
    """NaN and null to 0, percents to units, clamped to 0..1, 6 decimals."""
    x = F.coalesce(F.nanvl(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0))
    return round_half_up(F.least(F.greatest(F.when(x > 1, x / 100).otherwise(x), F.lit(0.0)), F.lit(1.0)), 6)


def overlap_area(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Common area of two boxes given by corner and size."""
    ax, ay, aw, ah, bx, by, bw, bh = map(_c, (ax, ay, aw, ah, bx, by, bw, bh))
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
