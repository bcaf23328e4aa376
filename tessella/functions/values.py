"""Cells of exports as typed values, and numbers as the reports round them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.urls import stripped


def text(cell: Column) -> Column:
    """Trimmed of all white space; blank is null."""
    return F.nullif(stripped(cell.cast("string")), F.lit(""))


def real(cell: Column) -> Column:
    """A decimal comma reads as a point; what isn't a finite number is null."""
    s = text(cell)
    dotted = F.when(s.rlike(r"^-?\d+,\d+$"), F.regexp_replace(s, ",", ".")).otherwise(s)
    x = F.when(dotted.rlike(r"(?i)[df]$"), None).otherwise(dotted).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def integer(cell: Column) -> Column:
    """Truncated towards zero."""
    return real(cell).cast("bigint")


def truth(cell: Column) -> Column:
    s = F.lower(F.coalesce(text(cell), F.lit("")))
    return s.isin("true", "yes", "1", "y") | F.coalesce(real(cell) != 0, F.lit(False))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.bround(part / whole, digits))


def change_percent(now: Column, before: Column) -> Column:
    return F.when(before.isNotNull() & (before != 0), F.bround((now - before) / before * 100, 2))


def collapsed(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def formula_safe(s: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(s.rlike(r"^[\s]*[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def fingerprint(check: Column, url: Column, status: Column) -> Column:
    """Twelve hexadecimal digits that name a finding across runs; null reads as None."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha1(F.concat_ws("|", none(check), none(url), none(status))), 1, 12)


def directives(meta: Column, header: Column) -> Column:
    """Robots directives of a page as a sorted set; 'none' means noindex and nofollow; a header's part for another agent is left out."""
    def tokens(s: Column) -> Column:
        own = F.transform(F.split(F.lower(F.coalesce(s, F.lit(""))), "[,;]"), stripped)
        valued = lambda t: t.rlike(r"^(max-snippet|max-image-preview|max-video-preview|unavailable_after)")
        unscoped = F.transform(own, lambda t: F.when(valued(t), t).otherwise(F.regexp_replace(t, r"^(googlebot|googlebot-news)\s*:\s*", "")))
        return F.filter(unscoped, lambda t: (t != "") & (valued(t) | ~t.contains(":")))
    both = F.concat(tokens(meta), tokens(header))
    expanded = F.flatten(F.transform(both, lambda t: F.when(t == "none", F.array(t, F.lit("noindex"), F.lit("nofollow"))).otherwise(F.array(t))))
    return F.array_sort(F.array_distinct(expanded))


def refresh_target(s: Column) -> Column:
    """Whether a refresh value names a URL."""
    return F.regexp_extract(F.coalesce(s, F.lit("")), r"(?i)url\s*=\s*['\"]?\s*([^'\"\s;]+)", 1) != ""
