"""Which addresses a crawl may fetch, and by which rule one is turned away."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import urls


@dataclass(frozen=True)
class Scope:
    """internal: `host` (the start's own) or `registrable_domain`; segment_hosts are internal in any case.

    Patterns are searched for anywhere in the address; an excluded host excludes the hosts below it, too."""

    start_host: str
    internal: str = "host"
    segment_hosts: tuple[str, ...] = ()
    exclude_hosts: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    segments_only: tuple[str, ...] = ()


def internal(url: Column, scope: Scope) -> Column:
    host = F.lower(F.coalesce(urls.host(url), F.lit("")))
    start = scope.start_host.lower()
    own = host == start
    if scope.internal == "registrable_domain":
        own = urls.registrable_domain(host) == urls.registrable_domain(F.lit(start))
    if scope.segment_hosts:
        own = own | host.isin(*(h.lower() for h in scope.segment_hosts))
    return (host != "") & own


def rejection(url: Column, scope: Scope, segment: Column | None = None) -> Column:
    """The first rule that turns the address away; the empty string if it may be fetched."""
    host = F.lower(F.coalesce(urls.host(url), F.lit("")))
    out = F.when(~internal(url, scope), "outside_host")
    if scope.exclude_hosts:
        bad = [(host == h.lower()) | host.endswith("." + h.lower()) for h in scope.exclude_hosts]
        out = out.when(F.greatest(*bad) if len(bad) > 1 else bad[0], "excluded_host")
    for pattern in scope.exclude_patterns:
        out = out.when(url.rlike(pattern), "excluded_by_pattern")
    if scope.include_patterns:
        met = [url.rlike(p) for p in scope.include_patterns]
        out = out.when(~(F.greatest(*met) if len(met) > 1 else met[0]), "not_included_by_pattern")
    if scope.segments_only and segment is not None:
        out = out.when(~F.coalesce(segment.isin(*scope.segments_only), F.lit(False)), "outside_segment")
    return out.otherwise("")
