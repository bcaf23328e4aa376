"""URL identities as Column expressions.

Several identities exist side by side on purpose: what counts as one page for a canonical link is not what
counts as one page for a sitemap.  All of them start from one split by the generic URL grammar, which never
fails, keeps case, and tells an absent part from an empty one only where that matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAMMAR = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Suffixes under which anybody may register or host a name.
MULTI_TENANT = ("github.io", "githubusercontent.com", "gitlab.io", "pages.dev", "vercel.app", "netlify.app", "herokuapp.com", "myshopify.com", "wordpress.com", "blogspot.com", "s3.amazonaws.com", "web.app", "firebaseapp.com")
#: Second-level names under which countries register.
COMPOUND = ("com", "net", "org", "co", "gov", "edu", "ac", "spb", "msk")
#: Fixed value: names of tracking parameters.
TRACKING = r"(?i)^(?:utm_[a-z_]+|gcl(?:id|src)|fbclid|msclkid|yclid|dclid|w?braid|_hs(?:enc|mi)|mc_[ce]id|pk_(?:campaign|kwd|source|medium|content)|vero_(?:id|conv)|trksid?|cmpid|mbid)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it; keeps nested expressions small."""
    return F.get(F.transform(F.array(value), body), 0)


def stripped(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, GRAMMAR, k)


def split(url: Column) -> Column:
    """scheme (folded), netloc, path, query, fragment; '' for what is absent."""
    return F.struct(F.lower(part(url, 1)).alias("scheme"), part(url, 2).alias("netloc"), part(url, 3).alias("path"), part(url, 4).alias("query"), part(url, 5).alias("fragment"))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def host_of(where: Column) -> Column:
    bare = F.regexp_replace(where, r"^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":.*$", "")))


def port_of(where: Column) -> Column:
    return F.nullif(F.regexp_extract(where, r":(\d{1,5})$", 1), F.lit("")).try_cast("int")


def host(url: Column) -> Column:
    """Lower-case, without user and port; brackets of an IPv6 address dropped."""
    return let(netloc(url), host_of)


def port(url: Column) -> Column:
    return port_of(netloc(url))


def default_port(scheme_: Column) -> Column:
    return F.when(scheme_ == "https", 443).when(scheme_ == "http", 80)


def effective_port(url: Column) -> Column:
    return F.coalesce(port(url), default_port(scheme(url)))


def joined(scheme_: Column, netloc_: Column, path_: Column, query_: Column, fragment_: Column | None = None) -> Column:
    """The parts as a URL; empty ones leave no mark, and a path after a host begins with a slash."""
    rooted = F.when((netloc_ != "") & (path_ != "") & ~path_.startswith("/"), F.concat(F.lit("/"), path_)).otherwise(path_)
    pieces = [
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""),
        F.when(netloc_ != "", F.concat(F.lit("//"), netloc_)).otherwise(""),
        rooted,
        F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""),
    ]
    if fragment_ is not None:
        pieces.append(F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(""))
    return F.concat(*pieces)


def norm_url(url: Column) -> Column:
    """Key of checks and link graphs: scheme and host folded, all slashes at the path's end dropped; '' for null."""
    return let(split(stripped(F.coalesce(url, F.lit("")))), lambda p: joined(p["scheme"], F.lower(p["netloc"]), F.regexp_replace(p["path"], r"/+$", ""), p["query"], p["fragment"]))


def sitemap_key(url: Column) -> Column:
    """Key of sitemaps: host folded, default port and fragment dropped, slash at the end of a longer path too; null if not absolute."""

    def key(p: Column) -> Column:
        number = port_of(p["netloc"])
        shown = F.when(number.isNotNull() & ~F.coalesce(number == default_port(p["scheme"]), F.lit(False)), F.concat(F.lit(":"), number.cast("string"))).otherwise("")
        user = F.regexp_extract(p["netloc"], r"^(.*@)", 1)
        trimmed = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], r"/+$", "")).otherwise(p["path"])
        return F.when((p["scheme"] != "") & (p["netloc"] != ""), joined(p["scheme"], F.concat(user, host_of(p["netloc"]), shown), trimmed, p["query"]))

    return let(split(stripped(url)), key)


def join_key(url: Column, ignore_query: bool = False, ignore_scheme: bool = False, casefold_path: bool = False) -> Column:
    """Key of joins with external rows; null for what can't be keyed."""
    key = sitemap_key(url)
    if not (ignore_query or ignore_scheme or casefold_path):
        return key
    loose = lambda p: joined(F.lit("https") if ignore_scheme else p["scheme"], p["netloc"], F.lower(p["path"]) if casefold_path else p["path"], F.lit("") if ignore_query else p["query"])
    return let(key, lambda k: F.when(k.isNotNull(), let(split(k), loose)))


def origin_of_key(key: Column) -> Column:
    return F.when(key.isNotNull(), F.concat(scheme(key), F.lit("://"), netloc(key)))


def crawl_key(url: Column) -> Column:
    """Identity of the crawler: fragment dropped, empty path '/', else as written."""
    return let(url, lambda u: joined(part(u, 1), part(u, 2), F.when(part(u, 3) == "", "/").otherwise(part(u, 3)), part(u, 4)))


def same_page(a: Column, b: Column) -> Column:
    return norm_url(a) == norm_url(b)


def origin(url: Column) -> Column:
    """(scheme, host, effective port) as one value, for comparing origins."""
    return let(split(url), lambda p: F.struct(p["scheme"].alias("scheme"), host_of(p["netloc"]).alias("host"), F.coalesce(port_of(p["netloc"]), default_port(p["scheme"])).alias("port")))


def redirect_path(url: Column) -> Column:
    """A redirect rule's source or target without scheme and host."""
    return F.regexp_replace(stripped(F.coalesce(url, F.lit(""))), r"^https?://[^/]+", "")


#: Numbers, UUIDs and dates identify; so does a long slug under a named parent.
ID_SEGMENT = r"^(?:\d+|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|\d{4}-\d{2}-\d{2})$"
SLUG_SEGMENT = r"(?U)^[\w-]{9,}$"


def url_pattern(url: Column) -> Column:
    """The template a URL belongs to: segments that look like identifiers, or like slugs under a named parent, become '*'."""

    def starred(segments: Column) -> Column:
        first_named = F.coalesce(F.array_min(F.filter(F.transform(segments, lambda s, i: F.when(s != "", i)), lambda i: i.isNotNull())), F.lit(0))
        return let(first_named, lambda first: F.array_join(F.transform(segments, lambda s, i: F.when((s != "") & (s.rlike(ID_SEGMENT) | ((i > first) & s.rlike(SLUG_SEGMENT))), F.lit("*")).otherwise(s)), "/"))

    return let(split(url), lambda p: joined(p["scheme"], p["netloc"], let(F.split(p["path"], "/"), starred), F.lit("")))


def registrable_domain(name: Column) -> Column:
    """An approximation of the name that can be registered, with well-known shared suffixes."""
    labels = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^\.+|\.+$", ""), r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    shared3 = (n > 3) & last(3).isin(*[s for s in MULTI_TENANT if s.count(".") == 2])
    shared2 = (n > 2) & last(2).isin(*[s for s in MULTI_TENANT if s.count(".") == 1])
    compound = F.element_at(labels, -2).isin(*COMPOUND) & (F.length(F.element_at(labels, -1)) <= 3)
    return F.when(n <= 2, F.array_join(labels, ".")).when(shared3, last(4)).when(shared2 | compound, last(3)).otherwise(last(2))


def strip_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def decoded(text: Column) -> Column:
    """Percent escapes resolved; '+' stays, and what isn't an escape stays as it is."""
    return let(text, lambda t: F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(t, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")), t))


def decoded_path(url: Column) -> Column:
    return decoded(path(url))


def parameters(url: Column) -> Column:
    """Names of the query's parameters that have a value, in order."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike(r"^[^=]+=.+"))
    return F.transform(pairs, lambda p: F.regexp_extract(p, r"^([^=]*)", 1))


def tracking_parameters(url: Column) -> Column:
    return F.array_distinct(F.filter(parameters(url), lambda p: p.rlike(TRACKING)))


def url_kind(url: Column) -> Column:
    """'folder' or 'finalUrl', by a dot in the last segment."""
    leaf = F.try_element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(-1))
    absolute = (part(url, 1) != "") & (netloc(url) != "")
    return F.when(~absolute, "finalUrl").when(F.coalesce(leaf, F.lit("")).contains("."), "finalUrl").otherwise("folder")


def page_number(url: Column) -> Column:
    """The number of a paginated page by its parameters or path; null where they contradict each other or say none."""
    q = F.filter(F.split(query(url), "&"), lambda p: p.rlike(r"(?i)^(page|paged|pg)=\d+$"))
    by_query = F.transform(q, lambda p: F.regexp_extract(p, r"=(\d+)$", 1).cast("int"))
    by_path = F.transform(F.regexp_extract_all(path(url), F.lit(r"(?i)/(?:page|paged|pg)/(\d{1,6})(?=/|$)"), F.lit(1)), lambda p: p.cast("int"))
    found = F.array_distinct(F.concat(by_query, by_path))
    return F.when(F.size(found) == 1, found[0])


def section(path_: Column) -> Column:
    """The first segment of a path, as '/name'; '/' for the root."""
    first = F.regexp_extract(path_, r"^/?([^/?#]+)", 1)
    return F.when(first == "", "/").otherwise(F.concat(F.lit("/"), first))


def ajax_scheme(url: Column) -> Column:
    """Whether a URL is written in the abandoned scheme for crawling scripts."""
    return url.rlike(r"#!|[?&]_escaped_fragment_(=|&|$)")


def is_loopback(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), r"\.+$", "")
    return (bare == "localhost") | bare.endswith(".localhost") | bare.rlike(r"^127(\.\d{1,3}){3}$") | bare.isin("::1", "0:0:0:0:0:0:0:1")
