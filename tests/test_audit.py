import json

import pytest
from pyspark.sql import functions as F

from tessella.plans import compare, segments
from tessella.plans.audit import run_audit, site_of
from tessella.plans.registry import CHECKS
from tessella.plans.settings import Settings
from tessella.plans.tasks import tasks


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


BASE = {"content_type": "text/html; charset=utf-8", "status_code": 200, "indexability": "Indexable"}


def pages(spark, *rows, columns=None):
    names = columns or sorted({k for r in rows for k in r} | BASE.keys())
    kinds = {"status_code": "bigint", "title_length": "bigint", "inlinks": "bigint", "crawl_depth": "bigint", "word_count": "bigint", "size_bytes": "bigint", "response_time": "double", "ordinal": "bigint", "outlinks": "bigint"}
    data = [tuple({**BASE, "ordinal": k, **r}.get(n) for n in [*names, "ordinal"]) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in [*names, "ordinal"]))


def fired(audit):
    return {(r.check, r.target_url) for r in audit.findings.collect()}


def states(audit):
    return {r.check: r.state for r in audit.statuses.collect()}


def test_planted_problems(spark):
    site = site_of(
        pages(
            spark,
            {"url": "https://x/", "title": "A title that is long enough for everybody", "h1": "Home", "meta_description": "d" * 90, "canonical": "https://x/", "word_count": 300},
            {"url": "https://x/a", "title": "Same title on two pages of the site", "h1": "A", "h1_2": "B", "meta_description": "short", "canonical": "https://x/", "word_count": 50},
            {"url": "https://x/b", "title": "Same title on two pages of the site ", "h1": "Same title on two pages of the site", "meta_description": "d" * 90, "canonical": "/b", "word_count": 900},
            {"url": "http://x/No_Title?utm_source=q", "title": " ", "meta_description": None, "word_count": 10, "canonical": None},
            {"url": "https://x/old", "status_code": 404, "indexability": "Non-Indexable"},
            {"url": "https://x/none", "status_code": 0, "indexability": "Non-Indexable"},
            {"url": "https://x/moved", "status_code": 302, "indexability": "Non-Indexable"},
            {"url": "https://x/unknown", "status_code": None},
            {"url": "https://x/i.jpg", "content_type": "image/jpeg", "title": None},
        )
    )
    a = run_audit(site)
    got = fired(a)
    for one in [
        ("BROKEN_PAGE_4XX", "https://x/old"), ("NO_RESPONSE", "https://x/none"), ("BAD_REDIRECT_TYPE", "https://x/moved"), ("TITLE_DUPLICATE", "https://x/a"), ("TITLE_DUPLICATE", "https://x/b"), ("TITLE_EQUALS_H1", "https://x/b"), ("H1_MULTIPLE", "https://x/a"),
        ("DESC_TOO_SHORT", "https://x/a"), ("TITLE_MISSING", "http://x/No_Title?utm_source=q"), ("DESC_MISSING", "http://x/No_Title?utm_source=q"), ("HTTP_URL", "http://x/No_Title?utm_source=q"), ("URL_UNDERSCORES", "http://x/No_Title?utm_source=q"),
        ("URL_UPPERCASE", "http://x/No_Title?utm_source=q"), ("URL_TRACKING_PARAMS", "http://x/No_Title?utm_source=q"), ("CANONICAL_MISSING", "http://x/No_Title?utm_source=q"), ("CANONICALISED", "https://x/a"), ("CANONICAL_RELATIVE", "https://x/b"), ("THIN_CONTENT", "https://x/a"),
    ]:
        assert one in got, one
    assert not any(u == "https://x/i.jpg" for c, u in got if c.startswith(("TITLE", "DESC", "H1")))
    assert not any(u == "https://x/unknown" for _, u in got)
    s = states(a)
    assert s["SLOW_RESPONSE"] == "skipped" and s["H2_MISSING"] == "skipped" and s["TITLE_MISSING"] == "fired" and s["SERVER_ERROR_5XX"] == "silent" and s["BROKEN_INTERNAL_LINK"] == "skipped"


def test_states_are_a_partition(spark):
    a = run_audit(site_of(pages(spark, {"url": "https://x/", "title": None}, columns=["url", "title", "content_type", "status_code", "indexability"])), Settings({"checks": {"TITLE_MISSING": {"enabled": False}}}))
    s = states(a)
    assert s.keys() == CHECKS.keys() and set(s.values()) <= {"fired", "disabled", "skipped", "silent"}
    assert s["TITLE_MISSING"] == "disabled" and ("TITLE_MISSING", "https://x/") not in fired(a)
    assert a.score().first().health is None and "half" in a.score().first().reason


def test_absent_column_is_not_a_blank_cell(spark):
    with_column = run_audit(site_of(pages(spark, {"url": "https://x/", "title": None}, columns=["url", "title", "content_type", "status_code", "indexability"])))
    without = run_audit(site_of(pages(spark, {"url": "https://x/"}, columns=["url", "content_type", "status_code", "indexability"])))
    assert states(with_column)["TITLE_MISSING"] == "fired" and states(without)["TITLE_MISSING"] == "skipped"


def test_oversized_body_withholds_missing_metadata(spark):
    a = run_audit(site_of(pages(spark, {"url": "https://x/", "title": None, "body_unavailable": "oversized"})))
    s = {r.check: (r.state, r.reason) for r in a.statuses.collect()}
    assert s["TITLE_MISSING"][0] == "skipped" and "too large" in s["TITLE_MISSING"][1]


def test_partial_crawl_withholds_whole_site_negatives(spark):
    rows = ({"url": "https://x/", "inlinks": 5, "crawl_depth": 0}, {"url": "https://x/lost", "inlinks": 0, "crawl_depth": None})
    assert ("ORPHAN_PAGE", "https://x/lost") in fired(run_audit(site_of(pages(spark, *rows))))
    partial = run_audit(site_of(pages(spark, *rows), partial=True))
    assert states(partial)["ORPHAN_PAGE"] == "skipped" and ("ORPHAN_PAGE", "https://x/lost") not in fired(partial)


def test_canonical_redirect_and_pagination_graphs(spark):
    a = run_audit(
        site_of(
            pages(
                spark,
                {"url": "https://x/a", "canonical": "https://x/b"},
                {"url": "https://x/b", "canonical": "https://x/c"},
                {"url": "https://x/c", "canonical": "https://x/gone", "indexability": "Non-Indexable"},
                {"url": "https://x/d", "canonical": "https://x/twin/"},
                {"url": "https://x/twin", "status_code": 301, "redirect_url": "https://x/twin/"},
                {"url": "https://x/e", "canonical": "https://x/r1"},
                {"url": "https://x/r1", "status_code": 301, "redirect_url": "https://x/r2"},
                {"url": "https://x/r2", "status_code": 301, "redirect_url": "https://x/r3"},
                {"url": "https://x/loop", "status_code": 301, "redirect_url": "https://x/loop"},
                {"url": "https://x/?page=1", "rel_next": "https://x/?page=2"},
                {"url": "https://x/?page=2", "rel_next": "https://x/?page=4"},
                {"url": "https://x/?page=4", "rel_next": "https://x/?page=5"},
                {"url": "https://x/?page=5"},
                {"url": "https://x/p", "rel_next": "https://x/q"},
                {"url": "https://x/q", "rel_next": "https://x/p"},
            )
        )
    )
    got = fired(a)
    assert ("CANONICAL_CHAIN", "https://x/a") in got and ("CANONICAL_NON_INDEXABLE", "https://x/b") in got
    assert ("CANONICAL_TO_REDIRECT", "https://x/e") in got and ("CANONICAL_TO_REDIRECT", "https://x/d") in got
    assert ("REDIRECT_CHAIN", "https://x/r1") in got and ("REDIRECT_LOOP", "https://x/loop") in got
    assert ("PAGINATION_LOOP", "https://x/p") in got and ("PAGINATION_SEQUENCE_ERROR", "https://x/?page=1") in got


LINKS = "source string, destination string, anchor string, nofollow boolean, position string, rel array<string>, target string, raw_href string, seq bigint"


def test_link_and_form_checks(spark):
    p = pages(spark, *({"url": f"https://x/{n}", "crawl_depth": k} for k, n in enumerate(["", "a", "b", "c", "d", "e", "f"])))
    rows = [(f"https://x/{a}", f"https://x/{b}", "read more" if b == "b" else b, b == "c", "nav" if b == "d" else "content", [], None, f"/{b}", k) for k, (a, b) in enumerate(["a", "ab", "bc", "cd", "de", "ef"][i] if len(["a", "ab", "bc", "cd", "de", "ef"][i]) == 2 else ("", "a") for i in range(6))]
    rows += [("https://x/a", "https://x/a1", "z", False, "content", [], None, "/a1", 20), ("https://x/a", "https://x/a1", "z", False, "content", [], None, "/a1", 21), ("https://x/a", "https://other/", "o", False, "content", [], "_blank", "//other/", 22), ("https://x/a", "http://localhost:3000/", "l", False, "content", [], None, "http://localhost:3000/", 23)]
    forms = spark.createDataFrame([("http://x/login", "post", "http://x/in", True)], "page string, method string, action string, has_password boolean")
    a = run_audit(site_of(p, {"links": spark.createDataFrame(rows, LINKS), "forms": forms}, host="x", start_url="https://x/"))
    got = fired(a)
    for one in [("GENERIC_ANCHOR_TEXT", "https://x/a"), ("DUPLICATE_INTERNAL_LINK", "https://x/a"), ("UNSAFE_CROSS_ORIGIN_LINK", "https://x/a"), ("PROTOCOL_RELATIVE_LINK", "https://x/a"), ("OUTLINK_TO_LOCALHOST", "https://x/a"), ("ONLY_NOFOLLOW_INLINKS", "https://x/c"), ("INLINK_BOILERPLATE_ONLY", "https://x/d"), ("DEEP_DISCOVERY_PATH", "https://x/e"), ("FORM_URL_INSECURE", "http://x/login"), ("FORM_ON_HTTP_URL", "http://x/login")]:
        assert one in got, one
    path = json.loads(a.findings.where("check = 'DEEP_DISCOVERY_PATH' and target_url = 'https://x/e'").first().details)
    assert path["hops"] == 5 and path["path"][0] == "https://x" and path["path"][-1] == "https://x/e"


def test_hreflang_sitemap_and_robots(spark):
    p = pages(spark, {"url": "https://x/en"}, {"url": "https://x/de"}, {"url": "https://x/old", "status_code": 404}, {"url": "https://x/plain"})
    tags = spark.createDataFrame([("https://x/en", "https://x/en", "en"), ("https://x/en", "https://x/de", "de"), ("https://x/en", "https://x/old", "en-UK"), ("https://x/en", "https://x/de", "de"), ("https://x/plain", "https://x/en", "xx")], "source_url string, destination_url string, hreflang string")
    sitemap = spark.createDataFrame([("s1", "https://x/en", "2001-01-01"), ("s2", "https://x/en/", None), ("s1", "https://x/lost", "tomorrow")], "sitemap string, loc string, lastmod string")
    documents = spark.createDataFrame([("s1", 60_000_000, None, False), ("s2", 10, "timeout", False)], "sitemap string, bytes bigint, error string, truncated boolean")
    links = spark.createDataFrame([("https://x/en", "https://x/de", "de", False, "content", [], None, "/de", 1), ("https://x/de", "https://x/en", "en", False, "content", [], None, "/en", 2)], LINKS)
    robots = spark.createDataFrame([("User-agent: *\nDisallow: /assets/\n",)], "body string")
    a = run_audit(site_of(p, {"hreflang": tags, "sitemap": sitemap, "sitemap_documents": documents, "links": links, "robots": robots}, host="x"))
    got = fired(a)
    for one in [
        ("HREFLANG_BROKEN_TARGET", "https://x/en"), ("HREFLANG_INVALID_CODE", "https://x/en"), ("HREFLANG_INVALID_CODE", "https://x/plain"), ("HREFLANG_MULTIPLE_ENTRIES", "https://x/en"), ("HREFLANG_MISSING_SELF_REFERENCE", "https://x/plain"), ("HREFLANG_MISSING_XDEFAULT", "https://x/en"), ("HREFLANG_MISSING_RETURN_LINK", "https://x/de"),
        ("SITEMAP_ORPHAN", "https://x/lost"), ("URL_NOT_IN_SITEMAP", "https://x/de"), ("SITEMAP_URL_DUPLICATED", "https://x/en"), ("SITEMAP_TOO_LARGE", "s1"), ("SITEMAP_FETCH_INCOMPLETE", None), ("SITEMAP_STALE_LASTMOD", None), ("SITEMAP_DESYNC", None), ("ROBOTS_BLOCKS_RESOURCES", None), ("SITEMAP_NOT_IN_ROBOTS", None),
    ]:
        assert one in got, one


def test_export_inlinks(spark):
    rows = [("https://x/a", "https://x/gone", 404, "Content"), ("https://x/b", "https://x/gone/", 404, "Footer"), ("https://x/b", "https://other/gone", 404, "Content")]
    frame = spark.createDataFrame(rows, "source_url string, destination_url string, status_code bigint, link_position string")
    a = run_audit(site_of(pages(spark, {"url": "https://x/"}), {"inlinks_4xx": frame}, host="x"))
    one = {r.check: r for r in a.findings.collect() if r.check.startswith("BROKEN_")}
    assert one["BROKEN_INTERNAL_LINK"].occurrences == 2 and json.loads(one["BROKEN_INTERNAL_LINK"].details)["positions"] == {"Content": 1, "Footer": 1}
    assert one["BROKEN_EXTERNAL_LINK"].target_url == "https://other/gone"


def test_settings_and_tasks(spark):
    with pytest.raises(ValueError):
        Settings({"checks": {"NO_SUCH_CHECK": {}}})
    with pytest.raises(ValueError):
        Settings({"severity_overrides": {"HTTP_URL": "fatal"}})
    s = Settings({"severity_overrides": {"HTTP_URL": "critical"}, "tasks": {"max_urls_per_task": 1, "min_occurrences": 2}})
    a = run_audit(site_of(pages(spark, *({"url": f"http://x/{k}"} for k in range(3)))), s)
    t = {r.key: r for r in tasks(a.findings.where("check in ('HTTP_URL', 'URL_HAS_PARAMS')"), s).collect()}
    assert t["HTTP_URL"].priority == "P1" and t["HTTP_URL"].affected == 3 and len(t["HTTP_URL"].urls) == 1 and t["HTTP_URL"].more == 2
    issues = a.issues().collect()
    assert len({r.fingerprint for r in issues}) == len(issues) and [r.severity for r in sorted(issues, key=lambda r: r.issue)] == sorted((r.severity for r in issues), key=["critical", "warning", "notice"].index)


def test_compare(spark):
    f = lambda *rows: spark.createDataFrame(rows, "check string, target_url string")
    u = lambda *rows: spark.createDataFrame([(r,) for r in rows], "url string")
    got = {(r.check, r.target_url): r.change for r in compare.compared(f(("A", "p"), ("B", "p"), ("C", "old"), ("S", None)), f(("A", "p"), ("D", "p"), ("E", "new"), ("T", None)), u("p", "old"), u("p", "new")).collect()}
    assert got == {("A", "p"): "persisted", ("B", "p"): "disappeared", ("C", "old"): "left", ("D", "p"): "appeared", ("E", "new"): "entered", ("S", None): "left", ("T", None): "entered"}
    partial = {(r.check): r.change for r in compare.compared(f(("B", "p")), f(("D", "p")), u("p"), u("p"), True, True).collect()}
    assert partial == {"B": "left", "D": "entered"}
    assert compare.comparability({"scope": "x", "config": None}, {"scope": "y", "config": "1"})["scope"] == "incompatible"


def test_segments(spark):
    one = segments.Segment("docs", (segments.Rule("path", "prefix", "/docs/"),))
    two = segments.Segment("api", (segments.Rule("", "segment", "docs"), segments.Rule("url", "contains", "api")))
    p = segments.segmented(spark.createDataFrame([("https://x/docs/api",), ("https://x/docs/a",), ("https://x/",)], "url string"), [two, one])
    assert {r.url: r.primary_segment for r in p.collect()} == {"https://x/docs/api": "api", "https://x/docs/a": "docs", "https://x/": "unsegmented"}
    rep = {r.segment: (r.pages, r.issues) for r in segments.report(p, spark.createDataFrame([("C", "https://x/docs/a"), ("C", "https://gone/")], "check string, target_url string")).collect()}
    assert rep == {"api": (1, 0), "docs": (1, 1), "unsegmented": (1, 1)}
    with pytest.raises(ValueError, match="circle: a -> b -> a"):
        segments.ordered([segments.Segment("a", (segments.Rule("", "segment", "b"),)), segments.Segment("b", (segments.Rule("", "segment", "a"),))])


def test_counterparts(spark):
    p = spark.createDataFrame([("https://x/en/a",), ("https://x/en/b",), ("https://x/en/c",), ("https://x/pl/a",), ("https://x/pl/b",)], "url string")
    alternates = spark.createDataFrame([("https://x/en/a", "https://x/pl/a")], "source_url string, destination_url string")
    got = {r.url: (r.counterpart, r.basis) for r in segments.counterparts(p, alternates, "/en/", "/pl/").collect()}
    assert got == {"https://x/en/a": ("https://x/pl/a", "declared"), "https://x/en/b": ("https://x/pl/b", "mirrored"), "https://x/en/c": (None, "missing")}
    assert segments.counterparts(p, alternates.limit(0), "/en/", "/pl/").where(F.col("basis") == "unmeasured").count() == 3


def test_documents(spark, tmp_path):
    from tessella.plans import documents

    a = run_audit(site_of(pages(spark, *({"url": f"http://x/{k}", "title": None, "word_count": 10} for k in range(4)))), Settings({"checks": {"URL_UPPERCASE": {"enabled": False}}}))
    documents.write_audit(a, str(tmp_path / "audit"))
    back = documents.read_audit(spark, str(tmp_path / "audit"))
    one = back["audit"].first()
    assert one.schema_version == "2.0" and one.summary.pages == 4 and one.summary.issues == a.findings.count() == back["issues"].count()
    assert [r.check for r in one.run.checks_disabled] == ["URL_UPPERCASE"] and len(one.run.checks_skipped) > 50
    assert {(r.check, r.target_url) for r in back["issues"].collect()} == fired(a) and {r.url for r in back["pages"].collect()} == {f"http://x/{k}" for k in range(4)}
    text = documents.audit_markdown(a)
    assert "| HTTP_URL | warning | 4 | 4 |" in text and "- URL_UPPERCASE: switched off in the settings" in text
    t = tasks(a.findings, Settings({"tasks": {"max_urls_per_task": 2}}))
    documents.write_tasks(t, str(tmp_path / "tasks"))
    assert spark.read.json(str(tmp_path / "tasks")).count() == t.count()
    md = {r.key: r.markdown for r in documents.tasks_markdown(t).collect()}
    assert "- http://x/0\n- http://x/1\n- and 2 more" in md["HTTP_URL"]
    spark.createDataFrame([("1.0",)], "schema_version string").write.json(str(tmp_path / "old" / "audit"))
    with pytest.raises(ValueError, match="version"):
        documents.read_audit(spark, str(tmp_path / "old"))
