import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import html
from tessella.sources import bundles, exports, logs, robots, sitemaps
from tessella.streaming import streams


def test_export_projection_remembers_absence(spark, tmp_path):
    (tmp_path / "internal_all.csv").write_bytes("﻿Address,status code,Title 1,Word Count,Text Ratio\nhttps://x/, 200 ,  ,\"1,5\",\"2,5\"\nhttps://x/b,inf,Title,7,nan\n".encode())
    (tmp_path / "client_error_(4xx)_inlinks.csv").write_text("Type,Source,Destination,Anchor,Follow,Link Position,Status Code,Rel\nHyperlink,https://x/,https://x/gone,go,false,Footer,404,nofollow ugc\n")
    out, absent = exports.load_exports(spark, str(tmp_path))
    pages = out["internal_all"]
    assert {"url", "status_code", "title", "word_count", "text_ratio"} == pages.present and "h1" not in pages.present
    rows = pages.rows.orderBy("ordinal").collect()
    assert (rows[0].status_code, rows[0].title, rows[0].word_count, rows[0].text_ratio, rows[0].h1) == (200, None, 1, 2.5, None)
    assert (rows[1].status_code, rows[1].text_ratio) == (None, None)
    assert "hreflang" in absent
    link = exports.links_of(out["inlinks_4xx"].rows).first()
    assert link.nofollow and link.position == "footer" and link.rel == ["nofollow", "ugc"]


def test_utf16_export_and_ambiguity(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("Address,Title 1\nhttps://x/,Größe\n".encode("utf-16"))
    out = exports.read_pages(spark, str(p))
    assert out.encoding == "UTF-16LE" and out.rows.first().title == "Größe"
    with pytest.raises(ValueError, match="may be any of"):
        exports.matching(["internal_all.csv", "internal_all_2.csv"], "internal_all")
    with pytest.raises(FileNotFoundError):
        exports.load_exports(spark, str(tmp_path))


def test_url_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("https://x/a, https://x/a\nnone\n<loc>http://y/b</loc>\n")
    assert sorted(r.url for r in exports.url_list(spark, str(tmp_path / "l.txt")).collect()) == ["http://y/b", "https://x/a", "https://x/a"]


def test_bundle(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Page,Code,Canon\nhttps://X:443/a/,200,nope\nhttps://x/a,abc,\n,404,\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"datasets": {"pages": {"file": "p.csv", "columns": {"url": "Page", "status_code": "Code", "canonical_url": "Canon"}}, "links": {"file": None, "reason": "not bought"}}}))
    b = bundles.read_bundle(spark, str(tmp_path / "manifest.json"))
    rows = b.tables["pages"].collect()
    assert len(rows) == 3 and [r.url for r in rows] == ["https://x/a", "https://x/a", None] and rows[0].errors == ["canonical_url"] and rows[1].errors == ["status_code"]
    cov = {r.field: (r.present, r.missing, r.invalid, r.state) for r in b.coverage["pages"].collect()}
    assert cov["status_code"] == (2, 0, 1, "partial") and cov["title"][3] == "not_exported"
    assert tuple(b.duplicates["pages"].first()) == (1, 2) and b.absent == {"links": "not bought"}


LINES = [
    '1.2.3.4 - - [10/Oct/2000:13:55:36 -0700] "GET /a/b?x=1 HTTP/1.1" 200 123 "-" "Mozilla/5.0 (compatible; Googlebot/2.1)"',
    '1.2.3.5 - - [10/Oct/2000:13:55:36] "GET /c HTTP/1.1" 404 - "https://r/" "Mozilla Chrome"',
    '1.2.3.6 - - [11/Oct/2000:13:55:36 +0000] "POST /a HTTP/1.0" 503 9',
    "garbage",
    '1.2.3.4 - - [10/Oct/2000:13:55:36 +0000] "GET /a HTTP/1.1" 200 7 "-" "GPTBot/1.0"',
]


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES))
    lines = spark.read.text(str(tmp_path / "a.log"))
    rows = logs.parsed(lines).collect()
    assert len(rows) == 4 and logs.malformed(lines).first()[0] == 1
    assert str(rows[0].time) == "2000-10-10 20:55:36" and rows[1].bytes is None and rows[2].user_agent is None
    r = logs.rollup(logs.parsed(lines))
    assert {(x.family, x.bot, x.hits) for x in r["by_bot"].collect()} == {("googlebot", "Googlebot", 1), ("ai", "GPTBot (OpenAI)", 1)}
    assert {(x.family, x.section, x.hits) for x in r["by_section"].collect()} == {("googlebot", "/a", 1), ("other", "/c", 1), ("other", "/a", 1), ("ai", "/a", 1)}
    assert r["span"].first().truncated is False
    (tmp_path / "iis.log").write_text("#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status cs(User-Agent)\n2024-01-02 03:04:05 9.9.9.9 GET /x q=1 200 bingbot+2\n#Fields: date time sc-status cs-uri-stem\n2024-01-02 03:04:06 500 /y\n")
    w = logs.read_w3c(spark, str(tmp_path / "iis.log")).orderBy("time").collect()
    assert [(x.path, x.status, x.user_agent) for x in w] == [("/x?q=1", 200, "bingbot 2"), ("/y", 500, None)] and str(w[0].time) == "2024-01-02 03:04:05"


def test_streamed_logs_give_the_batch(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(LINES))
    rows = streams.log_stream(spark, str(folder))
    counted = logs.with_bots(rows).groupBy("family").agg(F.count(F.lit(1)).alias("hits"))
    counted.writeStream.outputMode("complete").format("memory").queryName("hits").trigger(availableNow=True).start().awaitTermination()
    batch = logs.with_bots(logs.read_log(spark, str(folder))).groupBy("family").agg(F.count(F.lit(1)).alias("hits"))
    assert set(map(tuple, spark.table("hits").collect())) == set(map(tuple, batch.collect()))
    streams.all_available(streams.once(rows.select("ip", "time"), "time", ["ip"]), str(out), str(tmp_path / "c1"))
    assert spark.read.parquet(str(out)).count() == 3


def test_bounded_event_sink(spark, tmp_path):
    src = tmp_path / "events"
    spark.range(10).selectExpr("id as sequence").coalesce(1).write.parquet(str(src))
    events = spark.readStream.schema("sequence bigint").parquet(str(src))
    streams.capped_sink(events, str(tmp_path / "sink"), str(tmp_path / "c"), 4).awaitTermination()
    assert sorted(r.sequence for r in spark.read.parquet(str(tmp_path / "sink/events")).collect()) == [0, 1, 2, 3]
    assert tuple(spark.read.parquet(str(tmp_path / "sink/coverage")).select("captured", "dropped").first()) == (4, 6)


def test_breaker_keeps_streaks_between_batches(spark, tmp_path):
    src = tmp_path / "fetches"
    src.mkdir()
    events = spark.readStream.schema("host string, seq bigint, status int").option("maxFilesPerTrigger", 1).parquet(str(src))
    for k, rows in enumerate([[("h", 0, 500), ("g", 0, 200)], [("h", 1, 429), ("h", 2, None)]]):
        spark.createDataFrame(rows, "host string, seq bigint, status int").coalesce(1).write.mode("append").parquet(str(src))
    seen = []
    streams.breaker(events, 3).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in seen:
        last[r.host] = (r.streak, r.open)
    assert last == {"h": (3, True), "g": (0, False)}


ROBOTS = "User-agent: Googlebot\nUser-agent: bingbot\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow:\nRequest-rate: 1/10\n\nUser-agent: googlebot\nDisallow: /more\n"


def test_robots(spark):
    rules = robots.rules(spark, ROBOTS)
    pages = spark.createDataFrame([(u,) for u in ("https://x/private", "https://x/private/open/a", "https://x/more", "https://x/a.pdf", "https://x/a.pdf?x", "https://x")], "url string")
    ask = lambda agent: [r.allowed for r in robots.allowed(pages, robots.for_agent(rules, agent)).collect()]
    assert ask("Googlebot-Image") == [False, True, False, True, True, True]
    assert ask("otherbot") == [True, True, True, False, True, True]
    assert robots.delay(robots.for_agent(rules, "bingbot")).first()[0] == 2.0 and robots.delay(robots.for_agent(rules, "x")).first()[0] == 10.0
    access = {r.agent: (r.allowed, r.named) for r in robots.ai_access(spark, "User-agent: GPTBot\nDisallow: /\n").collect()}
    assert access["GPTBot"] == (False, True) and access["CCBot"] == (True, False)


def test_sitemaps(spark, tmp_path):
    xml = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml"><url><loc> https://x/a </loc><lastmod>2024-01-01</lastmod><xhtml:link rel="alternate" hreflang="de" href="https://x/de"/></url><url><loc>https://x/b</loc></url></urlset>'
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(b"<sitemapindex><sitemap><loc>https://x/a.xml</loc></sitemap></sitemapindex>"))
    (tmp_path / "c.txt").write_text("https://x/c\nnot\n")
    (tmp_path / "d.xml").write_text("<urlset><url><loc>https://x/d</loc></url>")
    e = sitemaps.read_sitemaps(spark, str(tmp_path))
    assert sorted((r.kind, r.loc) for r in e.where("kind <> 'document'").collect()) == [("sitemap", "https://x/a.xml"), ("url", "https://x/a"), ("url", "https://x/b"), ("url", "https://x/c"), ("url", "https://x/d")]
    assert e.where("kind = 'document' and error is not null").count() == 1
    assert [tuple(r) for r in sitemaps.hreflang(e).collect()] == [("https://x/a", "https://x/de", "de")]
    assert sitemaps.frames(e)["sitemap"].count() == 4


PAGE = """<!DOCTYPE html><html lang="en"><head><title>My  &amp; title</title><meta name="description" content="d"><meta charset="utf-8"><meta name="robots" content="noindex"><link rel="canonical" href="/c"><link rel="next" href="?p=2">
<link rel="alternate" hreflang="de" href="/de"><script src="/a.js"></script><script async src="/b.js"></script><link rel="stylesheet" href="/s.css"><style>p{background:url('/bg.png')}</style>
<script type="application/ld+json">{"@type": "Article", "author": {"@type": "Person"}}</script><script type="application/ld+json">{bad}</script><meta property="og:title" content="OG"></head>
<body><nav><a href="/n" rel="nofollow">nav</a></nav><main><h2>Before</h2><h1><a href="/h">Head <img src="x.png" alt="pic"></a></h1><p>Some text<p>More <b>bold</b> text lorem  ipsum dolor sit amet<h3>Deep</h3><a href="/img" target="_blank"><img src="y.png"></a>
<ul><li>One<li>Two</ul><form action="/f" method="POST"><input type="password"></form><iframe src="/frame"></iframe><template><title>no</title><a href="/no">no</a></template></main><footer><a href="https://other/x">out</a></footer></body></html>"""


def test_page_parser():
    p = html.parse("https://x/dir/page", PAGE)
    assert p["title"] == "My & title" and p["title_count"] == 1 and p["meta_description"] == "d" and p["doctype"] == "html" and p["lang"] == "en"
    assert p["canonical"] == "/c" and p["rel_next"] == "https://x/dir/page?p=2" and p["hreflang"] == [{"lang": "de", "url": "https://x/de"}]
    assert [h["level"] for h in p["heading_outline"]] == [2, 1, 3] and p["h1"] == "Head" and p["heading_outline"][1]["region"] == "content"
    links = {x["destination"]: x for x in p["links"]}
    assert list(links) == ["https://x/n", "https://x/h", "https://x/img", "https://other/x"]
    assert links["https://x/n"]["nofollow"] and links["https://x/n"]["position"] == "nav" and links["https://other/x"]["position"] == "footer"
    assert p["link_placement"]["in_heading_total"] == 1 and p["link_placement"]["image_no_text"] == [{"destination": "https://x/img"}]
    assert p["forms"] == [{"method": "post", "action": "https://x/f", "has_password": True}] and p["images_missing_alt_attr"] == 1
    assert (p["structured_data"], p["structured_data_parsed"], p["schema_types"]) == (2, 1, ["Article", "Person"]) and p["og"] == {"og:title": "OG"}
    assert p["blocking"] == ["https://x/a.js", "https://x/s.css"] and {"type": "css", "url": "https://x/bg.png"} in p["resources"]
    assert p["content_strategy"] == "main" and "nav" not in p["content_text"].split() and p["lorem_ipsum_count"] == 1
    assert (p["outlinks"], p["external_outlinks"], p["content_frames"], p["content_frames_same_origin"]) == (3, 1, 1, 1)
    assert "# [Head](https://x/h)" in p["markdown"].replace("# Head", "# [Head](https://x/h)") and "- One" in p["markdown"]
    assert html.parse("u", None) is None and html.parse("u", "")["title"] is None


def test_document_skeleton():
    bad = html.parse("https://x/", "<html><head><meta name=a content=b><div>x</div><title>late</title></head><head></head><body></body><body></body>")
    assert (bad["head_count"], bad["body_count"], bad["invalid_head_elements"], bad["title_outside_head"]) == (2, 2, "div", True)


def test_parsed_frames(spark):
    pages = spark.createDataFrame([("https://x/dir/page", PAGE), ("https://x/2", None)], "url string, html string")
    parsed = html.parsed_pages(pages)
    assert parsed.count() == 2 and html.link_rows(parsed).count() == 4 and html.form_rows(parsed).first().action == "https://x/f"
    assert {(r.hash is None, r.pages, r.dominant) for r in html.boilerplate_report(parsed).collect()} == {(True, 1, False), (False, 1, True)}


def test_references_without_semicolon_stay():
    page = '<!DOCTYPE html><html lang="a&amp"><head><title>x &amp;&amp; y&ampz &lt</title><script type="application/ld+json">{"@type": "A&amp"}</script></head><body><nav class="&lt">&ampm;</nav><a href="/p?a=1&copy=2&amp;c=3">&am</a></body></html>'
    p = html.parse("https://x/", page)
    assert (p["title"], p["lang"], p["schema_types"]) == ("x && y&ampz &lt", "a&amp", ["A&amp"])
    assert (p["text"], p["links"][0]["raw_href"], p["links"][0]["anchor"]) == ("&ampm;&am", "/p?a=1&copy=2&c=3", "&am")
