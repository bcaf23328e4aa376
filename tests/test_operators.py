import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import corpus, joins, periods, rollups, search, storage


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_external_join(spark):
    pages = spark.createDataFrame([("https://X/a/", 1), ("https://x/b", 2), ("relative", 3), (None, 4)], "url string, n int")
    rows = spark.createDataFrame([("https://x:443/a", "q"), ("https://x/a#f", "r"), ("https://x/only", "s"), ("https://y/other", "t"), ("", "u")], "page string, v string")
    j = joins.external_join(pages, rows, row_url="page")
    assert {r.part: r.rows for r in j.summary().collect()} == {"joined": 2, "crawl_only": 1, "external_only": 2, "unkeyable_pages": 2, "unkeyable_rows": 1}
    assert [r.external.page for r in joins.orphan_rows(j).collect()] == ["https://x/only"]
    with pytest.raises(ValueError, match="no column url"):
        joins.external_join(pages, rows)


def test_reverse_links_by_key(spark):
    links = spark.createDataFrame([(k, d) for k, d in enumerate(["https://x/a", "https://x/a#f", "https://x/b", "https://x/a"])], "seq bigint, destination string")
    assert [r.seq for r in joins.reverse_links(links, "https://x/a", after=0, limit=1).collect()] == [1]


def test_period_windows_clamp_months(spark):
    one = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(periods.windows(F.lit("2024-03-31").cast("date"), 1))]).first()
    assert tuple(one) == (datetime.date(2024, 3, 1), datetime.date(2024, 3, 31), datetime.date(2024, 1, 30), datetime.date(2024, 2, 29))


def test_breakdown(spark):
    rows = spark.createDataFrame([("2024-03-10", "a", 6), ("2024-03-11", "b", 3), ("2024-02-10", "a", 3), ("2024-03-12", "c", 1), ("2024-02-11", "d", 5)], "day string, kind string, n bigint")
    got = {r.dimension: (r.now, r.before, r.share, r.change, r.status) for r in periods.breakdown(rows, "day", "kind", "n", "2024-03-31", 1, shown=2).collect()}
    assert got == {"a": (6, 3, 60.0, 100.0, "ok"), "b": (3, 0, 30.0, None, "new"), "other": (1, 5, 10.0, -80.0, "ok")}


def test_rollups(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, 2, 3, 10, 200])], "k bigint, v double")
    r = rollups.size_report(df, "v").first()
    assert (r.median, r.p75, r.most) == (3.0, 10.0, 200.0)
    assert [x.v for x in rollups.outliers(df, "v").collect()] == [200.0]
    events = spark.createDataFrame([("h", k, s) for k, s in enumerate([200, 500, 429, 503, 200, 500])], "host string, k int, status int")
    s = rollups.streaks(events, "host", "k", (F.col("status") == 429) | (F.col("status") >= 500)).first()
    assert (s.streak, s.current) == (3, 1)
    scans = spark.createDataFrame([("h", "c", k, f"u{k}", k == 0) for k in range(4)], "host string, config string, finished int, uuid string, pinned boolean")
    assert {x.uuid for x in rollups.retained(scans, 2).where("prune").collect()} == {"u1"}


def test_corpus_fingerprints(spark):
    def plain(text):
        import re

        words = re.findall(r"\w{2,}", text.lower())
        runs = [" ".join(words)] if 0 < len(words) <= 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
        votes = [0] * 64
        for r in runs:
            h = 0xCBF29CE484222325
            for b in r.encode():
                h = (h ^ b) * 0x100000001B3 % 2**64
            for i in range(64):
                votes[i] += 1 if h >> i & 1 else -1
        return sum(1 << i for i in range(64) if votes[i] > 0)

    texts = ["Été à la plage, a b cd", "one", "x", "the quick brown fox jumps over the lazy dog again and again"]
    df = spark.createDataFrame([(str(k), t, True) for k, t in enumerate(texts)], "id string, text string, indexable boolean")
    got = {r.id: r.fingerprint % 2**64 for r in corpus.fingerprints(df).collect()}
    assert got == {str(k): plain(t) for k, t in enumerate(texts) if len(t) > 1}


def test_large_components_are_split_by_the_same_rule(spark, monkeypatch):
    rng = random.Random(3)
    prints = {0}
    for _ in range(120):  # one chained component of fingerprints, many of them far apart
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)))
    monkeypatch.setattr(corpus, "MAX_COMPONENT", 8)
    docs = spark.createDataFrame([(str(p), f"text {p}") for p in prints], "id string, text string").coalesce(2)
    monkeypatch.setattr(corpus, "fingerprints", lambda d: d.select("id", F.col("id").cast("long").alias("fingerprint"), F.lit(1).alias("n_shingles")))
    got = corpus.near_clusters(docs, 0.95).collect()
    want = [sorted(map(str, c)) for c in corpus.cliques(list(prints), 0.95)]
    assert sorted(r.members for r in got) == sorted(want) and len(want) > 15
    assert all(r.min_similarity >= 0.95 for r in got)


def test_near_clusters_are_cliques(spark):
    base = " ".join(f"word{k}" for k in range(200))
    docs = [("a", base), ("b", base.replace("word5 ", "other ")), ("c", base), ("d", " ".join(f"else{k}" for k in range(200))), ("e", None)]
    df = spark.createDataFrame([(i, t, True) for i, t in docs], "id string, text string, indexable boolean")
    got = [(r.members, r.min_similarity) for r in corpus.near_clusters(df, 0.8).collect()]
    assert [m for m, _ in got] == [["a", "b", "c"]] and got[0][1] >= 0.8
    assert [r.members for r in corpus.exact_groups(df.where("text is not null")).collect()] == [["a", "c"]]
    assert corpus.cliques([0b0, 0b1, 0b11], 1 - 1.5 / 64) == [[0, 1]]
    ok, lost = corpus.eligible(df.unionByName(df.where("id = 'a'")))
    assert ok.count() == 4 and {r.reason: r.documents for r in lost.collect()} == {"no_text": 1, "duplicate_id": 1}


def test_template_shingles_do_not_vote(spark):
    rows = [(str(k), "site menu home about contact " + " ".join(f"w{k}x{i}" for i in range(5)), True) for k in range(25)]
    df = spark.createDataFrame(rows, "id string, text string, indexable boolean")
    assert {r.shingle for r in corpus.template_shingles(df).collect()} == {"site menu home", "menu home about", "home about contact"}
    assert corpus.template_shingles(df.limit(19)).count() == 0


def test_extractors_read_whole_documents_and_return_all_matches(spark):
    long = "<ul>" + "".join(f"<li><i>{k}</i></li>" for k in range(250)) + "</ul>" + "x" * 2_100_000 + "<ul><li>last 250</li></ul>"
    docs = spark.createDataFrame([("a", True, long)], "url string, ok boolean, html string")
    r = search.extract_regex(docs, "n", r"(\d+)", 1).first()
    assert r.n == [str(k) for k in range(251)] and r.n_budget_exceeded is False
    assert search.extract_elements(docs, "t", "ul li").first().t == [*map(str, range(250)), "last 250"]
    nested = "<div class=k><div><b>1</b></div><p><b>2</b></p></div><div><b>3</b></div>"
    assert search.elements(nested, search.compiled("div.k div b"), None) == ["1"] and search.elements(nested, search.compiled("div b"), None) == ["1", "2", "3"]


def test_search(spark):
    docs = spark.createDataFrame([("a", True, "<p>Hello World</p>", "Hello World"), ("b", True, "<p>bye 12</p>", "bye 12"), ("c", False, None, None)], "url string, ok boolean, html string, text string")
    found, one = search.run_filter(docs, search.Filter("hello"))
    assert [r.url for r in found.collect()] == ["a"] and tuple(one.first()) == (1, 0.5, 2, 1)
    found, one = search.run_filter(docs, search.Filter("hello", kind="not_contains", case_sensitive=True))
    assert {r.url for r in found.collect()} == {"a", "b"}
    found, _ = search.run_filter(docs, search.Filter(r"<p>(?P<w>\w+) \d+", kind="regex", scope="raw"))
    assert [r.url for r in found.collect()] == ["b"]
    for bad in ("(", "(?P=x)"):
        with pytest.raises(ValueError):
            search.Filter(bad, kind="regex")
    assert {r.url: r.n for r in search.extract_regex(docs, "n", r"(\d+)", 1).collect()} == {"a": [], "b": ["12"]}
    html = spark.createDataFrame([("a", True, "<div id=x class='k l'><a href='/1'>one <b>two</b></a><a>three</a></div><a href='/2'>out</a>")], "url string, ok boolean, html string")
    assert search.extract_elements(html, "t", "div#x.k a").first().t == ["one two", "three"]
    assert search.extract_elements(html, "t", "a[href]", "href").first().t == ["/1", "/2"]
    with pytest.raises(ValueError):
        search.compiled("a > b")
    assert search.glob_regex("a*b?.c") == r"^a.*b.\.c$"


def test_scan_folder(spark, tmp_path):
    path = str(tmp_path / "scan")
    import hashlib

    body = b"<p>x</p>"
    sha = hashlib.sha256(body).hexdigest()
    storage.write_scan(
        {
            "scan": spark.createDataFrame([(1, "x", "a", "b", False, "{}")], "scan_id int, host string, started string, finished string, partial boolean, config string"),
            "pages": spark.createDataFrame([(1, "https://x/", 200)], "url_id int, url string, status_code int"),
            "urls": spark.createDataFrame([(1, "https://x/")], "url_id int, url string"),
            "bodies": spark.createDataFrame([(sha, body)], "sha256 string, content binary"),
            "responses": spark.createDataFrame([(1, 1, 200, sha, "retained", None), (2, 9, 200, "lost", "retained", None)], "response_id int, url_id int, status_code int, body_sha256 string, body_state string, body_reason string"),
            "documents": spark.createDataFrame([(1, 1, "static")], "document_id int, response_id int, representation string"),
        },
        path,
    )
    scan = storage.Scan(spark, path)
    assert {r.what: r.rows for r in storage.lineage_errors(scan).collect()} == {"responses.url_id": 1, "responses.body_sha256": 1}
    assert [r.html for r in storage.retained_corpus(scan.table("responses"), scan.table("documents"), scan.table("bodies")).collect()] == ["<p>x</p>"]
    assert {r.table: r.rows for r in storage.scan_status(scan).collect()}["responses"] == 2
    with pytest.raises(FileNotFoundError):
        storage.Scan(spark, str(tmp_path))


def test_crawl_scope(spark):
    from tessella.operators.scope import Scope, rejection

    s = Scope("shop.example.co.uk", "registrable_domain", ("other.org",), ("bad.example.co.uk",), (r"\?sort=",), (r"/a", r"/b"), ("docs",))
    rows = [
        ("https://www.example.co.uk/a", "docs", ""), ("https://x.bad.example.co.uk/a", "docs", "excluded_host"), ("https://example.com/a", "docs", "outside_host"), ("https://OTHER.org/b", "docs", ""),
        ("https://shop.example.co.uk/a?sort=1", "docs", "excluded_by_pattern"), ("https://shop.example.co.uk/c", "docs", "not_included_by_pattern"), ("https://shop.example.co.uk/a", None, "outside_segment"), ("mailto:x", "docs", "outside_host"),
    ]
    df = spark.createDataFrame(rows, "url string, segment string, want string").select("want", rejection(F.col("url"), s, F.col("segment")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_assets(spark):
    from tessella.functions import assets

    css = "@font-face { font-family: a; src: url(a) } @font-face { font-display: swap; src: url(b) } @import 'x.css'; @import url(\"y.css\") print;"
    js = "var a=1;" * 100 + "debugger;console.debug(a);alert (1)"
    df = spark.createDataFrame([(css, js, None, "max-age=60"), ("", "let a = 1;\n  debugger;\n", "a", "immutable, max-age=1"), (None, "//# sourceMappingURL=old.map\n//# sourceMappingURL=new.map", "", "no-cache"), (None, "//# sourceMappingURL=data:abc", "", None)], "css string, js string, x string, cache string")
    got = df.select(assets.fonts_without_display(F.col("css")).alias("fonts"), assets.css_imports(F.col("css")).alias("imports"), assets.debug_code(F.col("js")).alias("debug"), assets.source_map(F.col("js")).alias("map"), assets.cache_verdict(F.col("cache")).alias("cache")).collect()
    assert got[0].fonts == ["font-family: a; src: url(a)"] and got[0].imports == ["x.css", "y.css"] and got[0].debug == ["alert (", "console.debug(", "debugger"]
    assert [g.debug for g in got[1:]] == [[], [], []] and [g.map for g in got] == [None, None, "new.map", None]
    assert [(g.cache.ok, g.cache.max_age) for g in got] == [(False, 60), (True, 1), (False, 0), (False, None)]
    tags = spark.createDataFrame([("script", {"src": "a"}), ("script", {"src": "a", "defer": ""}), ("script", {"src": "a", "type": "module"}), ("link", {"rel": "preload stylesheet", "href": "a"}), ("link", {"rel": "stylesheet", "href": "a", "media": "print"}), ("img", {"src": "a"})], "tag string, attrs map<string, string>")
    assert [r[0] for r in tags.select(assets.render_blocking(F.col("tag"), F.col("attrs"))).collect()] == [True, False, False, True, False, False]
    libs = spark.createDataFrame([("u1", "js", True, "a b"), ("u2", "js", True, "ab\n"), ("u1", "js", True, "a b"), ("u3", "css", True, "ab"), ("u4", "js", False, "ab"), ("u5", "js", True, None)], "url string, kind string, ok boolean, text string")
    assert sorted((r.kind, r.url, r.addresses) for r in assets.duplicate_libraries(libs).collect()) == [("js", "u1", 2), ("js", "u2", 2)]


def test_rendering(spark):
    from tessella.plans import rendering

    facts = "url string, words bigint, links bigint, images array<string>, title string, h1 string, canonical string, jsonld_types array<string>, html_bytes bigint"
    raw = spark.createDataFrame([("same", 100, 3, ["a"], "t", "h", "c", ["X"], 900), ("lost", 100, 3, [], "t", "", "", [], 900), ("spa", 3, 0, None, "t", None, None, None, 100)], facts)
    raw = raw.withColumn("shell", F.when(F.col("url") == "spa", rendering.empty_shell(F.lit('<body><div class="x" id="root"> </div>'))))
    rendered = spark.createDataFrame([("same", 110, 3, ["a"], "t", "h", "c", ["X"], 990), ("lost", 0, 0, [], "", None, "", [], 100), ("spa", 400, 20, ["i"], "u", "h", "c", ["Y", "X"], 9000)], facts)
    got = {r.url: (r.findings, r.types_added) for r in rendering.compared(raw, rendered).collect()}
    assert got["same"] == (["all_clear"], []) and got["lost"] == (["render_unavailable"], [])
    assert got["spa"] == (["empty_shell", "links_after_scripts", "title_changes", "h1_differs", "canonical_changes", "types_after_scripts", "images_after_scripts"], ["X", "Y"])


def test_bots_and_prices(spark):
    from tessella.functions import scores
    from tessella.sources import logs

    agents = ["Mozilla/5.0 (Linux; Android) Mobile (compatible; Googlebot/2.1)", "googlebot-image/1.0", "APIs-Google", "YandexDirect/3", "some crawler here", "-", "", None, "Mozilla/5.0", "Pinterest/0.2"]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in agents], "a string").select(logs.bot(F.col("a"))["name"]).collect()]
    assert len(logs.BOTS) == 53 and got == ["Googlebot Smartphone", "Googlebot Image", "APIs-Google", "Yandex (other)", "Other bot", None, None, None, None, "Pinterestbot"]
    texts = ["1,23,456 USD or 100 EUR", "500 kr", "12 у.е.", "99 рублей", "XX$ 5", "£1.299"]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scores.price(F.col("t"))).collect()]
    assert len(scores.CURRENCIES) == 47 and [(r.value, r.currency) if r else None for r in rows] == [(100.0, "EUR"), (500.0, None), (12.0, None), (99.0, "RUB"), None, (1299.0, "GBP")]


def test_elements_keep_references_without_semicolon(spark):
    html = '<article><h1>a &amp; b&amp;c &lt;x&gt; &#x27;&amp</h1></article><article><h1>&ampx; &am</h1><a href="?a=1&copy=2&amp;b">R&amp;D</a></article>'
    docs = spark.createDataFrame([("u", True, html), ("v", True, "<article><h1>\ue000 &lt</h1></article>")], "url string, ok boolean, html string")
    got = {r.url: r.t for r in search.extract_elements(docs, "t", "article h1").collect()}
    assert got == {"u": ["a & b&c <x> '&amp", "&ampx; &am"], "v": ["\ue000 &lt"]}
    assert search.extract_elements(docs, "t", "a[href]", "href").first().t == ["?a=1&copy=2&b"]


def test_page_types_are_each_rows_own(spark):
    from tessella.functions import scores

    rows = [("https://x/a", ["Recipe"], None), ("https://x/a", None, "article"), ("https://x/a", None, None), ("https://x/news/1", ["Article", "Article", "Event", "Other"], "article"), ("https://x/faq/job", [], "x"), (None, ["Store"], None)]
    pages = spark.createDataFrame(rows, "url string, schema_types array<string>, og_type string")
    got = sorted(map(tuple, scores.page_types(pages).collect()), key=str)
    want = [("https://x/a", "Recipe", "high", 5.0), ("https://x/a", "Article", "mid", 3.0), ("https://x/a", "WebPage", "low", 0.0), ("https://x/news/1", "Article", "high", 15.0), ("https://x/faq/job", "FAQPage", "low", 2.0), (None, "LocalBusiness", "high", 5.0)]
    assert got == sorted(want, key=str)
