import pytest
from pyspark.sql import functions as F

from tessella.functions import scores, values


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("cell", "want"), [("12", 12), (" 12.9 ", 12), ("-2,5", -2), ("1,234,5", None), ("NaN", None), ("inf", None), ("", None), ("abc", None), ("1e3", 1000), (None, None), ("5d", None)])
def test_integer(spark, cell, want):
    assert one(spark, values.integer(F.lit(cell))) == want


def test_text_and_truth(spark):
    assert one(spark, values.text(F.lit("\t  a b \n"))) == "a b" and one(spark, values.text(F.lit(" \t"))) is None
    assert [one(spark, values.truth(F.lit(x))) for x in ("true", "Yes", "1", "y", "2", "no", "0", "", None)] == [True] * 5 + [False] * 4


def test_directives(spark):
    got = one(spark, values.directives(F.lit("NoIndex, follow; none"), F.lit("bingbot: nofollow, googlebot: noarchive, unavailable_after: 25 Jun 2030, max-snippet:-1")))
    assert got == sorted(["noindex", "follow", "none", "nofollow", "noarchive", "unavailable_after: 25 jun 2030", "max-snippet:-1"])


@pytest.mark.parametrize(("text", "want"), [("Price: $1,299.00", (1299.0, "USD")), ("12 990 ₽", (12990.0, "RUB")), ("1.299,50 €", (1299.5, "EUR")), ("CA$ 12", (12.0, "CAD")), ("no price", None), ("1,23,456 USD", None), ("XX$ 5", None), ("99,9 EUR", (99.9, "EUR"))])
def test_price(spark, text, want):
    got = one(spark, scores.price(F.lit(text)))
    assert (None if got is None else tuple(got)) == want


@pytest.mark.parametrize(("s", "want"), [("=1+1", "'=1+1"), ("+a", "'+a"), ("@x", "'@x"), ("-1", "'-1"), ("plain", "plain"), ("a=b", "a=b")])
def test_formula_safe(spark, s, want):
    assert one(spark, values.formula_safe(F.lit(s))) == want


def test_fingerprint_is_stable(spark):
    import hashlib

    assert one(spark, values.fingerprint(F.lit("X"), F.lit("https://x/"), F.lit(None))) == hashlib.sha1(b"X|https://x/|None").hexdigest()[:12]


def test_refresh_target(spark):
    assert [one(spark, values.refresh_target(F.lit(x))) for x in ("0; url=/next", "5", "0;URL='https://x'", None, "0; url=")] == [True, False, True, False, False]


def test_redirect_rules(spark):
    make = lambda old, new, style, t="": one(spark, scores.redirect_rule(F.lit(old), F.lit(new), style, t))
    assert make("https://x/a$", "/b", "nginx") == r"rewrite ^/a\$$ /b permanent;"
    assert make("https://x/a", "/b", "apache-redirect") == "Redirect 301 /a /b"
    assert make("/a", None, "apache-rewrite-rule").startswith("ERROR") and make("", "/b", "nginx").startswith("ERROR")
    assert make("/a", "/b", "custom", "{{from}} to {{to}}") == "/a to /b"
    with pytest.raises(ValueError):
        make("/a", "/b", "iis")


def test_soft404(spark):
    rows = [("a", 200, False, False), ("a", 302, False, False), ("b", 404, False, False), ("b", 410, False, False), ("c", 200, False, False), ("c", 404, False, False), ("d", None, True, False), ("d", 404, False, False), ("e", 404, False, False)]
    df = spark.createDataFrame(rows, "site string, status int, blocked boolean, access_blocked boolean")
    assert {r.site: r.verdict for r in scores.soft404(df).collect()} == {"a": "warning", "b": "pass", "c": "unknown", "d": "refused", "e": "unknown"}


def test_citability(spark):
    good = "# How does the river work?\n\n" + " ".join(["Water flows downhill from 12 springs in 1998 according to research"] * 5) + "\n\n- one\n- two\n"
    c = one(spark, scores.citability(F.lit(good)))
    assert c.question_headings == 1 and c.answers_in_target_band == 1 and c.structure_quality >= 20 and c.grade in "ABC"
    assert one(spark, scores.citability(F.lit(" "))) is None and one(spark, scores.citability(F.lit(None))) is None


def test_security_and_llms_txt(spark):
    h = F.create_map(F.lit("strict-transport-security"), F.lit("x"), F.lit("content-security-policy"), F.lit("frame-ancestors 'none'"))
    s = one(spark, scores.security_score(h))
    assert s.score == 65 and "x-frame-options" not in s.missing
    t = one(spark, scores.llms_txt_score(F.lit("# Brand\n## A\n## B\n## C\n[docs](d) [pricing](p) [cases](c)\nA service"), "Brand"))
    assert t.passed == 9 and t.grade == "A" and one(spark, scores.llms_txt_score(F.lit(""))) is None
