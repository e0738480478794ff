"""Golden values of the expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from webquarry.functions import confidence, contacts, emails, jsonld, ranking, technology, urls
from webquarry.functions.text import clean_text, distinct_first


@pytest.fixture(scope="module")
def ask(spark):
    """Values of an expression for a list of inputs, in one job."""

    def run(values, expression, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_canonical(ask):
    got = ask([" Example.com/A/ ", "http://WWW.Ex.com:8080/a/?q=1#f", "HTTPS://Ex.com/a", "https://ex.com/a;p=1"], urls.canonical_url)
    assert got == ["https://example.com/A", "https://www.ex.com:8080/a", "https://https://Ex.com/a", "https://ex.com/a"]


def test_tracking(ask):
    given = ["http://Ex.com/a/?b=2&UTM_Source=x&a=1&b=3#f", "https://ex.com?ref=x", "https://ex.com/p?q=a%20b&e=", "", "ex.com/?x=%zz", "https://ex.com/?a=*~"]
    got = ask(given, urls.strip_tracking)
    assert got == ["http://ex.com/a?b=2&b=3&a=1", "https://ex.com", "https://ex.com/p?q=a+b", "", "https://ex.com?x=%25zz", "https://ex.com?a=%2A~"]
    assert ask(got, urls.strip_tracking) == got  # once is enough


def test_domains(ask):
    assert ask(["https://www.example.com/about", "https://blog.example.com", "http://www.com", "example.com/x"], urls.root_domain) == [
        "https://example.com", "https://blog.example.com", "http://www.com", "https://"]
    assert ask(["https://www.Example.com/a"], urls.domain_name) == ["www.example.com"]
    assert ask(["web.com", "www.w3.org", "wwwexample.com"], urls.lstripped_www) == ["eb.com", "3.org", "example.com"]
    assert ask(["https://e.com", "https://e.com/", "https://e.com/a", "https://e.com/a/b", "https://e.com/a//b"], urls.path_depth) == [0, 0, 1, 2, 3]
    assert ask(["https://e.com/our-services/consulting", "https://e.com/"], urls.slug_words) == [["our", "services", "consulting"], []]


def test_requests_are_checked(spark):
    sites = spark.createDataFrame([("acme.io ", True), ("  ", False), (None, False), ("http://127.0.0.1", False), ("https://10.0.0.1", True)], "url string, debug boolean")
    good, bad = urls.requests(sites)
    assert [(r.url, r.canonical) for r in good.collect()] == [("acme.io", "https://acme.io")]
    assert sorted(r.error.split(":")[0] for r in bad.collect()) == ["IP address URLs are not allowed", "Localhost URLs are not allowed", "url must not be empty", "url must not be empty"]


def test_page_scores(ask):
    given = ["https://e.com/contact", "https://e.com/about-us", "https://e.com/services", "https://e.com/blog/post", "https://e.com/", "https://e.com/en/98"]
    got = [(r.page_type, r.confidence, r.score) for r in ask(given, ranking.page_score)]
    assert got == [("contact", 0.75, 100), ("about", 0.75, 95), ("services", 0.75, 90), ("blog", 0.99, -500), ("homepage", 0.8, 0), ("unknown", 0, 0)]


def test_ranking_keeps_the_best(spark):
    rows = spark.createDataFrame([("s", f"https://e.com/{p}") for p in ("contact", "blog/article", "services", "x")], "site string, url string")
    assert [r.url for r in ranking.rank_pages(rows, 2).orderBy("rank").collect()] == ["https://e.com/contact", "https://e.com/services"]


def test_homepage_beats_content(spark):
    rows = spark.createDataFrame([("https://e.com/", "contact us", "")], "url string, title string, none string")
    signals = {"title": F.col("title"), "h1": F.col("none"), "meta_description": F.col("none"), "body_text": F.col("none")}
    r = rows.select(ranking.classify(F.col("url"), signals).alias("c")).first().c
    assert (r.type, r.confidence) == ("homepage", 0.4)


@pytest.mark.parametrize("url,text,kind", [
    ("https://e.com", "", "homepage"), ("https://e.com/index.html", "", "homepage"), ("https://e.com/team/jane", "", "team_profile"), ("https://e.com/team", "", "team"),
    ("https://mybookshop.com/x", "", "booking"), ("https://company.com/x", "", "about"), ("https://e.com/x", "FAQ q: q: q: question question question", "faq"), ("https://e.com/x", "faq q:", "unknown"),
])
def test_evidence_types(spark, url, text, kind):
    assert spark.createDataFrame([(url, text)], "u string, t string").select(ranking.evidence_page_type(F.col("u"), F.col("t")).alias("k")).first().k == kind


def test_confidence(spark):
    table = {"schema": (0.99, 0.69, 0.99), "mailto": (0.99, 0.65, 0.99), "tel": (0.98, 0.63, 0.99), "footer": (0.90, 0.55, 0.98), "form": (0.85, 0.50, 0.93), "visible": (0.80, 0.45, 0.88), "regex": (0.55, 0.20, 0.63), "unknown": (0.35, 0.0, 0.43)}
    s, yes, no = F.col("s"), F.lit(True), F.lit(False)
    rows = spark.createDataFrame([(k,) for k in table], "s string").select("s", confidence.confidence(s, yes), confidence.confidence(s, no), confidence.confidence(s, yes, True)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == table


def test_scores_merge(spark):
    rows = [("a", i, c) for i, c in enumerate([0.99, 0.80])] + [("b", i, c) for i, c in enumerate([0.55, 0.80, 0.80])] + [("c", i, 0.50) for i in range(6)] + [("d", 0, 0.3)]
    df = spark.createDataFrame(rows, "value string, pos int, confidence double").selectExpr("*", "'x' AS source", "'valid' AS validation")
    assert {r.value: r.confidence for r in confidence.merge_scores(df, ("value",)).collect()} == {"a": 0.93, "b": 0.78, "c": 0.60, "d": 0.3}


def test_emails(ask):
    given = ["support@acme.io", "info@acme.io", "sales@acme.io", "jo@gmail.com", "jo@acme.io", "info@example.com", "sysadmin@acme.io", ""]
    assert ask(given, emails.email_category) == ["support", "business", "sales", "personal", "unknown", "system", "system", "unknown"]
    assert ask(["a@latest.com", "jo@acme.io", "0123456789abcdef0123456789abcdef@acme.io"], emails.is_fake_email) == [True, False, True]
    assert ask(["jo@acme.io", ".jo@acme.io", "j..o@acme.io", "jo@-acme.io", "jo@acme", "jo@acme.test"], emails.is_valid_email) == [True] + [False] * 5
    assert ask([["jo@acme.io", "sales@acme.io", "info@acme.io", "info@acme.io", "help@acme.io"]], emails.verified_emails, "array<string>") == [["info@acme.io", "help@acme.io", "sales@acme.io"]]


def test_phones_and_addresses(ask):
    assert ask(["(555) 123-4567", "+44 20 7946 0958", "1-555-234-5678", "12345", "555 234 5678 ext. 9"], contacts.to_e164) == ["+15551234567", "+442079460958", "+15552345678", None, "+15552345678"]
    assert ask(["(555) 123-4567", "(555) 234-5678"], contacts.normalise_phone) == [None, "+15552345678"]
    assert ask(["call +1 (555) 234-5678 or 555-345-6789, not 4041894974608795 or 42.144.35.254"], contacts.phones_in) == [["+15552345678", "+15553456789"]]
    assert ask(["at 123 Main St, Springfield, IL 62701 today", "1 A St, B, ZZ 12345"], contacts.addresses_in) == [["123 Main St, Springfield, IL 62701"], []]
    assert ask([["s, city, ST 12345"], ["s, city, ST, 12345", "t, x, ST, 1"], [], ["nowhere"]], contacts.count_locations, "array<string>") == [1, 1, 0, 1]


def test_phones_beside_other_digits(ask):
    """A number ends where its plan says, whatever digits follow; digits within a token are none."""
    given = [
        "on +1 (608) 555-2280 37.92.178.161 in, +1-884-555-3918 63", 'token = "9885103314b39ed955fd", id 1 9885103314é', "ask 6085552280x12, 6085552281 ext. 3, 6085552282.",
        "+1 (608) 555-22801 or +1 608 555 228", "+44 20 7946 0958 or +1 6085552280",
    ]
    assert ask(given, contacts.phones_in) == [["+16085552280", "+18845553918"], [], ["+16085552280", "+16085552281", "+16085552282"], [], ["+442079460958", "+16085552280"]]


def test_social(ask):
    assert ask(["https://www.facebook.com/a", "http://m.fb.com/a", "https://wix.com", "/x"], contacts.social_platform) == ["facebook", "facebook", None, None]
    assert ask(["//twitter.com/a", "https://twitter.com/a"], lambda u: contacts.normalise_social_url(u, F.lit("twitter"))) == ["https://x.com/a"] * 2
    assert ask(["http://api.wa.me/1"], lambda u: contacts.normalise_social_url(u, F.lit("whatsapp"))) == ["https://wa.me/1"]


def test_technology(ask):
    t = ask(["<script>initialize(</script> /WP-content/ wixstatic.com"], technology.technology)[0]
    assert (t.cms, t.widgets) == ("WordPress", ["Zendesk"])


def test_jsonld(ask):
    given = [['{"@type": "Organization", "founder": "Ann Lee", "team": [{"name": "Bo", "title": "CEO"}]}', "{bad", '[{"@type": "Person", "name": "P"}]', '{"@graph": [{"@type": "Person"}]}']]
    assert ask(given, jsonld.organisation_members, "array<string>") == [["Bo - CEO", "Ann Lee"]]
    assert [e.name for e in ask(given, jsonld.entities, "array<string>")[0]] == ["", "P"]
    point = [['{"contactPoint": {"address": {"streetAddress": "1 A", "addressLocality": "B"}}}', '{"@type": "PostalAddress", "streetAddress": "2 C", "postalCode": "9"}']]
    assert ask(point, jsonld.postal_addresses, "array<string>") == [["1 A, B", "2 C, 9"]]


def test_texts(ask):
    assert ask([" ", "x", " ab ", "a" * 198 + "   zz"], clean_text) == [None, None, "ab", "a" * 198]
    assert ask([["b", "A", "a", "B", "c"]], lambda a: distinct_first(a, F.lower), "array<string>") == [["b", "A", "c"]]
