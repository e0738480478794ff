"""Pages: the digest, their evidence, their business view, their sites."""

from __future__ import annotations

import json

import pytest

from webquarry.operators import analyze, business, evidence, merge, site
from webquarry.plans import fixtures as X
from webquarry.sources import html, sitemaps
from webquarry.streaming import pages as streaming


def test_tree_repairs():
    d = html.digest("<p><b>one<br><p>two <i>x</i>y<article>in</article></p><ul><li>a<li>b</ul><script>var t='</p>';</script><table><tr><td>1<td>2<tr><td>3</table>&amp;", "")
    assert d["paragraphs"] == ["one", "twoxyin"]
    assert d["lists"] == [{"type": "ul", "items": ["a", "b"]}]
    assert d["tables"] == [{"headers": [], "rows": [["1", "2"], ["3"]]}]
    assert d["script_text"] == "var t='</p>';" and d["strings"][-1] == "&"


def test_text_has_no_separator():
    assert html.digest("<h1>Hello <b>World</b></h1><!-- x --><style>y</style>", "")["h1"] == "HelloWorld"


def test_references_need_semicolons():
    page = '<title>a &amp b &amp;&amp; c&amp</title><h1>x &copy y &copy; &ampz; &#169; R&D</h1><a href="/s?a=1&copy=2&amp;b&amp">l</a><script>"&amp;" && "&amp"</script><p>\x01&lt'
    d = html.digest(page, "")
    assert d["title"] == "a &amp b && c&amp" and d["h1"] == "x &copy y © &ampz; © R&D" and d["paragraphs"] == ["\x01&lt"]
    assert d["links"][0]["href"] == "/s?a=1&copy=2&b&amp" and d["script_text"] == '"&amp;" && "&amp"'


def test_forms_and_team():
    d = html.digest(X.PAGES[1][2], X.PAGES[1][1])
    assert d["forms"][0]["fields"] == ["email", "message"] and d["forms"][0]["button"] == "Send" and d["forms"][0]["action"] == "https://www.acme.io/send"
    d = html.digest(X.PAGES[2][2], X.PAGES[2][1])
    assert [(m["name"], m["title"]) for m in d["members"]] == [("Jane Doe", "Founder")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([*X.PAGES[:4], (-9, "https://acme.io/none", None)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def found(pages):
    return {r.page_id: r.e for r in evidence.page_evidence(pages).collect()}


def test_evidence(found):
    assert set(found) == {-1, -2, -3, -4}
    home, contact, services = found[-1], found[-2], found[-4]
    assert (home.page_type, home.title, home.title_tag, home.meta_title, home.meta_description) == ("homepage", "Welcome to Acme", "Acme | Tools", "", "We make tools.")
    assert home.logo_url == "https://www.acme.io/logo.png" and home.navigation_links == ["https://www.acme.io/about", "https://www.acme.io/contact"]
    assert [(i.value, i.method, i.confidence, i.importance) for i in home.emails] == [("info@acme.io", "mailto", 0.99, 10), ("office@acme.io", "mailto", 0.99, 10)]
    assert [(i.value, i.method) for i in home.phones] == [("+15552345678", "tel")]
    assert [i.value for i in home.footer_emails] == ["office@acme.io"] and home.copyright == "© Acme 2024"
    assert [(s.schema_type, s.data.name) for s in home.schema_data] == [("organization", "Acme Corporation")]
    assert [(c.title, c.description, c.link_url) for c in home.cards] == [("Hammers", "All kinds of hammers.", "https://www.acme.io/hammers")]
    assert [i.method for i in home.social_links] == ["facebook"]
    assert contact.page_type == "contact" and len(contact.contact_forms) == 1 and len(contact.newsletter_forms) == 1 and not contact.booking_forms
    assert [i.value for i in contact.addresses] == ["1 Main St, Salem, OR 97301"] and len(contact.maps_links) == 1
    assert services.page_type == "services" and services.tables[0].headers == ["Job", "Price"] and [x.type for x in services.lists] == ["ul", "ol"]
    assert [(s.name, s.category) for s in services.scripts] == [("Shopify", "cms")] and found[-3].page_type == "team_profile"


def test_compatible_schema_types(pages):
    r = evidence.page_evidence(pages.filter("page_id = -1"), compat=True).first()
    assert [s.schema_type for s in r.e.schema_data] == ["unknown"]


def test_site_view(spark, pages):
    rows = {r.site: r for r in analyze.analyze_sites(pages, analyze.Settings(debug=True)).collect()}
    acme = rows["acme.io"]
    assert (acme.pages_scanned, acme.pages_extracted) == (3, 3)
    assert len(acme.homepage.paragraphs) == 1 and acme.contact.paragraphs == []  # shown on the homepage before
    assert [e.value for e in acme.homepage.emails] == ["info@acme.io", "office@acme.io"] and [e.value for e in acme.contact.emails] == ["support@acme.io"]
    assert acme.homepage.footer_emails == [] and acme.homepage.copyright is None and acme.footer.source == "https://www.acme.io/"
    assert len(acme.team_profiles) == 1 and acme.about is None and acme.crawled_urls[0] == "https://www.acme.io/"
    assert [t.name for t in rows["beta.io"].technology] == ["Shopify"]


def test_business_view(pages):
    b = {r.page_id: r for r in business.page_business(pages).collect()}
    assert b[-1].b.company.name == "Acme Inc" and b[-1].b.emails == ["info@acme.io"] and b[-1].b.schema[0].email == "info@acme.io"
    assert b[-4].b.services == ["Roof repair", "Tiles", "Gutters and drains"] and b[-4].b.features.has_pricing
    assert b[-2].b.forms.contact_form and b[-2].b.features.has_contact_form and b[-2].b.phones == ["+15552345678"]
    assert [s.value for s in b[-3].x.team] == ["Jane Doe - Founder"]
    assert [s.source for s in b[-2].x.addresses] == ["visible"] and b[-1].x.social["facebook"].value == "https://facebook.com/acme"


def test_merged_sites(pages):
    rows = {r.site: r for r in merge.merge_sites(business.page_business(pages)).collect()}
    acme = rows["acme.io"]
    assert acme.summary.business_name == "Acme Corporation" and acme.summary.contact_methods_found == 3
    contacts = {c.value: (c.type, c.confidence, c.source) for c in acme.presence.verified_contacts}
    assert contacts == {"info@acme.io": ("email", 0.99, "schema"), "support@acme.io": ("email", 0.85, "visible"), "+15552345678": ("phone", 0.93, "schema")}
    assert "Contact Form" in acme.summary.key_features and acme.presence.social_profiles == {"facebook": "https://facebook.com/acme"}
    assert rows["beta.io"].capabilities.technology.cms == "Shopify"


def test_pages_are_selected_by_url(pages):
    assert {r.page_id for r in analyze.select_pages(pages, 1).collect()} == {-1, -2, -4}
    assert [r.page_id for r in analyze.failures(pages).collect()] == [-9]


def test_cleaning_counts_only_what_is_kept():
    # the second item of page one is beyond its limit, so page two may show it
    assert site.keep_new([[["a", "b", "a"]], [["a", "b"]]], [1]) == [[[0]], [[1]]]
    assert site.keep_new([[["a", "b"]], [["b", "c"]]], [0]) == [[[0, 1]], [[1]]]


def test_sitemaps(spark):
    assert sitemaps.locations("<urlset><url><loc> https://a/1 </loc></url></urlset>") == ["https://a/1"]
    assert sitemaps.locations("<urlset><url>") == [] and sitemaps.locations(None) == []
    sites, fetched = (spark.createDataFrame(list(rows), schema) for rows, schema in ((X.SITES, "site string, root string"), (X.SITEMAPS, "url string, body string")))
    got = {(r.site, r.url) for r in sitemaps.walk(sites, fetched).collect()}
    assert got == {("acme.io", f"https://acme.io/{i}") for i in (1, 2, 3)} | {("other.io", "https://other.io/x")}


def test_streams_agree_with_batches(spark, pages, tmp_path):
    pages.filter("html IS NOT NULL").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = streaming.page_stream(spark, str(tmp_path / "in"))
    query = evidence.page_evidence(stream.drop("seen_at")).selectExpr("page_id", "to_json(e) AS e").writeStream.format("memory").queryName("stream_pages").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = evidence.page_evidence(pages).selectExpr("page_id", "to_json(e) AS e")
    assert sorted(map(tuple, spark.table("stream_pages").collect())) == sorted(map(tuple, batch.collect()))
    assert json.loads(spark.table("stream_pages").first().e)["url"]


def test_streams_drop_known_urls(spark, tmp_path):
    rows = [(1, "https://a.io/x?ref=1", "a"), (2, "https://a.io/x", "b"), (3, "https://a.io/y", "c")]
    spark.createDataFrame(rows, streaming.PAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = streaming.new_urls(streaming.page_stream(spark, str(tmp_path / "in"))).select("url_key").writeStream.format("memory").queryName("stream_urls").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.url_key for r in spark.table("stream_urls").collect()) == ["https://a.io/x", "https://a.io/y"]


def test_nodes(spark, pages):
    tags = [r.tag for r in html.html_nodes(pages.filter("page_id = -3")).orderBy("node").collect()]
    assert tags == ["html", "body", "h1", "section", "div", "h3", "span", "h2"]


def test_deep_markup_and_pruned_digests():
    from webquarry.sources import html as H

    deep = "<form action='/x' id='contact'>" + "<div>" * 3000 + "<input name='a'>" + "</div>" * 3000 + "</form><p>after</p>"
    got = H.digest(deep, "https://acme.io/")
    assert got["forms"][0]["fields"] == ["a"] and got["forms"][0]["markup"].count("<div>") == 3000 and got["paragraphs"] == ["after"]
    assert H.digest(deep, "https://acme.io/", frozenset({"paragraphs", "error"})) == {"paragraphs": ["after"], "error": None}
    assert H.parse("<p a='1'>x<br>y</p>").children[0].markup() == '<p a="1">x<br/>y</p>'


def test_sitemap_chains_of_any_depth(spark):
    from webquarry.sources import sitemaps

    body = lambda child: f"<sitemapindex><sitemap><loc>{child}</loc></sitemap></sitemapindex>"
    rows = [("https://a.io/sitemap.xml", body("https://a.io/0.xml"))] + [(f"https://a.io/{i}.xml", body(f"https://a.io/{i + 1}.xml" if i < 52 else "https://a.io/page")) for i in range(53)]
    got = sitemaps.walk(spark.createDataFrame([("a.io", "https://a.io")], "site string, root string"), spark.createDataFrame(rows, "url string, body string"))
    assert [tuple(r) for r in got.collect()] == [("a.io", "https://a.io/page")]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from webquarry.session import shared_folder

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_literals_of_patterns():
    from webquarry.functions.text import literal_of

    assert literal_of(r"book\s+(an?\s+)?appointment") == ("appointment", False) and literal_of("accordion") == ("accordion", True)
    assert literal_of(r"\$\d+") == ("$", False) and literal_of("a|b") == ("", False) and literal_of(r"we.{0,10}?hiring")[0] == "hiring"
