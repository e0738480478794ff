"""Queries over the engine's main products - page evidence, site views, the merge - with SQL for them.

Crawled pages are compared with SQL over their markup. What they do not show (forms, cards,
structured data, slots that are cleaned against each other) is shown by the literal pages
of ``fixtures.PAGES``; what is expected of these is written down here as plain values. They
were written with the engine's output in view and gone through by the rules, so they guard
against changes rather than prove the rules anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..operators import analyze, business, evidence, merge
from .catalog import (
    _BODY, _EVIDENCE_TYPE, _NAV, _PARAGRAPHS, _SCORED_PAGES, _VALID, _all_pages, _bars, _category, _classify_sql, _decode, _flag, _hits, _host,
)
from .fixtures import literals

def _e(name):
    return F.col("e")[name]


def _b(name):
    return F.col("b")[name]


def _evidence(spark, sf_dir):
    return evidence.page_evidence(_all_pages(spark, sf_dir))


def _business(spark, sf_dir):
    return business.page_business(_all_pages(spark, sf_dir))


def _each(rows, field):
    return rows.select("page_id", F.posexplode(_e(field)).alias("nth", "x")).withColumn("nth", F.col("nth").cast("long"))


def _text(name):
    return F.coalesce(F.col(name), F.lit("")).alias(name.split(".")[-1])


def page_lists(spark, sf_dir):
    return _each(_evidence(spark, sf_dir), "lists").select("page_id", "nth", "x.type", _bars(F.col("x.items")).alias("items"))


def page_tables(spark, sf_dir):
    cells = F.array_join(F.transform("x.rows", _bars), "/")
    return _each(_evidence(spark, sf_dir), "tables").select("page_id", "nth", _bars(F.col("x.headers")).alias("headers"), cells.alias("cells"))


def page_cards(spark, sf_dir):
    fields = ("title", "subtitle", "description", "image_url", "link_url")
    return _each(_evidence(spark, sf_dir), "cards").select("page_id", "nth", *[_text(f"x.{f}") for f in fields])


def page_forms(spark, sf_dir):
    kinds = F.explode(F.create_map(*[x for k in ("contact", "booking", "newsletter") for x in (F.lit(k), _e(f"{k}_forms"))])).alias("kind", "forms")
    rows = _evidence(spark, sf_dir).select("page_id", kinds).select("page_id", "kind", F.posexplode("forms").alias("nth", "x"))
    return rows.select("page_id", "kind", F.col("nth").cast("long").alias("nth"), "x.action", "x.method", _bars(F.col("x.input_names")).alias("inputs"), F.col("x.button_text").alias("button"))


#: Kinds of items with a value, a method and a confidence.
ITEMS = (
    "emails", "phones", "addresses", "opening_hours", "maps_links", "whatsapp_links", "calendar_links", "social_links", "footer_emails", "footer_phones", "footer_social_links",
)


def page_items(spark, sf_dir):
    items = F.explode(F.create_map(*[x for k in ITEMS for x in (F.lit(k), _e(k))])).alias("kind", "items")
    rows = _evidence(spark, sf_dir).select("page_id", items).select("page_id", "kind", F.explode("items").alias("x"))
    return rows.select("page_id", "kind", "x.value", "x.method", "x.confidence", F.col("x.importance").cast("long").alias("importance"))


def page_evidence_counts(spark, sf_dir):
    counted = ("navigation_links", "headings", "paragraphs", "lists", "tables", "cards", "contact_forms", "schema_data", "scripts")
    return _evidence(spark, sf_dir).select(
        "page_id", _e("page_type").alias("page_type"), _e("title").alias("title"), _e("meta_description").alias("meta"), _e("canonical_url").alias("canonical"),
        _e("logo_url").alias("logo"), _e("copyright").alias("copyright"), *[F.size(_e(n)).cast("long").alias(n) for n in counted],
    )


def page_metadata(spark, sf_dir):
    m, c = _b("metadata"), _b("company")
    return _business(spark, sf_dir).select(
        "page_id", *[m[n].alias(n) for n in ("title", "description", "language", "h1", "canonical")], _bars(m["h2s"]).alias("h2s"),
        c["name"].alias("company"), c["tagline"].alias("tagline"), _bars(_b("services")).alias("services"),
    )


def page_people(spark, sf_dir):
    """Team members, scored contacts and form flags."""
    x = F.col("x")
    said = lambda s: F.concat_ws(" ", s["value"], s["source"], F.round(s["confidence"], 2).cast("string"))
    value = lambda a: _bars(F.array_sort(F.transform(a, said)))
    flags = F.array(*[F.when(_b("forms")[n], n) for n in ("contact_form", "booking_form", "newsletter_form", "chat_widget", "live_chat")])
    return _business(spark, sf_dir).select(
        "page_id", value(x["team"]).alias("team"), value(x["addresses"]).alias("addresses"), value(x["phones"]).alias("phones"),
        value(x["emails"]).alias("emails"), _bars(F.filter(flags, lambda f: f.isNotNull())).alias("forms"),
    ).filter("concat(team, addresses, phones, emails, forms) <> ''")


def page_features(spark, sf_dir):
    """All flags of a page, with what its forms, links, scripts and sections add."""
    return _business(spark, sf_dir).select("page_id", *[_b("features")[n].alias(n) for n in FLAGS])


def page_class(spark, sf_dir):
    c = _b("page_classification")
    return _business(spark, sf_dir).select("page_id", c["type"].alias("page_type"), *[F.round(c[n], 6).alias(n) for n in ("confidence", "url_score", "content_score")])


def site_contacts(spark, sf_dir):
    return merge.contacts(merge.ordered(_business(spark, sf_dir))).select("site", "value", "type", "confidence", "source")


def site_technology(spark, sf_dir):
    return merge.technology(merge.ordered(_business(spark, sf_dir))).select("site", "cms", *[_bars(F.col(c)).alias(c) for c in ("analytics", "widgets", "booking")])


def site_quality(spark, sf_dir):
    return merge.quality(merge.ordered(_business(spark, sf_dir))).select("site", "pages", "quality", F.round("page_confidence", 6).alias("page_confidence"))


def site_sources(spark, sf_dir):
    rows = merge.sources(merge.ordered(_business(spark, sf_dir)))
    return rows.select("site", _bars(F.col("pages_crawled")).alias("pages"), F.size("data_sources.emails").cast("long").alias("with_emails"), F.size("data_sources.phones").cast("long").alias("with_phones"))


def site_summary(spark, sf_dir):
    """The merged view, flattened."""
    s, p, c = F.col("summary"), F.col("presence"), F.col("capabilities")
    flags = F.filter(F.array(*[F.when(c["features"][n], n) for n in FLAGS]), lambda x: x.isNotNull())
    links = F.transform(F.array_sort(F.map_entries(p["social_profiles"])), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return merge.merge_sites(_business(spark, sf_dir)).select(
        "site", s["business_name"].alias("name"), s["tagline"].alias("tagline"), s["contact_methods_found"].cast("long").alias("contacts"), s["locations_count"].cast("long").alias("locations"),
        _bars(s["key_features"]).alias("key_features"), s["data_quality_score"].alias("quality"), p["website_url"].alias("website"), _bars(c["services"]).alias("services"),
        _bars(flags).alias("features"), _bars(links).alias("social"),
    )


def site_slots(spark, sf_dir):
    """Slots and profiles of the cleaned site view, flattened."""
    from .. import constants as K

    sites = analyze.analyze_sites(_all_pages(spark, sf_dir))
    slots = F.array(*[F.struct(F.lit(t).alias("slot"), F.col(t).alias("c")) for t in K.SLOTS])
    profiles = F.transform("team_profiles", lambda c: F.struct(F.lit("team_profile").alias("slot"), c.alias("c")))
    rows = sites.select("site", F.explode(F.concat(slots, profiles)).alias("x")).filter("x.c IS NOT NULL").select("site", "x.slot", "x.c")
    of = lambda field, key: _bars(F.transform(F.col("c")[field], lambda x: x[key])).alias(field)
    c = F.col("c")
    return rows.select(
        "site", "slot", c["url"].alias("url"), c["title"].alias("title"), of("headings", "text"), of("paragraphs", "text"), of("cards", "title"), of("emails", "value"),
        of("phones", "value"), of("addresses", "value"), of("opening_hours", "value"), of("schema_data", "schema_type"), _bars(c["navigation_links"]).alias("navigation"),
        F.size(c["lists"]).cast("long").alias("lists"), F.size(c["tables"]).cast("long").alias("tables"), F.size(c["contact_forms"]).cast("long").alias("forms"),
    )


def site_overview(spark, sf_dir):
    sites = analyze.analyze_sites(_all_pages(spark, sf_dir), analyze.Settings(debug=True))
    return sites.select(
        "site", "pages_scanned", "pages_extracted", F.coalesce("footer.text", F.lit("")).alias("footer"), F.coalesce("footer.source", F.lit("")).alias("footer_of"),
        _bars(F.transform(F.coalesce("technology", F.array()), lambda t: t["name"])).alias("technology"), _bars(F.array_sort("crawled_urls")).alias("urls"),
    )


#: The flags of a page.
FLAGS = (
    "has_contact_form", "has_booking", "has_live_chat", "has_pricing", "has_team_page", "has_faq", "has_careers", "has_whatsapp", "has_analytics", "has_crm",
    "has_marketing_pixels", "has_social_links",
)

QUERIES = {
    f.__name__: f
    for f in (
        page_lists, page_tables, page_cards, page_forms, page_items, page_evidence_counts, page_metadata, page_people, page_features, page_class, site_contacts,
        site_technology, site_quality, site_sources, site_summary, site_slots, site_overview,
    )
}

# --- SQL: crawled pages by their markup, literal pages by hand ---------------------------

_TAG = r"<!--.*?-->|<[^>]*>"
_SEEN = r"regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>', '', 'g')"
_STRINGS = f"list_filter(list_transform(string_split_regex({_SEEN}, '(?s){_TAG}'), lambda s: trim({_decode('s')})), lambda s: s <> '')"
_BODY_TEXT = (
    f"list_aggregate(list_transform(string_split_regex(regexp_replace(regexp_extract({_SEEN}, '(?s)<body>(.*)</body>', 1), '(?s)<nav>.*?</nav>', ''), '(?s){_TAG}'), "
    f"lambda s: trim({_decode('s')})), 'string_agg', '')"
)
_TITLE = f"trim({_decode('regexp_extract(html, $$<title>([^<]*)$$, 1)')})"
_H1 = f"trim({_decode('regexp_extract(html, $$<h1>([^<]*)$$, 1)')})"
_HEADING = f"CASE WHEN length({_H1}) > 2 AND NOT regexp_matches(lower({_H1}), 'menu|cookie|subscribe') THEN 1 ELSE 0 END::BIGINT"
_LANG = """regexp_extract(html, '<html lang="([^"]*)"', 1)"""
_MAILS = rf"""SELECT page_id, url, email FROM (
  SELECT DISTINCT page_id, url, lower(unnest(regexp_extract_all(html, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}'))) AS email FROM pages) WHERE {_VALID}"""
_RAW_PHONE = r"(?:^|[^0-9A-Za-z+])(\+[1-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9](?:[ .\-]?[0-9]){5,12}|(?:1[ .\-])?\(?[2-9][0-9]{2}\)?[ .\-]?[2-9][0-9]{2}[ .\-]?[0-9]{4})(?:[^0-9]|$)"
_DIALLED = """CASE WHEN starts_with(trim(raw), '+') AND length(digits) BETWEEN 7 AND 15 THEN '+' || digits WHEN starts_with(trim(raw), '+') THEN NULL
  WHEN length(digits) = 10 THEN '+1' || digits WHEN length(digits) = 11 AND starts_with(digits, '1') THEN '+' || digits END"""
_PHONES = rf"""SELECT DISTINCT page_id, url, phone FROM (
    SELECT page_id, url, {_DIALLED} AS phone FROM (
      SELECT page_id, url, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM (
        SELECT page_id, url, unnest(regexp_extract_all(list_aggregate({_STRINGS}, 'string_agg', ' '), '{_RAW_PHONE}', 1)) AS raw FROM pages)))
  WHERE regexp_matches(phone, '^(\+1[2-9][0-9]{{2}}[2-9][0-9]{{6}}|\+[2-9][0-9]{{6,14}})$')"""
_MARKUP_PHONES = rf"""SELECT page_id, phone || CASE WHEN bool_or(in_footer AND n = first) THEN ' footer 0.8' ELSE ' regex 0.6' END AS said FROM (
    SELECT *, min(n) OVER (PARTITION BY page_id, phone) AS first FROM (
      SELECT page_id, n, in_footer, {_DIALLED} AS phone FROM (
        SELECT page_id, generate_subscripts(raws, 1) AS n, unnest(raws) AS raw, contains(footer, unnest(raws)) AS in_footer, regexp_replace(unnest(raws), '[^0-9]', '', 'g') AS digits FROM (
          SELECT page_id, {_decode("regexp_extract(html, '<footer>([^<]*)', 1)")} AS footer, list_concat(list_concat(
            regexp_extract_all(html, '\+?1?\s*\(?[0-9]{{3}}\)?[-.\s]?[0-9]{{3}}[-.\s]?[0-9]{{4}}'), regexp_extract_all(html, '\+[1-9][0-9]{{1,14}}')),
            regexp_extract_all(html, '(?i)(?:phone|tel|contact):\s*([+\d\s\-()]+)', 1)) AS raws FROM pages))) WHERE phone IS NOT NULL)
  GROUP BY page_id, phone"""
_KNOWN_MAILS = f"SELECT * FROM ({_MAILS}) WHERE {_category('email')} IN ('business', 'support', 'sales', 'marketing')"
_PER_PAGE = f"""
  named AS (
    SELECT page_id AS rid, page_id, url, {_host('url')} AS site, html, {_TITLE} AS title, {_H1} AS h1, '' AS meta_description, substr(lower({_BODY_TEXT}), 1, 1000) AS body_text FROM pages),
  cut AS (SELECT *, CASE WHEN contains(title, '|') THEN trim(split_part(title, '|', 1)) WHEN contains(title, '–') THEN trim(split_part(title, '–', 1))
    WHEN contains(title, '—') THEN trim(split_part(title, '—', 1)) WHEN contains(title, '-') THEN trim(split_part(title, '-', 1)) ELSE title END AS company FROM named)"""
_CLASSES = _classify_sql("SELECT rid, url, title, h1, meta_description, body_text FROM cut", _PER_PAGE.strip() + ",")
_ORDER = "(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') <> ''), score DESC, url, page_id"
_MARKUP_FLAGS = {n: "false" if n == "has_social_links" else f"({_flag(n)})" for n in FLAGS}
_QUALITY = f"""
  classes AS ({_CLASSES}),
  mails AS (SELECT DISTINCT page_id FROM ({_KNOWN_MAILS})),
  phones AS (SELECT DISTINCT page_id FROM ({_PHONES})),
  facts AS (SELECT {_host('p.url')} AS site, m.page_id IS NOT NULL AS mail, f.page_id IS NOT NULL AS phone, cut.company <> '' AS named, {_hits('cms').replace('lower(html)', 'lower(p.html)')} AS cms, c.confidence
    FROM pages p JOIN classes c ON c.rid = p.page_id JOIN cut ON cut.rid = p.page_id LEFT JOIN mails m ON m.page_id = p.page_id LEFT JOIN phones f ON f.page_id = p.page_id),
  quality AS (SELECT site, count(*) AS pages,
      round(least(0.99, (bool_or(mail)::INT + bool_or(phone)::INT + bool_or(named)::INT + bool_or(len(list_filter(cms, lambda x: x IS NOT NULL)) > 0)::INT) / 4.0::DOUBLE * 0.5
        + coalesce(avg(confidence) FILTER (WHERE confidence <> 0), 0.5) * 0.5), 2) AS quality,
      round(avg(confidence), 6) AS page_confidence FROM facts GROUP BY site)"""
_ACME, _TOOLS = "https://www.acme.io", "Acme has made tools for people who build things since nineteen ninety, in a small town by the sea."
_HALL = "In two thousand and four we moved into the old harbour hall, where all our tools are made to this day."

ORACLE_SQL = {
    "page_lists": f"""
      WITH n AS (SELECT page_id, regexp_replace({_BODY}, '(?s)<nav>.*?</nav>', '', 'g') AS b FROM pages),
      l AS (SELECT page_id, regexp_extract_all(b, '(?s)<(ul|ol)>(.*?)</(?:ul|ol)>', 1) AS t, regexp_extract_all(b, '(?s)<(ul|ol)>(.*?)</(?:ul|ol)>', 2) AS i FROM n)
      SELECT page_id, generate_subscripts(t, 1) - 1 AS nth, unnest(t) AS type, list_aggregate(regexp_extract_all(unnest(i), '<li>([^<]*)', 1), 'string_agg', '|') AS items FROM l
      UNION ALL {literals([(-4, 0, 'ul', 'Tiles|Gutters and drains'), (-4, 1, 'ol', 'Call|Pay')])}""",
    "page_tables": f"""
      SELECT page_id, 0::BIGINT AS nth, '' AS headers, '' AS cells FROM pages WHERE contains(html, '<table')
      UNION ALL {literals([(-4, 0, 'Job|Price', 'Job|Price/Roof|$90')])}""",
    "page_cards": f"""
      SELECT page_id, 0::BIGINT AS nth, '' AS title, '' AS subtitle, '' AS description, '' AS image_url, '' AS link_url FROM pages
      WHERE regexp_matches(html, '<div class="[^"]*(card|feature|service|team|box)')
      UNION ALL {literals([
          (-1, 0, 'Hammers', '', 'All kinds of hammers.', '', _ACME + '/hammers'), (-5, 0, 'Hammers', '', 'All kinds of hammers.', '', _ACME + '/hammers'),
          (-5, 1, 'Saws', '', 'Sharp ones.', '', ''),
      ])}""",
    "page_forms": f"""
      SELECT page_id, 'contact' AS kind, 0::BIGINT AS nth, '' AS action, '' AS method, '' AS inputs, '' AS button FROM pages WHERE contains(html, '<form')
      UNION ALL {literals([(-2, k, 0, _ACME + '/send', 'POST', 'email|message', 'Send') for k in ('contact', 'newsletter')])}""",
    "page_items": f"""
      WITH h AS (SELECT page_id, unnest(list_filter({_STRINGS}, lambda s: length(s) < 200 AND regexp_matches(lower(s), 'hours|open|close|monday|am|pm'))[1:5]) AS value FROM pages)
      SELECT page_id, 'opening_hours' AS kind, value, 'visible' AS method, 0.7::DOUBLE AS confidence, 5::BIGINT AS importance FROM h
      UNION ALL SELECT m.page_id, 'emails', email, 'regex', 0.7, 10 FROM ({_MAILS}) m
      UNION ALL SELECT f.page_id, 'phones', phone, 'regex', 0.75, 10 FROM ({_PHONES}) f
      UNION ALL {literals([
          (-1, 'emails', 'info@acme.io', 'mailto', 0.99, 10), (-1, 'emails', 'office@acme.io', 'mailto', 0.99, 10), (-1, 'phones', '+15552345678', 'tel', 0.99, 10),
          (-1, 'opening_hours', 'Hammers', 'visible', 0.7, 5), (-1, 'opening_hours', 'All kinds of hammers.', 'visible', 0.7, 5),
          (-1, 'social_links', 'https://facebook.com/acme', 'facebook', 0.95, 5), (-1, 'footer_emails', 'office@acme.io', 'footer_mailto', 0.99, 5),
          (-2, 'emails', 'support@acme.io', 'mailto', 0.99, 10), (-2, 'phones', '+15552345678', 'tel', 0.99, 10), (-2, 'addresses', '1 Main St, Salem, OR 97301', 'address_tag', 0.9, 5),
          (-2, 'opening_hours', 'Monday 09:00 to 17:00', 'visible', 0.7, 5), (-2, 'maps_links', 'https://maps.google.com/?q=acme', 'link', 0.99, 5),
          (-5, 'emails', 'info@acme.io', 'mailto', 0.99, 10), (-5, 'emails', 'jobs@acme.io', 'mailto', 0.99, 10),
          (-5, 'opening_hours', 'Hammers', 'visible', 0.7, 5), (-5, 'opening_hours', 'All kinds of hammers.', 'visible', 0.7, 5),
      ])}""",
    "page_evidence_counts": f"""
      WITH {_PARAGRAPHS}, per AS (SELECT page_id, count(*) AS n FROM paragraphs GROUP BY page_id),
      nav AS (SELECT page_id, len(list_distinct(list_filter({_NAV}, lambda h: h <> '' AND NOT starts_with(h, '#'))))::BIGINT AS n FROM pages)
      SELECT p.page_id, {_EVIDENCE_TYPE} AS page_type, {_H1} AS title, '' AS meta, '' AS canonical, '' AS logo,
        CASE WHEN contains({_decode("regexp_extract(html, '<footer>([^<]*)', 1)")}, '©') THEN trim({_decode("regexp_extract(html, '<footer>([^<]*)', 1)")}) ELSE '' END AS copyright,
        least(nav.n, 20) AS navigation_links, {_HEADING} AS headings, coalesce(per.n, 0) AS paragraphs, 0::BIGINT AS lists, 0::BIGINT AS tables, 0::BIGINT AS cards,
        0::BIGINT AS contact_forms, 0::BIGINT AS schema_data, 0::BIGINT AS scripts FROM pages p LEFT JOIN per USING (page_id) LEFT JOIN nav USING (page_id)
      UNION ALL {literals([
          (-1, 'homepage', 'Welcome to Acme', 'We make tools.', 'https://acme.io/', _ACME + '/logo.png', '© Acme 2024', 2, 2, 1, 0, 0, 1, 0, 1, 0),
          (-2, 'contact', 'Contact Acme', '', '', '', '', 0, 1, 1, 0, 0, 0, 1, 0, 0), (-3, 'team_profile', 'Jane Doe', '', '', '', '', 0, 3, 0, 0, 0, 0, 0, 0, 0),
          (-4, 'services', 'Beta - Services', '', '', '', '', 0, 1, 0, 2, 1, 0, 0, 0, 1), (-5, 'about', 'About Acme', '', '', '', '', 0, 5, 2, 0, 0, 2, 0, 0, 0),
      ])}""",
    "page_metadata": f"""
      WITH {_PER_PAGE} SELECT page_id, title, '' AS description, {_LANG} AS language, h1, '' AS canonical, '' AS h2s, company, '' AS tagline, '' AS services FROM cut
      UNION ALL {literals([
          (-1, 'Acme | Tools', 'We make tools.', 'en', 'Welcome to Acme', 'https://acme.io/', '', 'Acme Inc', 'We make tools.', 'Hammers'),
          (-2, 'Contact', '', '', 'Contact Acme', '', '', 'Contact', '', ''), (-3, '', '', '', 'Jane Doe', '', 'About Jane', '', '', 'Jane Doe|About Jane'),
          (-4, 'Beta - Services', '', '', '', '', 'Roof repair', 'Beta', '', 'Roof repair|Tiles|Gutters and drains'),
          (-5, 'About', '', '', 'About Acme', '', 'Welcome to Acme|Our story', 'About', '', 'Welcome to Acme|Our story|Hammers|Saws'),
      ])}""",
    "page_people": f"""
      SELECT page_id, '' AS team, '' AS addresses, coalesce(p.said, '') AS phones, coalesce(m.said, '') AS emails, '' AS forms
      FROM (SELECT page_id, string_agg(said, '|' ORDER BY said) AS said FROM ({_MARKUP_PHONES}) GROUP BY page_id) p
      FULL JOIN (SELECT page_id, string_agg(email || ' regex 0.55', '|' ORDER BY email) AS said FROM ({_MAILS}) GROUP BY page_id) m USING (page_id)
      UNION ALL {literals([
          (-1, '', '', '+15552345678 tel 0.99', 'info@acme.io schema 0.99|office@acme.io mailto 0.99', ''),
          (-2, '', '1 Main St, Salem, OR 97301 visible 0.8', '+15552345678 tel 0.99', 'support@acme.io mailto 0.99', 'contact_form'),
          (-3, 'Jane Doe - Founder visible 0.8', '', '', '', ''), (-5, '', '', '', 'info@acme.io mailto 0.99|jobs@acme.io mailto 0.99', ''),
      ])}""",
    "page_features": f"""
      SELECT page_id, {', '.join(f'{c} AS {n}' for n, c in _MARKUP_FLAGS.items())} FROM pages
      UNION ALL {literals([
          (-1, *[n == 'has_social_links' for n in FLAGS]), (-2, *[n == 'has_contact_form' for n in FLAGS]), (-3, *[False] * 12), (-4, *[n == 'has_pricing' for n in FLAGS]), (-5, *[n == 'has_careers' for n in FLAGS]),
      ])}""",
    "page_class": f"""
      SELECT rid AS page_id, page_type, confidence, url_score, content_score FROM ({_CLASSES})
      UNION ALL {literals([
          (-1, 'homepage', 0.4, 0.8, 0.0), (-2, 'contact', 0.486111, 0.75, 0.222222), (-3, 'team', 0.375, 0.75, 0.0), (-4, 'services', 0.701087, 0.75, 0.652174), (-5, 'about', 0.486111, 0.75, 0.222222),
      ])}""",
    "site_contacts": f"""
      SELECT DISTINCT {_host('url')} AS site, email AS value, 'email' AS type, 0.85::DOUBLE AS confidence, 'visible' AS source FROM ({_KNOWN_MAILS})
      UNION ALL SELECT DISTINCT {_host('url')}, phone, 'phone', 0.85, 'visible' FROM ({_PHONES})
      UNION ALL {literals([
          ('acme.io', 'info@acme.io', 'email', 0.99, 'schema'), ('acme.io', 'support@acme.io', 'email', 0.85, 'visible'), ('acme.io', '+15552345678', 'phone', 0.93, 'schema'),
      ])}""",
    "site_technology": f"""
      WITH t AS (SELECT {_host('url')} AS site, {_hits('cms')} AS cms, {', '.join(f'{_hits(c)} AS {c}' for c in ('analytics', 'widgets', 'booking'))} FROM pages)
      SELECT site, coalesce(max(list_filter(cms, lambda x: x IS NOT NULL)[1]), '') AS cms, {', '.join(
          f"coalesce(list_aggregate(list_sort(list_distinct(flatten(list({c})))), 'string_agg', '|'), '') AS {c}" for c in ('analytics', 'widgets', 'booking'))} FROM t GROUP BY site
      UNION ALL {literals([('acme.io', '', '', '', ''), ('beta.io', 'Shopify', '', '', '')])}""",
    "site_quality": f"WITH {_PER_PAGE}, {_QUALITY.strip()} SELECT site, pages, quality, page_confidence FROM quality UNION ALL "
    + literals([("acme.io", 4, 0.59, 0.436806), ("beta.io", 1, 0.6, 0.701087)]),
    "site_sources": f"""
      WITH {_SCORED_PAGES}, m AS (SELECT DISTINCT page_id FROM ({_KNOWN_MAILS})), f AS (SELECT DISTINCT page_id FROM ({_PHONES})),
      o AS (SELECT p.*, {_host('p.url')} AS site, s.score, m.page_id IS NOT NULL AS mail, f.page_id IS NOT NULL AS phone
        FROM pages p JOIN scored s ON s.rid = p.page_id LEFT JOIN m ON m.page_id = p.page_id LEFT JOIN f ON f.page_id = p.page_id)
      SELECT site, string_agg(url, '|' ORDER BY {_ORDER}) AS pages, sum(mail::INT)::BIGINT AS with_emails, sum(phone::INT)::BIGINT AS with_phones FROM o GROUP BY site
      UNION ALL {literals([('acme.io', '|'.join(_ACME + p for p in ('/', '/contact', '/about', '/team/jane-doe')), 3, 2), ('beta.io', 'https://beta.io/services', 0, 0)])}""",
    "site_summary": f"""
      WITH {_PER_PAGE}, {_QUALITY.strip()},
      scores AS (WITH {_SCORED_PAGES} SELECT * FROM scored),
      ordered AS (SELECT cut.*, s.score, row_number() OVER (PARTITION BY site ORDER BY {_ORDER}) AS n FROM cut JOIN scores s USING (rid)),
      methods AS (SELECT {_host('url')} AS site, count(DISTINCT value) AS n FROM (SELECT url, email AS value FROM ({_KNOWN_MAILS}) UNION ALL SELECT url, phone FROM ({_PHONES})) GROUP BY 1),
      flags AS (SELECT {_host('url')} AS site, {', '.join(f'bool_or({c}) AS {n}' for n, c in _MARKUP_FLAGS.items())} FROM pages GROUP BY 1),
      first AS (SELECT site, arg_min(company, n) FILTER (WHERE company <> '') AS company FROM ordered GROUP BY site)
      SELECT site, coalesce(first.company, site) AS name, '' AS tagline, coalesce(methods.n, 0) AS contacts, 1::BIGINT AS locations,
        concat_ws('|', CASE WHEN has_live_chat THEN 'Live Chat Support' END, CASE WHEN has_booking THEN 'Booking System' END, CASE WHEN has_contact_form THEN 'Contact Form' END,
          CASE WHEN has_pricing THEN 'Pricing Information' END, CASE WHEN has_team_page THEN 'Team/Staff Directory' END) AS key_features, quality, 'https://' || site AS website, '' AS services,
        concat_ws('|', {', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in FLAGS)}) AS features, '' AS social
      FROM first JOIN quality USING (site) JOIN flags USING (site) LEFT JOIN methods USING (site)
      UNION ALL {literals([
          ('acme.io', 'Acme Corporation', 'We make tools.', 3, 1, 'Contact Form|Hammers', 0.59, 'https://acme.io', 'Hammers|Welcome to Acme|Our story|Saws|Jane Doe|About Jane',
           'has_contact_form|has_careers|has_social_links', 'facebook=https://facebook.com/acme'),
          ('beta.io', 'Beta', '', 0, 1, 'Pricing Information|Roof repair', 0.6, 'https://beta.io', 'Roof repair|Tiles|Gutters and drains', 'has_pricing', ''),
      ])}""",
    "site_slots": f"""
      SELECT {_host('url')} AS site, {_EVIDENCE_TYPE} AS slot, url, '' AS title, '' AS headings, '' AS paragraphs, '' AS cards, '' AS emails, '' AS phones, '' AS addresses,
        '' AS opening_hours, '' AS schema_data, '' AS navigation, 0::BIGINT AS lists, 0::BIGINT AS tables, 0::BIGINT AS forms FROM pages WHERE {_EVIDENCE_TYPE} <> 'unknown'
      UNION ALL {literals([
          ('acme.io', 'homepage', _ACME + '/', 'Welcome to Acme', 'Welcome to Acme|Hammers', _TOOLS, 'Hammers', 'info@acme.io|office@acme.io', '+15552345678', '', '', 'organization',
           _ACME + '/about|' + _ACME + '/contact', 0, 0, 0),
          ('acme.io', 'about', _ACME + '/about', 'About Acme', 'About Acme|Our story|Saws', _HALL, 'Saws', 'jobs@acme.io', '', '', '', '', '', 0, 0, 0),
          ('acme.io', 'contact', _ACME + '/contact', 'Contact Acme', 'Contact Acme', '', '', 'support@acme.io', '', '1 Main St, Salem, OR 97301', 'Monday 09:00 to 17:00', '', '', 0, 0, 1),
          ('acme.io', 'team_profile', _ACME + '/team/jane-doe', 'Jane Doe', 'Jane Doe|About Jane', '', '', '', '', '', '', '', '', 0, 0, 0),
          ('beta.io', 'services', 'https://beta.io/services', 'Beta - Services', 'Roof repair', '', '', '', '', '', '', '', '', 2, 1, 0),
      ])}""",
    "site_overview": f"""
      WITH t AS (SELECT {_host('url')} AS site, {_EVIDENCE_TYPE} AS page_type, url FROM pages)
      SELECT site, count(*) AS pages_scanned, count(DISTINCT page_type) FILTER (WHERE page_type NOT IN ('unknown', 'team_profile')) + count(*) FILTER (WHERE page_type IN ('unknown', 'team_profile')) AS pages_extracted,
        '' AS footer, '' AS footer_of, '' AS technology, string_agg(url, '|' ORDER BY url) AS urls FROM t GROUP BY site
      UNION ALL {literals([
          ('acme.io', 4, 4, '© Acme 2024Office', _ACME + '/', '', '|'.join(_ACME + p for p in ('/', '/about', '/contact', '/team/jane-doe'))),
          ('beta.io', 1, 1, '', '', 'Shopify', 'https://beta.io/services'),
      ])}""",
}
