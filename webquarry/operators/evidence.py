"""Evidence of a page: what its digest and its markup say, every item with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import contacts, emails, jsonld, technology
from ..functions.ranking import evidence_page_type
from ..functions.text import distinct_first, has_any, strings, strip
from ..functions.urls import domain_name, lstripped_www, part
from ..sources.html import with_digest


def item(value: Column, source: Column, method: str | Column, confidence: float | Column, importance: int = 5) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        value.alias("value"), source.alias("source"), lit(method).alias("method"), lit(confidence).cast("double").alias("confidence"),
        F.lit(importance).alias("importance"),
    )


def importance_of(kind: Column) -> Column:
    """Importance by kind of content: contacts 10, scripts 7, others 5."""
    c = F.when(F.lit(False), 0)
    for name, value in K.IMPORTANCE.items():
        c = c.when(kind == name, value)
    return c.otherwise(K.IMPORTANCE["other"])


def title(d: Column) -> Column:
    """First h1, empty or not, else the title."""
    return F.coalesce(d["h1"], d["title"], F.lit(""))


def meta(d: Column, name: str) -> Column:
    """By name, then by property; a name without content does not fall through."""
    return F.coalesce(d["meta_name"][name], d["meta_property"][name], F.lit(""))


def navigation(d: Column) -> Column:
    """The first navigation's links but fragments, distinct, in order, 20 at most."""
    mine = F.filter(d["links"], lambda x: x["in_nav"] & (x["href"] != "") & ~x["href"].startswith("#"))
    return F.slice(F.array_distinct(F.transform(mine, lambda x: x["resolved"])), 1, 20)


def internal_links(d: Column, url: Column) -> Column:
    """Sorted distinct links to the page's own site, without query and fragment, but the page itself."""
    mine = F.filter(d["links"], lambda x: ~strip(x["href"]).rlike("^(mailto:|tel:|javascript:|#)"))
    full = F.transform(mine, lambda x: x["resolved"])
    own = lstripped_www(domain_name(url))
    kept = F.filter(full, lambda u: F.lower(part(u, 1)).isin("http", "https") & (lstripped_www(domain_name(u)) == own))
    clean = F.transform(kept, lambda u: F.regexp_replace(F.regexp_replace(u, r"(?s)[?#].*$", ""), "/+$", ""))
    return F.array_sort(F.filter(F.array_distinct(clean), lambda u: u != F.regexp_replace(url, "/+$", "")))


def headings(d: Column) -> Column:
    return F.filter(d["headings"], lambda h: (F.length(h["text"]) > 2) & ~has_any(F.lower(h["text"]), K.HEADING_BOILERPLATE))


def is_paragraph(p: Column) -> Column:
    return F.length(p).between(50, 800) & ~has_any(F.lower(p), K.PARAGRAPH_BOILERPLATE)


def paragraphs(d: Column) -> Column:
    return F.array_distinct(F.filter(d["paragraphs"], is_paragraph))


def lists(d: Column) -> Column:
    return F.slice(F.filter(d["lists"], lambda x: F.size(x["items"]) > 0), 1, 10)


def tables(d: Column) -> Column:
    return F.slice(F.filter(d["tables"], lambda t: (F.size(t["headers"]) > 0) | (F.size(t["rows"]) > 0)), 1, 5)


def cards(d: Column) -> Column:
    return F.slice(d["cards"], 1, 20)


def email_items(html: Column, d: Column, url: Column) -> Column:
    """All addresses with the method that the page, not the address, suggests."""
    mail, data = F.lower(html).contains("mailto:"), has_any(html, ("schema", "json-ld"))
    method = F.when(mail, "mailto").when(data, "schema").otherwise("regex")
    sure = F.when(mail, 0.99).when(data, 0.95).otherwise(0.70)
    return F.transform(emails.extract_emails(html, d["links"]), lambda e: item(e, url, method, sure, K.IMPORTANCE["email"]))


def phone_items(html: Column, d: Column, url: Column) -> Column:
    tel, data = F.lower(html).contains("tel:"), F.lower(html).contains("schema")
    method = F.when(tel, "tel").when(data, "schema").otherwise("regex")
    sure = F.when(tel, 0.99).when(data, 0.95).otherwise(0.75)
    return F.transform(contacts.extract_phones(d["links"], d["text"]), lambda p: item(p, url, method, sure, K.IMPORTANCE["phone"]))


def address_items(d: Column, url: Column) -> Column:
    return F.transform(F.filter(d["addresses"], lambda a: a != ""), lambda a: item(a, url, "address_tag", 0.90))


def opening_hours(d: Column, url: Column) -> Column:
    mine = F.filter(d["strings"], lambda s: (F.length(s) < 200) & has_any(F.lower(s), K.HOURS_WORDS))
    return F.transform(F.slice(mine, 1, 5), lambda s: item(s, url, "visible", 0.70))


def link_items(d: Column, url: Column, marks, method: str, sure: float) -> Column:
    """Links that hold one of ``marks``; repeats stay."""
    return F.transform(F.filter(d["links"], lambda x: has_any(x["href"], marks)), lambda x: item(x["href"], url, method, sure))


def forms(d: Column, kind: str, url: Column) -> Column:
    mine = F.filter(d["forms"], lambda f: has_any(f["markup"], K.FORM_MARKS[kind]))
    return F.transform(
        mine,
        lambda f: F.struct(f["action"].alias("action"), f["method"].alias("method"), f["fields"].alias("input_names"), f["button"].alias("button_text"), url.alias("source")),
    )


def social_items(d: Column, url: Column) -> Column:
    return F.transform(F.map_entries(contacts.social_links(d["links"])), lambda e: item(e["value"], url, e["key"], 0.95))


def schema_items(d: Column, url: Column, compat: bool = False) -> Column:
    """Entities of structured data by their type, in lower case. ``compat`` names each type "unknown", as an older reader of them did."""
    kind = lambda e: F.lit("unknown") if compat else F.lower(e["schema_type"])
    return F.transform(jsonld.entities(d["jsonld"]), lambda e: F.struct(kind(e).alias("schema_type"), e.alias("data"), url.alias("source")))


def script_items(html: Column, url: Column) -> Column:
    return F.transform(
        technology.technology_items(technology.technology(html)),
        lambda t: F.struct(t["name"].alias("name"), t["category"].alias("category"), F.lit(0.85).alias("confidence"), F.lit(K.IMPORTANCE["script"]).alias("importance"), url.alias("source")),
    )


def footer_links(d: Column, url: Column, mark: str, method: str) -> Column:
    """Footer links with a scheme such as ``mailto:``, without it."""
    mine = F.filter(d["links"], lambda x: x["in_footer"] & x["href"].contains(mark))
    return F.transform(mine, lambda x: item(F.replace(x["href"], F.lit(mark), F.lit("")), url, method, 0.99))


def footer_social(d: Column, url: Column) -> Column:
    mine = F.filter(d["links"], lambda x: x["in_footer"] & has_any(x["href"], K.FOOTER_SOCIAL_MARKS))
    return F.transform(mine, lambda x: item(x["href"], url, "footer_link", 0.95))


def copyright_notice(d: Column) -> Column:
    mine = F.filter(d["footer_strings"], lambda s: s.contains("©") | F.lower(s).contains("copyright"))
    return F.coalesce(F.get(mine, F.lit(0)), F.lit(""))


def _sourced(a: Column, url: Column, fields: tuple[str, ...]) -> Column:
    return F.transform(a, lambda x: F.struct(*[x[f].alias(f) for f in fields], url.alias("source")))


#: What of a digest evidence reads.
DIGEST = (
    "title", "h1", "canonical", "meta_name", "meta_property", "logo_url", "links", "headings", "paragraphs", "lists", "tables", "cards", "forms", "jsonld", "strings", "text",
    "raw_text", "footer_text", "footer_strings", "addresses",
)


def page_evidence(pages: DataFrame, compat: bool = False) -> DataFrame:
    """One row for each page that has markup: its key columns and the evidence struct ``e``.

    ``pages`` has url and html; all columns but html pass through. A page whose markup cannot
    be read has ``e.error``.
    """
    html, url, d = F.col("html"), F.col("url"), F.col("d")
    parsed = with_digest(pages.filter("html IS NOT NULL AND html <> ''"), fields=DIGEST)
    e = F.struct(
        url.alias("url"), evidence_page_type(url, d["raw_text"]).alias("page_type"), title(d).alias("title"), meta(d, "title").alias("meta_title"),
        F.coalesce(d["title"], F.lit("")).alias("title_tag"), meta(d, "description").alias("meta_description"),
        meta(d, "og:title").alias("meta_og_title"), meta(d, "og:description").alias("meta_og_description"), meta(d, "og:image").alias("meta_og_image"),
        d["canonical"].alias("canonical_url"), d["logo_url"].alias("logo_url"), navigation(d).alias("navigation_links"),
        _sourced(headings(d), url, ("level", "text")).alias("headings"),
        F.transform(paragraphs(d), lambda p: F.struct(p.alias("text"), url.alias("source"))).alias("paragraphs"),
        _sourced(lists(d), url, ("type", "items")).alias("lists"), _sourced(tables(d), url, ("headers", "rows")).alias("tables"),
        _sourced(cards(d), url, ("title", "subtitle", "description", "image_url", "link_url")).alias("cards"),
        email_items(html, d, url).alias("emails"), phone_items(html, d, url).alias("phones"), address_items(d, url).alias("addresses"),
        opening_hours(d, url).alias("opening_hours"), link_items(d, url, K.MAPS_MARKS, "link", 0.99).alias("maps_links"),
        *[forms(d, k, url).alias(f"{k}_forms") for k in K.FORM_MARKS],
        social_items(d, url).alias("social_links"), link_items(d, url, K.WHATSAPP_MARKS, "link", 0.99).alias("whatsapp_links"),
        link_items(d, url, K.CALENDAR_MARKS, "link", 0.99).alias("calendar_links"), schema_items(d, url, compat).alias("schema_data"),
        script_items(html, url).alias("scripts"), footer_links(d, url, "mailto:", "footer_mailto").alias("footer_emails"),
        footer_links(d, url, "tel:", "footer_tel").alias("footer_phones"), F.array().cast("array<string>").alias("footer_addresses"),
        footer_social(d, url).alias("footer_social_links"), F.substring(d["footer_text"], 1, 500).alias("footer_text"),
        copyright_notice(d).alias("copyright"), F.array().cast("array<string>").alias("registration_numbers"), d["error"].alias("error"),
    )
    return parsed.select(*[F.col(f"`{c}`") for c in pages.columns if c != "html"], e.alias("e"))
