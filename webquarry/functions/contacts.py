"""Phones, addresses and social profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ADDRESS_PATTERN, PHONE_PATTERNS, SOCIAL_DOMAINS, SOCIAL_PATTERNS, US_STATES
from .confidence import score_email, score_phone, score_text, score_url
from .emails import looks_like_email
from .text import distinct_first, let, matches, strip
from .urls import domain_name, lstripped_www

# --- phones -----------------------------------------------------------------


def to_e164(phone: Column) -> Column:
    """E.164 of a number as it is dialled in the US: 10 digits, 1 and 10 digits, or + and 7 to 15 digits; else null (documented subset)."""
    low = F.regexp_replace(phone, r"(?i)(ext\.?|x)\s*\d+\s*$", "")
    parts = F.struct(strip(low).startswith("+").alias("plus"), F.regexp_replace(low, "[^0-9]", "").alias("digits"))
    return let(parts, lambda p: _dialled(p["plus"], p["digits"]))


def _dialled(plus: Column, digits: Column) -> Column:
    n = F.length(digits)
    return (
        F.when(plus & n.between(7, 15), F.concat(F.lit("+"), digits))
        .when(~plus & (n == 10), F.concat(F.lit("+1"), digits))
        .when(~plus & (n == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
    )


def is_valid_phone(e164: Column) -> Column:
    """North American numbers by their plan (area and exchange begin with 2 to 9), others by length."""
    us = e164.startswith("+1")
    return F.when(us, e164.rlike(r"^\+1[2-9]\d{2}[2-9]\d{6}$")).otherwise(e164.rlike(r"^\+[2-9]\d{6,14}$"))


def normalise_phone(phone: Column) -> Column:
    """E.164 of a valid number, else null."""
    return let(to_e164(phone), lambda p: F.when(is_valid_phone(p), p))


#: Numbers in running text: North American with +1, as their length is known and what follows may be digits too; other international with +; North American
#: with or without 1, but no ten digits that letters continue (they are part of a token), except for an extension.
TEXT_PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+1[ .\-]?\(?[2-9][0-9]{2}\)?[ .\-]?[2-9][0-9]{2}[ .\-]?[0-9]{4}"
    r"|\+[1-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9](?:[ .\-]?[0-9]){5,12}"
    r"|(?:1[ .\-])?(?![0-9]{10}(?!(?i:ext|x)\.? ?[0-9])\p{IsLatin})\(?[2-9][0-9]{2}\)?[ .\-]?[2-9][0-9]{2}[ .\-]?[0-9]{4})(?![0-9])"
)
#: The same in the text of pages, as the SQL of page items and site views fixes it: digits that follow belong to a number with +, tokens may begin with a number.
PAGE_PHONE = r"(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9](?:[ .\-]?[0-9]){5,12}|(?:1[ .\-])?\(?[2-9][0-9]{2}\)?[ .\-]?[2-9][0-9]{2}[ .\-]?[0-9]{4})(?![0-9])"


def phones_in(text: Column, pattern: str = TEXT_PHONE) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), normalise_phone)
    return F.filter(found, lambda p: p.isNotNull())


def tel_numbers(links: Column) -> Column:
    mine = F.filter(links, lambda x: F.lower(x["href"]).startswith("tel:"))
    return F.filter(F.transform(mine, lambda x: normalise_phone(F.substr(x["href"], F.lit(5)))), lambda p: p.isNotNull())


def extract_phones(links: Column, text: Column) -> Column:
    """Sorted, distinct valid numbers of ``tel:`` links and of the visible text."""
    return F.array_sort(F.array_distinct(F.concat(tel_numbers(links), phones_in(text, PAGE_PHONE))))


def _first_per_value(scores: Column) -> Column:
    return distinct_first(F.filter(scores, lambda s: s["value"].isNotNull()), lambda s: s["value"])


def scored_phones(links: Column, telephones: Column, html: Column, footer_raw: Column) -> Column:
    """Scores of ``tel:`` links, structured data and three patterns over the markup; the first of each number. Whole matches count."""
    tel = F.transform(
        F.filter(links, lambda x: x["href"].startswith("tel:")),
        lambda x: let(to_e164(strip(F.replace(x["href"], F.lit("tel:"), F.lit("")))), lambda p: score_phone(p, "tel", True)),
    )
    data = F.transform(F.coalesce(telephones, F.array().cast("array<string>")), lambda t: let(to_e164(t), lambda p: score_phone(p, "schema", True)))
    found = F.concat(*[F.regexp_extract_all(html, F.lit(f"(?i){p}"), F.lit(1 if i == 2 else 0)) for i, p in enumerate(PHONE_PATTERNS)])
    texts = F.transform(found, lambda raw: let(to_e164(raw), lambda p: score_phone(p, F.when(footer_raw.contains(raw) & (footer_raw != ""), "footer").otherwise("regex"), True)))
    return _first_per_value(F.concat(tel, data, texts))


def scored_emails(links: Column, addresses: Column, html: Column, footer_raw: Column) -> Column:
    """Scores of ``mailto:`` links, structured data and the pattern over the markup; the first of each address."""
    mail = F.transform(
        F.filter(links, lambda x: x["href"].startswith("mailto:")), lambda x: F.lower(strip(F.replace(x["href"], F.lit("mailto:"), F.lit(""))))
    )
    as_scores = lambda a, source: F.transform(F.filter(a, looks_like_email), lambda e: score_email(e, source(e)))
    data = F.transform(F.coalesce(addresses, F.array().cast("array<string>")), lambda e: F.lower(e))
    found = F.transform(F.regexp_extract_all(html, F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0)), lambda e: F.lower(e))
    where = lambda e: F.when((footer_raw != "") & footer_raw.contains(e), "footer").otherwise("regex")
    return _first_per_value(F.concat(as_scores(mail, lambda _: F.lit("mailto")), as_scores(data, lambda _: F.lit("schema")), as_scores(found, where)))


# --- addresses ----------------------------------------------------------------


def addresses_in(text: Column) -> Column:
    """``street, city, ST zip`` for each match with a state of the US."""
    pattern = "(?U)" + ADDRESS_PATTERN
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3, 4)])
    known = F.filter(groups, lambda g: g["g3"].isin(*US_STATES))
    return F.transform(known, lambda g: F.concat(strip(g["g1"]), F.lit(", "), strip(g["g2"]), F.lit(", "), g["g3"], F.lit(" "), g["g4"]))


def scored_addresses(schema_addresses: Column, lines: Column, footer_raw: Column, places: Column, html: Column) -> Column:
    """Scores of structured data, address elements, the footer, sections about places and the markup; one for each address, blanks collapsed."""
    scored = lambda a, source: F.transform(a, lambda v: score_text(v, source, 10))
    every = F.concat(
        scored(F.coalesce(schema_addresses, F.array().cast("array<string>")), "schema"),
        scored(F.filter(lines, lambda v: F.length(v) >= 10), "visible"),
        scored(addresses_in(footer_raw), "footer"),
        scored(F.flatten(F.transform(places, addresses_in)), "visible"),
        scored(addresses_in(html), "regex"),
    )
    return distinct_first(every, lambda s: F.array_join(F.filter(F.split(s["value"], r"(?U)\s+"), lambda w: w != ""), " "))


def count_locations(addresses: Column) -> Column:
    """Distinct second-to-last parts between commas, at least one; none without addresses."""
    parts = F.transform(addresses, lambda a: F.split(a, ",", -1))
    cities = F.transform(F.filter(parts, lambda p: F.size(p) >= 2), lambda p: strip(F.element_at(p, -2)))
    return F.when(F.size(addresses) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.size(F.array_distinct(cities))))


# --- social profiles ------------------------------------------------------------


def social_platform(href: Column) -> Column:
    """Platform of a link by its host or a host above it, else null."""
    def platform(host: Column) -> Column:
        return reduce(lambda c, kv: c.when((host == kv[0]) | host.endswith("." + kv[0]), kv[1]), SOCIAL_DOMAINS.items(), F.when(F.lit(False), ""))

    return F.when(href.startswith("http"), let(lstripped_www(domain_name(href)), platform))


def social_links(links: Column) -> Column:
    """Map of platform to its first link."""
    found = F.transform(links, lambda x: F.struct(social_platform(strip(x["href"])).alias("key"), strip(x["href"]).alias("value")))
    return F.map_from_entries(distinct_first(F.filter(found, lambda x: x["key"].isNotNull()), lambda x: x["key"]))


def _platform_by_pattern(href: Column, platform: str) -> Column:
    return matches(F.lower(href), SOCIAL_PATTERNS[platform])


def scored_social(links: Column, html: Column) -> Column:
    """Map of platform to score: the first link of the anchors, else of any ``href`` in the markup; links in lower case.

    Footer and navigation add nothing, as their links are anchors too.
    """
    anchors = F.filter(F.transform(links, lambda x: F.lower(x["href"])), lambda h: h != "")
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)["']"""), F.lit(1)), lambda h: F.lower(h))

    tagged = lambda a, source: F.transform(a, lambda h: F.struct(h.alias("h"), F.lit(source).alias("source")))
    every = F.concat(tagged(anchors, "visible"), tagged(hrefs, "regex"))

    def entry(all_links: Column, p: str) -> Column:
        first = F.get(F.filter(all_links, lambda x: _platform_by_pattern(x["h"], p)), F.lit(0))
        return F.struct(F.lit(p).alias("key"), first.alias("first"))

    found = let(every, lambda e: F.filter(F.array(*[entry(e, p) for p in SOCIAL_PATTERNS]), lambda x: x["first"].isNotNull()))
    return F.map_from_entries(
        F.transform(found, lambda x: F.struct(x["key"].alias("key"), score_url(x["first"]["h"], x["first"]["source"]).alias("value")))
    )


def is_social_url(url: Column, platform: Column) -> Column:
    """Has a scheme or ``//``, and a pattern of the platform occurs."""
    schemed = url.startswith("http://") | url.startswith("https://") | url.startswith("//")
    found = reduce(lambda c, p: c.when(platform == p, _platform_by_pattern(url, p)), SOCIAL_PATTERNS, F.when(F.lit(False), F.lit(False))).otherwise(False)
    return schemed & found


def normalise_social_url(url: Column, platform: Column) -> Column:
    """With a scheme; twitter.com as x.com; wa.me links from https://wa.me on."""
    full = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), F.regexp_replace(url, "^/+", "")))
    short = F.concat(F.lit("https://wa.me"), F.get(F.split(full, r"wa\.me", -1), F.lit(1)))
    return F.when(platform == "twitter", F.replace(full, F.lit("twitter.com"), F.lit("x.com"))).when(
        (platform == "whatsapp") & full.contains("wa.me") & ~full.startswith("https://wa.me"), short
    ).otherwise(full)


def merge_social(current: Column, new: Column) -> Column:
    """Known links win; new ones, a map of scores, join if they are proper links of their platform."""
    fresh = F.map_filter(new, lambda k, v: ~F.map_contains_key(current, k) & is_social_url(v["value"], k))
    return F.map_concat(current, F.transform_values(fresh, lambda k, v: normalise_social_url(v["value"], k)))
