"""Technology fingerprints and feature flags over raw markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CHAT_SIGNATURES, CONTACT_FORM_WORDS, FEATURE_PATTERNS, FEATURES, FORM_INTENTS, SCRIPT_WORDS, SECTION_ID_PATTERNS, SOCIAL_WORDS,
    TEAM_PAGE_PATTERNS, TECHNOLOGIES,
)
from .text import has_any, let, matches


def _found(html_lower: Column, category: str) -> Column:
    hits = [F.when(has_any(html_lower, [s.lower() for s in signs]), name) for name, kind, signs in TECHNOLOGIES if kind == category]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def technology(html: Column) -> Column:
    """struct(cms, analytics, widgets, booking): the first CMS, and all of the others in the order of the table."""
    return let(F.lower(html), lambda low: F.struct(
        F.coalesce(F.get(_found(low, "cms"), F.lit(0)), F.lit("")).alias("cms"),
        *[_found(low, c).alias(c) for c in ("analytics", "widgets", "booking")],
    ))


def technology_items(tech: Column) -> Column:
    """array of struct(category, name): the CMS, then analytics, widgets and booking."""
    one = lambda names, category: F.transform(names, lambda n: F.struct(F.lit(category).alias("category"), n.alias("name")))
    cms = F.filter(F.array(tech["cms"]), lambda n: n != "")
    return F.concat(one(cms, "cms"), *[one(tech[c], c) for c in ("analytics", "widgets", "booking")])


def features_in_markup(html: Column, locations: bool = False) -> dict[str, Column]:
    """The part of each flag that raw markup decides."""
    low = F.lower(html)
    names = [*FEATURES, *(["has_multiple_locations"] if locations else [])]
    return {n: matches(low, FEATURE_PATTERNS[n]) if n in FEATURE_PATTERNS else F.lit(False) for n in names}


def _any_like(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda v: v.rlike(pattern))


def features(html: Column, d: Column, locations: bool = False) -> Column:
    """struct of all flags, from markup and digest. ``locations`` computes the flag for several locations, which is off by default."""
    flags = features_in_markup(html, locations)
    script = F.lower(d["script_text"])
    forms = F.exists(d["forms"], lambda f: has_any(f["markup"], CONTACT_FORM_WORDS) | (f["inputs"] >= 2))
    flags["has_contact_form"] = flags["has_contact_form"] | forms
    for name, words in SCRIPT_WORDS.items():
        flags[name] = flags[name] | has_any(script, words)
    for name, pattern in SECTION_ID_PATTERNS.items():
        flags[name] = flags[name] | _any_like(d["section_ids"], f"(?iu){pattern}")
    flags["has_social_links"] = F.exists(d["links"], lambda x: has_any(F.lower(x["href"]), SOCIAL_WORDS))
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


def aggregate_features(pages: DataFrame, keys: tuple[str, ...], features: str = "features") -> DataFrame:
    """Each flag of the struct: whether any page has it."""
    names = pages.schema[features].dataType.names
    return pages.groupBy(*keys).agg(*[F.bool_or(F.col(f"{features}.{n}")).alias(n) for n in names])


def form_flags(html: Column, d: Column) -> Column:
    """struct(contact_form, booking_form, newsletter_form, chat_widget, live_chat)."""
    def intent(pattern: str) -> Column:
        p = f"(?iud){pattern}"
        return F.exists(d["forms"], lambda f: f["names"].rlike(p) | f["heading"].rlike(p)) | F.exists(d["iframes"], lambda s: s.rlike(p))

    chat = has_any(F.lower(html), CHAT_SIGNATURES)
    return F.struct(*[intent(p).alias(n) for n, p in FORM_INTENTS.items()], chat.alias("chat_widget"), chat.alias("live_chat"))


def has_team_page(html: Column) -> Column:
    return matches(F.lower(html), TEAM_PAGE_PATTERNS, "dU")
