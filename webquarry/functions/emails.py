"""E-mail addresses: extraction, validity, category, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EMAIL_CATEGORIES, EMAIL_CONFIDENCE, EMAIL_PATTERN, FAKE_EMAIL_MARKS, SYSTEM_MARKS, VERIFIED_ORDER
from .text import has_any, let, strip


def emails_in(html: Column) -> Column:
    """Candidates in raw markup, lower case, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(html, F.lit(EMAIL_PATTERN), F.lit(0)), lambda e: F.lower(e))


def mailto_addresses(links: Column) -> Column:
    """Addresses of ``mailto:`` links, without their query, lower case."""
    mine = F.filter(links, lambda x: F.lower(x["href"]).startswith("mailto:"))
    found = F.transform(mine, lambda x: F.lower(strip(F.substring_index(F.substr(x["href"], F.lit(8)), "?", 1))))
    return F.filter(found, lambda e: e != "")


def is_valid_email(e: Column) -> Column:
    """Syntax only (documented subset): dots neither doubled nor at an end of the local part of 1 to 64 characters, proper labels, no reserved top-level name."""
    return let(F.struct(F.substring_index(e, "@", 1).alias("local"), F.split(F.substring_index(e, "@", -1), r"\.", -1).alias("labels")), lambda p: _is_valid(e, p["local"], p["labels"]))


def _is_valid(e: Column, local: Column, labels: Column) -> Column:
    return (
        e.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+$") & F.length(local).between(1, 64) & ~local.startswith(".") & ~local.endswith(".")
        & ~local.contains("..") & (F.size(labels) > 1) & F.forall(labels, lambda x: x.rlike("^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$"))
        & ~F.lower(F.element_at(labels, -1)).isin("test", "invalid", "localhost", "local", "onion", "arpa") & (F.length(e) <= 254)
        & ~F.element_at(labels, -1).rlike("^[0-9]+$")
    )


def looks_like_email(e: Column) -> Column:
    """The simple pattern."""
    return e.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def extract_emails(html: Column, links: Column) -> Column:
    """Sorted, distinct, valid addresses of links and of the markup."""
    return F.array_sort(F.filter(F.array_distinct(F.concat(mailto_addresses(links), emails_in(html))), is_valid_email))


def is_system_email(e: Column) -> Column:
    return F.coalesce(e == "", F.lit(True)) | has_any(F.lower(e), SYSTEM_MARKS)


def email_category(e: Column) -> Column:
    return let(e, _category)


def _category(e: Column) -> Column:
    low = F.lower(e)
    c = F.when(e.isNull() | (e == ""), "unknown").when(is_system_email(e), "system")
    return reduce(lambda c, kv: c.when(low.rlike(kv[1]), kv[0]), EMAIL_CATEGORIES, c).otherwise("unknown")


def email_confidence(category: Column) -> Column:
    return reduce(lambda c, kv: c.when(category == kv[0], F.lit(kv[1])), EMAIL_CONFIDENCE.items(), F.when(F.lit(False), 0.0))


def categorised(emails: DataFrame, keys: tuple[str, ...] = (), email: str = "email", order: str = "pos") -> DataFrame:
    """Distinct addresses (case counts) with category and confidence, the first of equals."""
    first = emails.filter(F.col(email).isNotNull() & (F.col(email) != "")).groupBy(*keys, email).agg(F.min(order).alias(order))
    return first.withColumn("category", email_category(F.col(email))).withColumn("confidence", email_confidence(F.col("category")))


def verified_emails(emails: Column) -> Column:
    """Of an array: business, support, sales and marketing addresses, in this order."""
    def of(found: Column, kind: str) -> Column:
        return F.transform(F.filter(found, lambda x: x["kind"] == kind), lambda x: x["email"])

    once = F.array_distinct(F.filter(emails, lambda e: e != ""))
    found = F.transform(once, lambda e: F.struct(e.alias("email"), email_category(e).alias("kind")))
    return let(found, lambda f: F.concat(*[of(f, kind) for kind in VERIFIED_ORDER]))


def is_fake_email(e: Column) -> Column:
    low = F.lower(e)
    return has_any(low, FAKE_EMAIL_MARKS) | low.rlike("^[a-f0-9]{32,}@")


def is_clean_email(e: Column) -> Column:
    return ~is_fake_email(e) & F.lower(e).rlike(r"^[^@]+@[^@]+\.[a-z]{2,}$")
