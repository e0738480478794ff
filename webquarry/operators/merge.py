"""Business view of a site: the pages' views in order, merged. Mostly the first one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ranking import page_score
from ..functions.urls import domain_name, path_of, site_of
from ..session import written

ALL_FEATURES = (*K.FEATURES, "has_multiple_locations")


def ordered(business: DataFrame) -> DataFrame:
    """Rows (site, ord, b): the homepage first, then by score, URL and page_id."""
    url = F.col("b.url")
    home = F.regexp_replace(path_of(url), "/+$", "") == ""
    order = F.struct((~home).alias("later"), (-page_score(url)["score"]).alias("score"), url.alias("url"), F.col("page_id").alias("page_id"))
    return business.select((F.col("site") if "site" in business.columns else site_of(url)).alias("site"), order.alias("ord"), "b")


def _first(value: Column) -> Column:
    """Of a group the value of the first row that has one."""
    return F.min_by(F.when(value != "", value), F.when(value != "", F.col("ord")))


def company(rows: DataFrame) -> DataFrame:
    """(site, name, description, tagline, industry): structured data, then the company's own words, then metadata."""
    of = lambda f: F.get(F.filter(F.col("b.schema"), lambda s: s[f] != ""), F.lit(0))[f]
    b = F.col("b")
    out = rows.groupBy("site").agg(
        F.coalesce(_first(of("name")), _first(b["company"]["name"]), _first(b["metadata"]["og_title"]), F.lit("")).alias("name"),
        F.coalesce(_first(of("description")), _first(b["company"]["description"]), F.lit("")).alias("description"),
        F.coalesce(_first(b["company"]["tagline"]), _first(b["metadata"]["description"]), F.lit("")).alias("tagline"),
    )
    return out.withColumn("industry", F.lit(""))


def contacts(rows: DataFrame) -> DataFrame:
    """One row for each (site, value): the first page decides; structured data of that page makes it surer."""
    def of(kind: str, values: str, field: str, sure: float, rank: int) -> DataFrame:
        each = rows.select("site", "ord", F.posexplode(f"b.{values}").alias("at", "value"), F.col("b.schema").alias("schema"))
        known = F.exists("schema", lambda s: s[field] == F.col("value"))
        return each.select(
            "site", "value", F.lit(rank).alias("rank"), "ord", "at", F.lit(kind).alias("type"),
            F.when(known, sure).otherwise(0.85).alias("confidence"), F.when(known, "schema").otherwise("visible").alias("source"),
        )

    both = of("email", "emails", "email", 0.99, 0).unionByName(of("phone", "phones", "telephone", 0.93, 1))
    first = both.groupBy("site", "value").agg(F.min(F.struct("rank", "ord", "at", "type", "confidence", "source")).alias("x"))
    return first.select("site", "value", "x.type", "x.confidence", "x.source", F.struct("x.rank", "x.ord", "x.at").alias("order"))


def addresses(rows: DataFrame) -> DataFrame:
    """(site, value, order, is_primary): postal addresses of structured data; the first is primary."""
    each = rows.select("site", "ord", F.posexplode("b.addresses").alias("at", "value"))
    out = each.groupBy("site", "value").agg(F.min(F.struct("ord", "at")).alias("order"))
    first = out.groupBy("site").agg(F.min("order").alias("first"))
    return out.join(first, "site").withColumn("is_primary", F.col("order") == F.col("first")).drop("first")


def social(rows: DataFrame) -> DataFrame:
    """(site, social): map of platform to the first page's link."""
    each = rows.select("site", "ord", F.explode("b.social").alias("platform", "url")).filter("url <> ''")
    first = each.groupBy("site", "platform").agg(F.min_by("url", "ord").alias("url"))
    return first.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "url")))).alias("social"))


def services(rows: DataFrame) -> DataFrame:
    """(site, services): distinct, in order."""
    each = rows.select("site", "ord", F.posexplode("b.services").alias("at", "name"))
    first = each.groupBy("site", "name").agg(F.min(F.struct("ord", "at")).alias("o"))
    return first.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("services"))


def technology(rows: DataFrame) -> DataFrame:
    """(site, cms, analytics, widgets, booking): the first CMS, sorted union of the others."""
    t = F.col("b.technology")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(t[c]))))  # noqa: E731  few distinct arrays of few names
    return rows.groupBy("site").agg(F.coalesce(_first(t["cms"]), F.lit("")).alias("cms"), *[union(c).alias(c) for c in ("analytics", "widgets", "booking")])


def features(rows: DataFrame) -> DataFrame:
    """(site, 13 flags): whether any page has it."""
    have = rows.schema["b"].dataType["features"].dataType.names
    flag = lambda n: F.bool_or(F.col(f"b.features.{n}")) if n in have else F.lit(False)
    return rows.groupBy("site").agg(*[flag(n).alias(n) for n in ALL_FEATURES])


def quality(rows: DataFrame) -> DataFrame:
    """(site, pages, quality, page_confidence): half what kinds of data there are, half the mean confidence above 0 (one half without)."""
    b = F.col("b")
    some = lambda c: F.bool_or(c).cast("int")
    points = some(F.size(b["emails"]) > 0) + some(F.size(b["phones"]) > 0) + some(b["company"]["name"] != "") + some(b["technology"]["cms"] != "")
    sure = b["page_classification"]["confidence"]
    mean = F.coalesce(F.avg(F.when(sure != 0, sure)), F.lit(0.5))
    return rows.groupBy("site").agg(
        F.count("*").alias("pages"), F.round(F.least(F.lit(0.99), points / 4.0 * 0.5 + mean * 0.5), 2).alias("quality"),
        F.avg(F.coalesce(sure, F.lit(0.0))).alias("page_confidence"),
    )


def sources(rows: DataFrame) -> DataFrame:
    """(site, pages_crawled, data_sources): URLs in order, and of which pages the e-mails and phones are."""
    urls = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.col("ord")))), lambda o: o["url"])
    b = F.col("b")
    return rows.groupBy("site").agg(
        urls(F.lit(True)).alias("pages_crawled"),
        F.struct(urls(F.size(b["emails"]) > 0).alias("emails"), urls(F.size(b["phones"]) > 0).alias("phones")).alias("data_sources"),
    )


def key_features(flags: Column, services: Column) -> Column:
    """The first five labels of flags that are set, then the first service if there is room."""
    labels = F.slice(F.filter(F.array(*[F.when(flags[n], label) for label, n in K.KEY_FEATURES]), lambda x: x.isNotNull()), 1, 5)
    room = (F.size(labels) < 5) & (F.size(services) > 0)
    return F.when(room, F.concat(labels, F.slice(services, 1, 1))).otherwise(labels)


def merge_sites(business: DataFrame) -> DataFrame:
    """One row for each site: structs summary, presence, capabilities, discovery. ``business`` comes from ``page_business``."""
    rows = written(ordered(business), "business")  # pages are parsed once, though several aggregates read them
    people = contacts(rows).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("order", "value", "type", "confidence", "source"))).alias("contacts"))
    places = addresses(rows).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("order", "value", "is_primary"))).alias("addresses"))
    flags = features(rows).select("site", F.struct(*ALL_FEATURES).alias("features"))
    tech = technology(rows).select("site", F.struct("cms", "analytics", "widgets", "booking").alias("technology"))
    out = company(rows).join(quality(rows), "site").join(flags, "site").join(tech, "site").join(sources(rows), "site")
    for part in (people, places, social(rows), services(rows)):
        out = out.join(part, "site", "left")
    none = F.array().cast("array<string>")
    found = F.coalesce(F.col("services"), none)
    url = F.concat(F.lit("https://"), F.col("site"))
    tidy = lambda a, fields: F.coalesce(F.transform(a, lambda x: F.struct(*[x[f].alias(f) for f in fields])), F.array())
    return out.select(
        "site",
        F.struct(
            F.when(F.col("name") != "", F.col("name")).otherwise(domain_name(url)).alias("business_name"), "tagline", F.col("industry").alias("primary_industry"),
            F.coalesce(F.size("contacts"), F.lit(0)).alias("contact_methods_found"), F.greatest(F.lit(1), F.coalesce(F.size("addresses"), F.lit(1))).alias("locations_count"),
            key_features(F.col("features"), found).alias("key_features"), F.col("quality").alias("data_quality_score"), F.lit(0).alias("team_size_estimated"),
        ).alias("summary"),
        F.struct(
            url.alias("website_url"), tidy(F.col("contacts"), ("value", "type", "confidence", "source")).alias("verified_contacts"),
            tidy(F.col("addresses"), ("value", "is_primary")).alias("addresses"),
            F.coalesce(F.col("social"), F.create_map().cast("map<string,string>")).alias("social_profiles"),
        ).alias("presence"),
        F.struct(found.alias("services"), "features", "technology", none.alias("team_members")).alias("capabilities"),
        F.struct(
            "pages_crawled", F.create_map(F.lit("overall"), F.col("quality"), F.lit("pages"), F.col("page_confidence")).alias("confidence_summary"),
            "data_sources", F.current_timestamp().alias("last_updated"),
        ).alias("discovery"),
    )
