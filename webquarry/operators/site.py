"""Evidence of a site: slots, counters, cleaning.

Cleaning drops what an earlier page of the site already showed. As each page keeps a
limited number of items, and only kept items count as shown, this depends on the order of
the pages: rows sorted by site and cleaning order stream through one fold, whose memory is
the strings a site has shown so far. All else is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.emails import is_clean_email
from ..functions.ranking import page_score
from ..functions.text import clean_text, distinct_first, has_any, matches
from ..functions.urls import path_of, site_of
from ..session import written

#: Kinds that are cleaned across the pages of a site, with how many of them a page keeps (0: all).
FOLDED = (("headings", 15), ("paragraphs", 8), ("cards", 15), ("emails", 0), ("phones", 0), ("addresses", 0), ("social_links", 0))


def with_site_order(evidence: DataFrame, site: str = "site") -> DataFrame:
    """``evidence`` with its site and the struct ``ord``: the homepage, then by score, URL and page_id."""
    url = F.col("e.url")
    home = F.regexp_replace(path_of(url), "/+$", "") == ""
    out = evidence if site in evidence.columns else evidence.withColumn(site, site_of(url))
    return out.withColumn("ord", F.struct((~home).alias("later"), (-page_score(url)["score"]).alias("score"), url.alias("url"), F.col("page_id").alias("page_id")))


def counters(evidence: DataFrame) -> DataFrame:
    """(site, pages_scanned, pages_extracted): one page counts for each slot, all profiles and others count."""
    slot = F.col("e.page_type").isin(*K.SLOTS)
    return evidence.groupBy("site").agg(
        F.count("*").alias("pages_scanned"),
        (F.count_distinct(F.when(slot, F.col("e.page_type"))) + F.count(F.when(~slot, True))).alias("pages_extracted"),
    )


def slot_pages(evidence: DataFrame) -> DataFrame:
    """Pages that a site's view holds: the first of each slot and all profiles, with ``place`` in the cleaning order.

    Needs ``site`` and ``ord``. Pages of unknown type are counted (``counters``), not held.
    """
    kind = F.col("e.page_type")
    place = F.array_position(F.array(*[F.lit(t) for t in K.CLEANING_ORDER]), kind).cast("int")
    known = evidence.withColumn("place", place).filter("place > 0")
    # only keys meet to find the first of each slot: the evidence itself is not sorted
    firsts = known.filter(kind != "team_profile").groupBy(F.col("site").alias("__site"), kind.alias("__type")).agg(F.min("ord").alias("__first"))
    held = known.join(firsts, (F.col("site") == F.col("__site")) & (kind == F.col("__type")), "left")
    return held.filter((kind == "team_profile") | (F.col("ord") == F.col("__first"))).drop("__site", "__type", "__first")


def _candidates(e: Column) -> dict[str, Column]:
    """Of each folded kind the items that may stay."""
    fine = lambda c: ~has_any(c, K.BOILERPLATE)
    low = F.lower
    return {
        "headings": F.filter(F.slice(e["headings"], 1, 20), lambda h: fine(low(h["text"])) & ~has_any(low(h["text"]), K.UI_HEADINGS) & (F.length(h["text"]) > 2)),
        "paragraphs": F.filter(
            F.slice(e["paragraphs"], 1, 40),
            lambda p: F.length(p["text"]).between(50, 800) & fine(low(p["text"])) & ~has_any(low(p["text"]), K.DISCARD_PHRASES),
        ),
        "cards": F.filter(F.slice(e["cards"], 1, 30), lambda c: F.concat_ws("", c["title"], c["subtitle"], c["description"]) != ""),
        "emails": F.filter(e["emails"], lambda x: is_clean_email(x["value"])),
        "phones": F.filter(e["phones"], lambda x: F.length(x["value"]) >= 6),
        "addresses": F.filter(e["addresses"], lambda x: F.length(x["value"]) >= 10),
        "social_links": e["social_links"],
    }


def _key(kind: str, x: Column) -> Column:
    if kind in ("headings", "paragraphs"):
        return F.lower(x["text"])
    if kind == "cards":
        return F.lower(F.concat_ws("|", *[F.coalesce(x[f], F.lit("None")) for f in ("title", "subtitle", "description")]))
    return F.lower(x["value"]) if kind in ("emails", "social_links") else x["value"]


def keep_new(pages: list[list[list[str]]], limits: list[int]) -> list[list[list[int]]]:
    """The fold, for pages of one site in order: of each kind the positions that stay."""
    state = _Fold(limits)
    return [state.page(p) for p in pages]


class _Fold:
    def __init__(self, limits: list[int]):
        self.limits, self.seen = limits, [set() for _ in limits]

    def page(self, kinds: list[list[str]]) -> list[list[int]]:
        out = []
        for keys, seen, limit in zip(kinds, self.seen, self.limits):
            kept: list[int] = []
            for i, k in enumerate(keys or ()):
                if k not in seen:
                    seen.add(k)
                    kept.append(i)
                    if limit and len(kept) >= limit:
                        break
            out.append(kept)
        return out


def _fold(names: list[str], keyed: list[int], site_at: int):
    limits = [n for _, n in FOLDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, state = None, _Fold(limits)
        for batch in batches:
            kept = [[] for _ in FOLDED]
            for s, *kinds in zip(batch.column(site_at).to_pylist(), *(batch.column(i).to_pylist() for i in keyed)):
                if s != site:
                    site, state = s, _Fold(limits)
                for out, k in zip(kept, state.page(kinds)):
                    out.append(k)
            columns = [c for i, c in enumerate(batch.columns) if i not in keyed]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(k, pa.list_(pa.int32())) for k in kept]], names=names)

    return run


def clean_pages(slots: DataFrame) -> DataFrame:
    """``slots`` with the cleaned evidence ``c`` in place of ``e``."""
    spark = slots.sparkSession
    e = F.col("e")
    found = _candidates(e)
    rows = slots.withColumns({f"i_{k}": found[k] for k, _ in FOLDED})
    rows = rows.withColumns({f"k_{k}": F.transform(f"i_{k}", partial(_key, k)) for k, _ in FOLDED})
    keys = [rows.columns.index(f"k_{k}") for k, _ in FOLDED]
    plain = [f for f in rows.schema.fields if not f.name.startswith("k_")]
    names = [f.name for f in plain] + [f"n_{k}" for k, _ in FOLDED]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + [f"n_{k} array<int>" for k, _ in FOLDED])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = rows.repartition(parts, "site").sortWithinPartitions("site", "place", "ord").mapInArrow(_fold(names, keys, rows.columns.index("site")), schema)
    kept = {k: F.transform(f"n_{k}", partial(F.get, F.col(f"i_{k}"))) for k, _ in FOLDED}
    own = lambda a: distinct_first(F.filter(a, lambda x: x["value"] != ""), lambda x: x["value"])
    home = F.regexp_replace(path_of(e["url"]), "/+$", "") == ""
    new = {
        "page_type": F.when(home, "homepage").otherwise(e["page_type"]),
        "title": clean_text(e["title"]), "meta_title": clean_text(e["meta_title"]), "meta_description": clean_text(e["meta_description"], 300),
        "footer_text": F.lit(None).cast("string"), "copyright": F.lit(None).cast("string"),
        "lists": F.slice(F.filter(F.slice(e["lists"], 1, 10), lambda x: F.size(x["items"]) > 0), 1, 5),
        "tables": F.slice(F.filter(F.slice(e["tables"], 1, 5), lambda t: F.size(t["rows"]) > 0), 1, 3),
        "opening_hours": F.filter(e["opening_hours"], lambda h: matches(h["value"], [K.HOURS_PATTERN]) & ~has_any(F.lower(h["value"]), K.BOILERPLATE) & ~has_any(h["value"], K.HOURS_NOT)),
        "maps_links": own(e["maps_links"]), "whatsapp_links": own(e["whatsapp_links"]), "calendar_links": own(e["calendar_links"]),
        "navigation_links": F.filter(e["navigation_links"], lambda x: (x != "") & ~has_any(F.lower(x), K.NAV_SKIP) & has_any(F.lower(x), K.NAV_KEEP)),
        "schema_data": F.filter(e["schema_data"], lambda s: s["schema_type"].isin(*K.CLEAN_SCHEMA_TYPES)),
        **kept,
    }
    empty = {n: F.filter(e[n], lambda x: F.lit(False)) for n in ("footer_emails", "footer_phones", "footer_addresses", "footer_social_links", "scripts")}
    fields = slots.schema["e"].dataType.names
    c = F.struct(*[(new | empty).get(n, e[n]).alias(n) for n in fields])
    return folded.withColumn("c", c).select(*[x for x in slots.columns], "c")


def is_meaningful(c: Column) -> Column:
    return F.size(c["headings"]) + F.size(c["paragraphs"]) + F.size(c["cards"]) + F.size(c["emails"]) + F.size(c["phones"]) > 0


def technology_of(slots: DataFrame) -> DataFrame:
    """(site, technology): the first script of each category and name over some of the slots."""
    each = slots.filter(F.col("e.page_type").isin(*K.TECHNOLOGY_PAGES)).select("site", "place", "ord", F.posexplode("e.scripts").alias("at", "s"))
    key = F.lower(F.concat_ws(":", "s.category", "s.name"))
    firsts = each.groupBy("site", key.alias("key")).agg(F.min(F.struct("place", "ord", "at", "s")).alias("x"))
    return firsts.groupBy("site").agg(F.array_sort(F.collect_list("x")).alias("x")).select("site", F.transform("x", lambda x: x["s"]).alias("technology"))


def technology_map(evidence: DataFrame) -> DataFrame:
    """(site, category, name, script): the last script of each category and name over all pages, before cleaning."""
    each = evidence.select("site", "ord", F.posexplode("e.scripts").alias("at", "s"))
    return each.groupBy("site", F.col("s.category").alias("category"), F.col("s.name").alias("name")).agg(F.max_by("s", F.struct("ord", "at")).alias("script"))


def footer_of(slots: DataFrame) -> DataFrame:
    """(site, footer struct(text, source)): the contact page's footer, else the homepage's."""
    kind, text = F.col("e.page_type"), F.col("e.footer_text")
    some = slots.filter(kind.isin("contact", "homepage") & (text != ""))
    return some.groupBy("site").agg(F.min_by(F.struct(text.alias("text"), F.col("e.url").alias("source")), F.when(kind == "contact", 0).otherwise(1)).alias("footer"))


def site_evidence(evidence: DataFrame, debug: bool = False) -> DataFrame:
    """One row for each site: a column for each slot (null if it shows nothing), profiles, technology, footer, counters.

    ``evidence`` comes from ``page_evidence``. ``debug`` adds the pages' URLs.
    """
    ordered = written(with_site_order(evidence), "evidence")  # pages are parsed once, though several aggregates read them
    slots = slot_pages(ordered)
    cleaned = clean_pages(slots)
    c = F.col("c")
    shown = F.when(is_meaningful(c), c)
    place = F.col("place")
    at = {t: i + 1 for i, t in enumerate(K.CLEANING_ORDER)}
    profile = F.when((place == at["team_profile"]) & is_meaningful(c), F.struct("ord", "c"))
    views = cleaned.groupBy("site").agg(
        *[F.first(F.when(place == at[t], shown), ignorenulls=True).alias(t) for t in K.SLOTS],
        F.transform(F.array_sort(F.collect_list(profile)), lambda x: x["c"]).alias("team_profiles"),
    )
    out = counters(ordered).join(views, "site", "left").join(technology_of(slots), "site", "left").join(footer_of(slots), "site", "left")
    if debug:
        urls = ordered.groupBy("site").agg(F.transform(F.array_sort(F.collect_list("ord")), lambda o: o["url"]).alias("crawled_urls"))
        out = out.join(urls, "site", "left")
    return out.withColumn("discovery_method", F.lit(K.DISCOVERY_METHOD))


def first_of_site(items: DataFrame, key: Column, order: tuple[str, ...], site: str = "site") -> DataFrame:
    """Rows of ``items`` whose key no row of the site before them has: cleaning of the kinds without a limit, for streams of rows."""
    w = Window.partitionBy(site, key).orderBy(*order)
    return items.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
