"""The engine's entry points: pages in, sites out."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_pages
from ..functions.urls import canonical_url, path_of, requests, site_of
from . import business, evidence, merge, site

TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


@dataclass(frozen=True)
class Settings:
    """How many pages a site's view reads besides its homepage, and whether it lists them. ``timeout`` and ``concurrency`` are for fetchers."""

    max_pages: int = 6
    concurrency: int = 5
    timeout: int = 12
    debug: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Defaults, but for what MAX_PAGES, CONCURRENCY, TIMEOUT_SECONDS and DEBUG_MODE say (in any case); another value than a number or a truth word is an error."""
        given = {k.lower(): v.strip() for k, v in env.items()}
        numbers = {f: int(given[k]) for f, k in (("max_pages", "max_pages"), ("concurrency", "concurrency"), ("timeout", "timeout_seconds")) if k in given}
        if "debug_mode" in given:
            word = given["debug_mode"].lower()
            if word not in TRUE + FALSE:
                raise ValueError(f"DEBUG_MODE is {word!r}")
            numbers["debug"] = word in TRUE
        return cls(**numbers)


def select_pages(pages: DataFrame, max_pages: int = 6) -> DataFrame:
    """Of each site the homepage and the ``max_pages`` best other pages: chosen by URL alone, before any page is parsed."""
    sited = pages if "site" in pages.columns else pages.withColumn("site", site_of(F.col("url")))
    keys = sited.select("site", "page_id", canonical_url(F.col("url")).alias("url"))
    home = keys.filter(F.regexp_replace(path_of(F.col("url")), "/+$", "") == "").select("page_id")
    best = rank_pages(keys.select("site", "page_id", "url"), max_pages).select("page_id")
    return sited.join(home.union(best).distinct(), "page_id", "left_semi")


def analyze_sites(pages: DataFrame, settings: Settings = Settings(), select: bool = False) -> DataFrame:
    """Evidence of each site; with ``select`` only of the pages that ``select_pages`` chooses."""
    chosen = select_pages(pages, settings.max_pages) if select else pages
    return site.site_evidence(evidence.page_evidence(chosen), settings.debug)


def analyze(asked: DataFrame, pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``asked`` (url, and debug if there is one): the evidence of its site, or why there is none.

    ``pages`` holds what was fetched (page_id, url, html, and error if there is one). Answers
    have ``url``, ``success``, ``error``, ``details`` and the columns of ``analyze_sites``. An
    empty or null URL, or one that does not validate, is "Invalid URL"; one whose own page is
    not there or has no markup is "Unable to crawl website". A site asked for twice is read
    once; ``crawled_urls`` stands only in answers to requests (or settings) with debug.
    """
    debug = F.coalesce(F.col("debug").cast("boolean"), F.lit(False)) if "debug" in asked.columns else F.lit(False)
    good, bad = requests(asked.select("url", (debug | F.lit(settings.debug)).alias("debug")))
    error = F.col("error").cast("string") if "error" in pages.columns else F.lit(None).cast("string")
    marked = F.coalesce(F.col("html") != "", F.lit(False))
    own = pages.groupBy(canonical_url(F.col("url")).alias("own")).agg(F.max(marked).alias("fetched"), F.min(error).alias("why"))
    seen = good.join(own, F.col("canonical") == F.col("own"), "left").withColumn("site", site_of(F.col("canonical")))
    fetched = seen.filter("fetched").select("url", "debug", "site")
    missing = seen.filter("NOT coalesce(fetched, false)")
    of_sites = pages.select("page_id", "url", "html").withColumn("site", site_of(F.col("url"))).join(fetched.select("site").distinct(), "site", "left_semi")
    found = analyze_sites(of_sites, replace(settings, debug=True), select=True)
    answers = fetched.join(found, "site", "left").withColumn("crawled_urls", F.when(F.col("debug"), F.col("crawled_urls"))).drop("debug")
    nothing = F.lit(None).cast("string")
    return (
        answers.withColumns({"success": F.lit(True), "error": nothing, "details": nothing})
        .unionByName(_failed(missing, "Unable to crawl website", F.coalesce("why", F.when(F.col("own").isNull(), "no such page").otherwise("no content"))), True)
        .unionByName(_failed(bad, "Invalid URL", F.col("error")), True)
    )


def _failed(asked: DataFrame, error: str, details: Column) -> DataFrame:
    return asked.select("url", F.lit(False).alias("success"), details.alias("details")).withColumn("error", F.lit(error))


def failures(pages: DataFrame) -> DataFrame:
    """Quarantine: pages without markup, and why: (page_id, url, success, error, details)."""
    bad = pages.filter("html IS NULL OR html = ''")
    return bad.select("page_id", "url", F.lit(False).alias("success"), F.lit("no content").alias("error"), F.lit("").alias("details"))


def business_sites(pages: DataFrame) -> DataFrame:
    """Business view of each site."""
    return merge.merge_sites(business.page_business(pages))
