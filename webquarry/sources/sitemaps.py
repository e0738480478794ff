"""Sitemaps: bodies that were fetched, as a table (url, body), walked from their roots."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

_NS = "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def locations(body: str | None) -> list[str]:
    """Locations of a sitemap or an index, those without namespace only if there are no others; broken XML has none."""
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return []
    for ns in (_NS, ""):
        found = [e.text.strip() for kind in ("url", "sitemap") for e in root.findall(f".//{ns}{kind}/{ns}loc") if e.text]
        if found:
            return sorted(set(found))
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def sitemap_locations(body: pd.Series) -> pd.Series:
    return body.map(locations)


def probe_urls(root: Column) -> Column:
    """Where a site's sitemaps are looked for."""
    bare = F.regexp_replace(root, "/+$", "")
    return F.array(F.concat(bare, F.lit("/sitemap.xml")), F.concat(bare, F.lit("/sitemap_index.xml")))


def walk(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows (site, url): the pages of all sitemaps reachable from each site's probes.

    ``sites`` has (site, root), ``fetched`` (url, body). What ends in ``.xml`` is a sitemap,
    the rest are pages. Each round joins the sitemaps that are new to the edges and leaves
    out those seen before, until none is new: as ``fetched`` is finite, chains of any depth end.
    """
    edges = fetched.filter(F.col("body").isNotNull()).select(F.col("url").alias("parent"), F.explode(sitemap_locations("body")).alias("child")).distinct()
    edges = written(edges, "sitemaps")
    front = sites.select("site", F.explode(probe_urls(F.col("root"))).alias("parent")).distinct()
    seen, pages, rounds = front, None, 0
    while True:
        found = front.join(edges, "parent").select("site", "child").distinct()
        own = found.filter(~F.col("child").endswith(".xml")).select("site", F.col("child").alias("url"))
        pages = own if pages is None else pages.union(own)
        front = found.filter(F.col("child").endswith(".xml")).select("site", F.col("child").alias("parent")).join(seen, ["site", "parent"], "left_anti")
        front = written(front, "sitemaps")
        if front.isEmpty():
            return pages.distinct()
        seen, rounds = seen.union(front), rounds + 1
        if rounds % 8 == 0:  # a long chain must not grow the plan
            pages, seen = written(pages.distinct(), "sitemaps"), written(seen, "sitemaps")
