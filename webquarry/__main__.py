"""python -m webquarry PAGES OUT [--business] [--select N] [--debug] [--requests TABLE]: sites of a Parquet table of pages, as JSON lines."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from .operators.analyze import Settings, analyze, analyze_sites, business_sites, select_pages
from .session import ship
from .sources.tables import read_pages, write_json


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="webquarry", description=__doc__)
    parser.add_argument("pages")
    parser.add_argument("out")
    parser.add_argument("--business", action="store_true", help="the business view in place of the evidence")
    parser.add_argument("--select", type=int, metavar="N", help="read each site's homepage and its N best other pages only")
    parser.add_argument("--debug", action="store_true", help="list the pages of each site")
    parser.add_argument("--requests", metavar="TABLE", help="answer the rows (url, debug) of this Parquet table, each with evidence or an error")
    given = parser.parse_args(args)
    session = ship(spark or SparkSession.builder.appName("webquarry").getOrCreate())
    settings = Settings.from_env()
    settings = replace(settings, max_pages=given.select or settings.max_pages, debug=given.debug or settings.debug)
    pages = read_pages(session, given.pages)
    if given.requests:
        return write_json(analyze(session.read.parquet(given.requests), pages, settings), given.out)
    pages = pages.select("page_id", "url", "html")
    if given.select:
        pages = select_pages(pages, given.select).drop("site")
    write_json(business_sites(pages) if given.business else analyze_sites(pages, settings), given.out)


if __name__ == "__main__":
    main()
