"""SQL functions and the command line."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from webquarry.__main__ import main
from webquarry.functions import emails, sql, urls
from webquarry.operators.analyze import Settings, analyze
from webquarry.plans import fixtures as X


def test_sql_functions_agree_with_columns(spark):
    sql.register(spark)
    rows = X.table(spark, X.URLS, "url string").select(
        F.expr("url_domain(url)") == urls.domain_name(F.col("url")), F.expr("url_site(url)") == urls.site_of(F.col("url")), F.expr("url_depth(url)") == urls.path_depth(F.col("url"))
    )
    assert all(all(r) for r in rows.collect())
    e = F.col("e")
    rows = X.table(spark, X.EMAILS, "e string").select(F.expr("email_category(e)") == emails.email_category(e), F.expr("is_system_email(e)") == emails.is_system_email(e))
    assert all(all(r) for r in rows.collect())


def test_command_line(spark, tmp_path):
    spark.createDataFrame(list(X.PAGES), "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    main([str(tmp_path / "pages"), str(tmp_path / "out"), "--select", "2", "--debug"], spark)
    got = {r.site: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert set(got) == {"acme.io", "beta.io"} and got["acme.io"].homepage.title == "Welcome to Acme"


def test_settings_from_the_environment():
    assert Settings.from_env({}) == Settings()
    assert Settings.from_env({"MAX_PAGES": "3", "timeout_seconds": " 9", "CONCURRENCY": "2", "DEBUG_MODE": "True"}) == Settings(3, 2, 9, True)
    for wrong in ({"MAX_PAGES": "many"}, {"DEBUG_MODE": "perhaps"}):
        with pytest.raises(ValueError):
            Settings.from_env(wrong)


def test_requests_get_evidence_or_an_error(spark, tmp_path):
    pages = [*X.PAGES, (90, "https://down.io/", None), (91, "https://down.io/about", "<p>about</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    home = next(u for _, u, _ in X.PAGES if u.rstrip("/").endswith("acme.io"))
    asked = [(home, True), (f" {home} ", False), ("https://down.io", None), ("https://nowhere.io", None), ("http://localhost/x", None), ("  ", None), (None, None)]
    spark.createDataFrame(asked, "url string, debug boolean").write.parquet(str(tmp_path / "asked"))
    main([str(tmp_path / "pages"), str(tmp_path / "out"), "--requests", str(tmp_path / "asked")], spark)
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert len(got) == len(asked)
    good = [r for r in got if r.success]
    assert [r.site for r in good] == ["acme.io"] * 2 and all(r.homepage.title == "Welcome to Acme" and r.error is None for r in good)
    assert sorted(r.crawled_urls is None for r in good) == [False, True]
    assert sorted((r.url, r.error, r.details) for r in got if not r.success) == [
        ("", "Invalid URL", "url must not be empty"), ("", "Invalid URL", "url must not be empty"),
        ("http://localhost/x", "Invalid URL", "Localhost URLs are not allowed: localhost"),
        ("https://down.io", "Unable to crawl website", "no content"), ("https://nowhere.io", "Unable to crawl website", "no such page"),
    ]
    pages, asked = (spark.read.parquet(str(tmp_path / n)) for n in ("pages", "asked"))
    assert analyze(asked, pages.limit(0)).filter("success").isEmpty() and analyze(asked.limit(0), pages).isEmpty()
