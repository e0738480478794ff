"""All queries of the engine by name, and the same results as SQL for DuckDB where SQL can express them.

Lists appear as strings joined by ``|``, so that results compare as plain values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import confidence, contacts, emails, jsonld, ranking, technology, urls
from ..functions.text import strip
from ..operators import analyze, business, evidence, site
from ..session import ship
from ..sources import sitemaps
from ..sources.html import html_nodes, with_digest
from ..sources.tables import as_json, read_pages
from . import fixtures as X
from .fixtures import table, values


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


def _all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawled pages and the literal ones."""
    return _pages(spark, sf_dir).union(spark.createDataFrame(list(X.PAGES), "page_id long, url string, html string"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url): the pages' and literal ones, these with negative ids."""
    return _pages(spark, sf_dir).select(F.col("page_id").alias("id"), "url").union(table(spark, X.URLS, "url string").select((-F.col("pos") - 1).alias("id"), "url"))


def _bars(c: Column) -> Column:
    return F.array_join(c, "|")


def _digest(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return with_digest(_pages(spark, sf_dir), fields=fields)


# --- URLs ---------------------------------------------------------------------


def url_canonical(spark, sf_dir):
    return _urls(spark, sf_dir).select("id", urls.canonical_url(F.col("url")).alias("canonical"))


def url_strip_tracking(spark, sf_dir):
    return _urls(spark, sf_dir).select("id", urls.strip_tracking(F.col("url")).alias("stripped"))


def url_root_domain(spark, sf_dir):
    u = F.col("url")
    return _urls(spark, sf_dir).select("id", urls.root_domain(u).alias("root"), urls.domain_name(u).alias("domain"), urls.site_of(u).alias("site"))


def url_same_domain(spark, sf_dir):
    return _urls(spark, sf_dir).select("id", urls.same_domain(F.col("url"), F.lit("https://acme.io/x")).alias("same"))


def url_depth(spark, sf_dir):
    return _urls(spark, sf_dir).select("id", urls.path_depth(F.col("url")).cast("long").alias("depth"))


def url_slug(spark, sf_dir):
    return _urls(spark, sf_dir).select("id", _bars(urls.slug_words(F.col("url"))).alias("slug"))


def url_dedupe(spark, sf_dir):
    return urls.deduplicate_urls(_urls(spark, sf_dir), order=("id",))


def url_validate(spark, sf_dir):
    c = urls.validate_url(F.col("url"))
    return table(spark, X.HOSTS, "url string").select("url", c["valid"].alias("valid"), c["message"].alias("message"))


# --- page types -----------------------------------------------------------------


def page_score(spark, sf_dir):
    s = ranking.page_score(F.col("url"))
    return _urls(spark, sf_dir).select("id", s["page_type"].alias("page_type"), s["confidence"].alias("confidence"), s["score"].alias("score"))


def page_topk_per_site(spark, sf_dir):
    sites = _pages(spark, sf_dir).select(urls.site_of(F.col("url")).alias("site")).distinct()
    every = sites.withColumn("path", F.explode(F.array(*[F.lit(p) for p in X.PATHS])))
    every = every.select("site", F.concat(F.lit("https://"), "site", "path").alias("url"))
    return ranking.rank_pages(every, 6).select("site", "url", "score", "page_type", F.col("rank").cast("long").alias("rank"))


def page_type(spark, sf_dir):
    return _urls(spark, sf_dir).select("id", ranking.evidence_page_type(F.col("url"), F.lit("")).alias("page_type"))


def classify_page(spark, sf_dir):
    names = ("title", "h1", "meta_description", "body_text")
    rows = table(spark, X.SIGNALS, "url string, title string, h1 string, meta_description string, body_text string")
    c = ranking.classify(F.col("url"), {n: F.lower(n) for n in names})
    rounded = [F.round(c[n], 6).alias(n) for n in ("confidence", "url_score", "content_score")]
    return rows.select("url", c["type"].alias("page_type"), *rounded)


def candidate_urls(spark, sf_dir):
    """What sitemaps and links propose, as one set."""
    links = _urls(spark, sf_dir).select(urls.canonical_url(F.col("url")).alias("url"))
    maps = sitemaps.walk(table(spark, X.SITES, "site string, root string").drop("pos"), table(spark, X.SITEMAPS, "url string, body string").drop("pos"))
    return links.union(maps.select("url")).distinct()


# --- structure of pages ----------------------------------------------------------


def page_title_lang(spark, sf_dir):
    d = F.col("d")
    return _digest(spark, sf_dir, "title", "h1", "lang").select("page_id", F.coalesce(d["title"], F.lit("")).alias("title"), evidence.title(d).alias("shown"), d["lang"].alias("lang"))


def page_headings(spark, sf_dir):
    rows = _digest(spark, sf_dir, "headings").select("page_id", F.explode(evidence.headings(F.col("d"))).alias("h"))
    return rows.select("page_id", F.col("h.level").cast("long").alias("level"), F.col("h.text").alias("text"))


def page_paragraphs(spark, sf_dir):
    rows = _digest(spark, sf_dir, "paragraphs").select("page_id", F.posexplode(evidence.paragraphs(F.col("d"))).alias("nth", "text"))
    return rows.select("page_id", F.col("nth").cast("long").alias("nth"), "text")


def nav_links(spark, sf_dir):
    return _digest(spark, sf_dir, "links").select("page_id", _bars(evidence.navigation(F.col("d"))).alias("links"))


def internal_links(spark, sf_dir):
    return _digest(spark, sf_dir, "links").select("page_id", _bars(evidence.internal_links(F.col("d"), F.col("url"))).alias("links"))


def footer_text(spark, sf_dir):
    d = F.col("d")
    return _digest(spark, sf_dir, "footer_text", "footer_strings").select("page_id", F.substring(d["footer_text"], 1, 500).alias("footer"), evidence.copyright_notice(d).alias("copyright"))


def html_tree(spark, sf_dir):
    tags = html_nodes(_pages(spark, sf_dir))
    return tags.groupBy("tag").agg(F.count("*").alias("nodes"))


# --- contacts -----------------------------------------------------------------------


def email_extract(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    both = docs.union(_pages(spark, sf_dir).select(F.lit("pages"), "page_id", "html"))
    both = both.union(table(spark, X.EMAILS, "body string").select(F.lit("literal"), "pos", "body"))
    found = both.select("kind", "id", F.explode(F.array_distinct(emails.emails_in(F.col("body")))).alias("email"))
    return found.filter(emails.is_valid_email(F.col("email")))


def email_classify(spark, sf_dir):
    e = F.col("email")
    rows = table(spark, X.EMAILS, "email string").withColumn("category", emails.email_category(e))
    return rows.select(
        "pos", "email", "category", emails.email_confidence(F.col("category")).alias("confidence"), emails.is_system_email(e).alias("is_system"),
        emails.is_fake_email(e).alias("is_fake"), emails.looks_like_email(e).alias("looks_valid"),
    )


def email_verified(spark, sf_dir):
    rows = table(spark, X.EMAILS, "email string").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "email"))), lambda x: x["email"]).alias("e"))
    return rows.select(F.posexplode(emails.verified_emails(F.col("e"))).alias("nth", "email")).select(F.col("nth").cast("long").alias("nth"), "email")


def phone_extract(spark, sf_dir):
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(F.array_sort(F.array_distinct(contacts.phones_in(F.col("text"))))).alias("phone"))


def address_extract(spark, sf_dir):
    found = contacts.addresses_in(F.col("text"))
    return table(spark, X.TEXTS, "text string").select("pos", _bars(found).alias("addresses"), contacts.count_locations(found).cast("long").alias("locations"))


def social_links(spark, sf_dir):
    h = F.col("href")
    rows = table(spark, X.LINKS, "href string").withColumn("platform", contacts.social_platform(h))
    return rows.select(
        "pos", "platform", contacts.is_social_url(h, F.col("platform")).alias("proper"), contacts.normalise_social_url(h, F.col("platform")).alias("normalised")
    ).filter("platform IS NOT NULL")


# --- technology, features, structured data -------------------------------------------


def _markup(spark, sf_dir):
    rows = table(spark, X.MARKUP, "html string").select((-F.col("pos") - 1).alias("id"), "html")
    return _pages(spark, sf_dir).select(F.col("page_id").alias("id"), "html").union(rows)


def tech_detect(spark, sf_dir):
    t = technology.technology(F.col("html"))
    return _markup(spark, sf_dir).select("id", t["cms"].alias("cms"), *[_bars(t[c]).alias(c) for c in ("analytics", "widgets", "booking")])


def feature_flags(spark, sf_dir):
    flags = technology.features_in_markup(F.col("html"), True)
    return _markup(spark, sf_dir).select("id", *[c.alias(n) for n, c in flags.items() if n != "has_social_links"], technology.has_team_page(F.col("html")).alias("team_words"))


def jsonld_entities(spark, sf_dir):
    rows = table(spark, X.JSONLD, "block string").select("pos", F.explode(jsonld.entities(F.array("block"))).alias("e"))
    names = ("schema_type", "name", "telephone", "email", "logo")
    return rows.select("pos", *[F.col(f"e.{n}").alias(n) for n in names], F.coalesce("e.address.city", F.lit("")).alias("city"), F.size("e.opening_hours").cast("long").alias("hours"))


# --- confidence -------------------------------------------------------------------------


def confidence_score(spark, sf_dir):
    rows = table(spark, tuple(K.BASE_CONFIDENCE), "source string").select("source", F.explode(F.array(F.lit(True), F.lit(False))).alias("valid"))
    rows = rows.select("source", "valid", F.explode(F.array(F.lit(True), F.lit(False))).alias("redundant"))
    return rows.withColumn("confidence", confidence.confidence(F.col("source"), F.col("valid"), F.col("redundant")))


def merge_scores(spark, sf_dir):
    rows = spark.createDataFrame(list(X.SCORES), "g string, nth long, confidence double, source string")
    rows = rows.withColumns({"value": F.col("g"), "validation": F.lit("valid")})
    return confidence.merge_scores(rows, ("g",), "nth").select("g", "source", F.round("confidence", 2).alias("confidence"), "n_sources")


# --- sites -----------------------------------------------------------------------------


def _paragraphs(spark, sf_dir):
    rows = _digest(spark, sf_dir, "headings", "paragraphs").select(urls.site_of(F.col("url")).alias("site"), "page_id", F.size("d.headings").alias("headings"), evidence.paragraphs(F.col("d")).alias("p"))
    return rows.select("site", "page_id", "headings", F.posexplode_outer("p").alias("nth", "text"))


def site_dedupe_paragraphs(spark, sf_dir):
    rows = _paragraphs(spark, sf_dir).filter("text IS NOT NULL")
    kept = site.first_of_site(rows, F.lower("text"), ("page_id", "nth"))
    return kept.select("site", "page_id", F.col("nth").cast("long").alias("nth"), "text")


def site_content_rollup(spark, sf_dir):
    """Pages, headings and distinct paragraphs of each site."""
    d = F.col("d")
    rows = _digest(spark, sf_dir, "headings", "paragraphs").select(
        urls.site_of(F.col("url")).alias("site"), F.size(evidence.headings(d)).alias("headings"), F.posexplode_outer(evidence.paragraphs(d)).alias("nth", "text")
    )
    # one parse and one shuffle of paragraphs: a page counts with its first row, a paragraph once for its key
    first = F.coalesce("nth", F.lit(0)) == 0
    keys = rows.groupBy("site", F.lower("text").alias("key")).agg(
        F.count(F.when(first, True)).alias("pages"), F.sum(F.when(first, F.col("headings")).otherwise(0)).alias("headings"), F.count("text").alias("paragraphs"),
        F.min(F.length("text")).alias("n"),
    )
    return keys.groupBy("site").agg(
        F.sum("pages").alias("pages"), F.sum("headings").alias("headings"), F.sum("paragraphs").alias("paragraphs"), F.count("key").alias("kept"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chars"),
    )


def site_counters(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", F.struct("url", ranking.evidence_page_type(F.col("url"), F.lit("")).alias("page_type")).alias("e"))
    return site.counters(pages.withColumn("site", urls.site_of(F.col("e.url"))))


def site_features_or(spark, sf_dir):
    flags = technology.features_in_markup(F.col("html"), True)
    rows = _pages(spark, sf_dir).select(urls.site_of(F.col("url")).alias("site"), F.struct(*[c.alias(n) for n, c in flags.items() if n != "has_social_links"]).alias("features"))
    return technology.aggregate_features(rows, ("site",))


def page_evidence(spark, sf_dir):
    return as_json(evidence.page_evidence(_all_pages(spark, sf_dir)))


def page_business(spark, sf_dir):
    return as_json(business.page_business(_all_pages(spark, sf_dir)))


def site_evidence(spark, sf_dir):
    return as_json(analyze.analyze_sites(_all_pages(spark, sf_dir), analyze.Settings(debug=True)))


def site_selected(spark, sf_dir):
    return as_json(analyze.analyze_sites(_all_pages(spark, sf_dir), select=True))


def site_business(spark, sf_dir):
    found = analyze.business_sites(_all_pages(spark, sf_dir))
    return as_json(found.withColumn("discovery", F.col("discovery").dropFields("last_updated")))


def page_failures(spark, sf_dir):
    pages = read_pages(ship(spark), f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return analyze.failures(pages.union(spark.createDataFrame([(-1, "https://acme.io/a", None), (-2, "https://acme.io/b", "")], "page_id long, url string, html string")))


def sitemap_urls(spark, sf_dir):
    return sitemaps.walk(table(ship(spark), X.SITES, "site string, root string").drop("pos"), table(spark, X.SITEMAPS, "url string, body string").drop("pos"))


QUERIES = {
    f.__name__: f
    for f in (
        url_canonical, url_strip_tracking, url_root_domain, url_same_domain, url_depth, url_slug, url_dedupe, url_validate, page_score, page_topk_per_site,
        page_type, classify_page, candidate_urls, page_title_lang, page_headings, page_paragraphs, nav_links, internal_links, footer_text, html_tree,
        email_extract, email_classify, email_verified, phone_extract, address_extract, social_links, tech_detect, feature_flags, jsonld_entities,
        confidence_score, merge_scores, site_dedupe_paragraphs, site_content_rollup, site_counters, site_features_or, page_evidence, page_business, site_evidence, site_selected, site_business, page_failures, sitemap_urls,
    )
}

# --- SQL ---------------------------------------------------------------------------------

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(u: str, i: int) -> str:
    return f"regexp_extract({u}, '{_PARTS}', {i})"


def _path(u: str) -> str:
    return f"regexp_replace({_part(u, 3)}, ';[^/]*$', '')"


def _full(u: str) -> str:
    return f"CASE WHEN starts_with(trim({u}), 'http://') OR starts_with(trim({u}), 'https://') THEN trim({u}) ELSE 'https://' || trim({u}) END"


def _no_slash(c: str) -> str:
    return f"regexp_replace({c}, '/+$', '')"


def _host(u: str) -> str:
    return f"regexp_replace(lower({_part(u, 2)}), '^www\\.(.*\\..*)$', '\\1')"


def _slug(u: str) -> str:
    ignored = ", ".join(f"'{w}'" for w in K.SLUG_IGNORE)
    return f"list_filter(string_split_regex(lower({_path(u)}), '[/-]'), lambda w: length(w) > 1 AND w NOT IN ({ignored}))"


def _any(c: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"


def _decode(c: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c



_IDS = f"SELECT page_id AS id, url FROM pages UNION ALL SELECT -pos - 1, url FROM {values(X.URLS, 'url string')}"
_MARKS = f"SELECT page_id AS id, html FROM pages UNION ALL SELECT -pos - 1, html FROM {values(X.MARKUP, 'html string')}"
_KEYWORDS = "(VALUES " + ", ".join(
    f"({i}, '{t}', '{w}')" for i, (t, words) in enumerate(K.PAGE_TYPE_KEYWORDS.items()) for w in words
) + ") AS k(ord, page_type, word)"
_SCORES = "(VALUES " + ", ".join(f"('{t}', {s})" for t, s in K.PAGE_TYPE_SCORES.items()) + ") AS s(page_type, base)"


def _scored(source: str) -> str:
    """page_type, confidence, score for rows (key..., url) of ``source``, which has a unique ``rid``."""
    return f"""
      slugs AS (SELECT rid, {_slug('url')} AS slug FROM {source}),
      hits AS (SELECT rid, ord, page_type, least(count(DISTINCT word), 2) AS n FROM slugs JOIN {_KEYWORDS} ON list_contains(slug, word) GROUP BY ALL),
      best AS (SELECT rid, arg_min(page_type, ord - 1000 * n) AS page_type, max(n) AS n FROM hits GROUP BY rid),
      typed AS (
        SELECT slugs.rid, CASE WHEN len(slug) = 0 THEN 'homepage' ELSE coalesce(best.page_type, 'unknown') END AS page_type,
          CASE WHEN len(slug) = 0 THEN 0.8 WHEN n IS NULL THEN 0.0 ELSE least(0.99, 0.5 + n * 0.25) END::DOUBLE AS confidence
        FROM slugs LEFT JOIN best USING (rid)),
      scored AS (SELECT rid, page_type, confidence, coalesce(base, 0)::DOUBLE AS score FROM typed LEFT JOIN {_SCORES} USING (page_type))"""


_P = r"""SELECT page_id, url, generate_subscripts(p, 1) AS raw_at, unnest(p) AS raw FROM (SELECT page_id, url, regexp_extract_all(html, '<p>(?:<b>)?([^<]*)', 1) AS p FROM pages)"""
_PARAGRAPHS = f"""
  decoded AS (SELECT page_id, url, raw_at, trim({_decode('raw')}) AS text FROM ({_P})),
  fine AS (
    SELECT page_id, url, text, min(raw_at) AS raw_at FROM decoded
    WHERE length(text) BETWEEN 50 AND 800 AND NOT {_any('lower(text)', K.PARAGRAPH_BOILERPLATE)} GROUP BY page_id, url, text),
  paragraphs AS (SELECT page_id, {_host('url')} AS site, row_number() OVER (PARTITION BY page_id ORDER BY raw_at) - 1 AS nth, text FROM fine)"""
_BODY = "regexp_replace(html, '(?s)<script>.*?</script>', '', 'g')"
_NAV = f"regexp_extract_all(regexp_extract({_BODY}, '(?s)<nav>(.*?)</nav>', 1), '<a href=\"([^\"]*)\"', 1)"
_ROOT = f"{_part('url', 1)} || '://' || {_part('url', 2)}"


def _hits(category: str) -> str:
    return "[" + ", ".join(
        f"CASE WHEN {_any('lower(html)', [x.lower() for x in signs])} THEN '{name}' END" for name, kind, signs in K.TECHNOLOGIES if kind == category
    ) + "]"


def _flag(name: str) -> str:
    parts = [p.replace("'", "''") for p in K.FEATURE_PATTERNS[name]]
    return " OR ".join(f"regexp_matches(lower(html), '{p}')" for p in parts)


def _category(e: str) -> str:
    tests = " ".join(f"WHEN regexp_matches(lower({e}), '{p}') THEN '{n}'" for n, p in K.EMAIL_CATEGORIES)
    return f"CASE WHEN {e} = '' THEN 'unknown' WHEN {_any(f'lower({e})', K.SYSTEM_MARKS)} THEN 'system' {tests} ELSE 'unknown' END"


_VALID = r"""regexp_matches(email, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$')
  AND length(split_part(email, '@', 1)) BETWEEN 1 AND 64 AND NOT starts_with(email, '.') AND NOT contains(split_part(email, '@', 1), '..') AND NOT contains(email, '.@')
  AND NOT regexp_matches(email, '\.(test|invalid|localhost|local|onion|arpa)$') AND NOT regexp_matches(email, '\.[0-9]+$') AND length(email) <= 254"""
_URL_TYPES = " ".join(f"WHEN {_any('lower(url)', marks)} THEN '{kind}'" for kind, marks in K.EVIDENCE_TYPE_KEYWORDS.items())
_PATH_LOW = _no_slash(_path("lower(url)"))
_EVIDENCE_TYPE = f"""CASE WHEN {_PATH_LOW} = '' THEN 'homepage' WHEN ends_with(lower(url), 'index.html') THEN 'homepage'
  WHEN {_any('lower(url)', K.PROFILE_MARKS)} AND len(list_filter(string_split({_PATH_LOW}, '/'), lambda s: s <> '')) >= 2 THEN 'team_profile' {_URL_TYPES} ELSE 'unknown' END"""
_SITES = values(X.SITES, "site string, root string")
_WALK = rf"""
  edges AS (SELECT DISTINCT url AS parent, unnest(regexp_extract_all(body, '<loc>\s*([^<]*[^<\s])\s*</loc>', 1)) AS child FROM {values(X.SITEMAPS, 'url string, body string')}),
  maps AS (
    SELECT site, unnest([regexp_replace(root, '/+$', '') || '/sitemap.xml', regexp_replace(root, '/+$', '') || '/sitemap_index.xml']) AS parent FROM {_SITES}
    UNION SELECT m.site, e.child FROM maps m JOIN edges e USING (parent) WHERE ends_with(e.child, '.xml')),
  walked AS (SELECT DISTINCT m.site, e.child AS url FROM maps m JOIN edges e USING (parent) WHERE NOT ends_with(e.child, '.xml'))"""


def _content(kind: str) -> str:
    weigh = lambda test: " + ".join(f"CASE WHEN {test(n)} THEN {w} ELSE 0 END" for n, w in K.SIGNAL_WEIGHTS.items())
    total = weigh(lambda n: f"{n} <> ''")
    hit = weigh(lambda n: f"{n} <> '' AND {_any(f'lower({n})', K.CONTENT_KEYWORDS[kind])}")
    return f"CASE WHEN {total} > 0 THEN least(0.99, ({hit})::DOUBLE / ({total})) ELSE 0 END"


_TYPES = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(K.CONTENT_KEYWORDS)) + ") AS c(ord, kind)"
_CONTENT = "CASE kind " + " ".join(f"WHEN '{t}' THEN {_content(t)}" for t in K.CONTENT_KEYWORDS) + " END"

_SCORED_PAGES = f"src AS (SELECT page_id AS rid, url FROM pages), {_scored('src').strip()}"


def _classify_sql(src: str, before: str = "") -> str:
    """Rows (rid, url, page_type, confidence, url_score, content_score) of ``src``, rows (rid, url, title, h1, meta_description, body_text)."""
    return f"""
      WITH {before} src AS ({src}), {_scored('src')},
      each AS (SELECT rid, url, page_type, confidence, ord, kind, {_CONTENT} AS content FROM src JOIN scored USING (rid), {_TYPES}),
      top AS (SELECT rid, any_value(url) AS url, any_value(page_type) AS page_type, any_value(confidence) AS u, max(content) FILTER (WHERE kind = page_type) AS own,
          max(content * 0.4 + CASE WHEN kind = page_type THEN confidence * 0.6 ELSE 0 END) AS best,
          arg_max(kind, (content * 0.4 + CASE WHEN kind = page_type THEN confidence * 0.6 ELSE 0 END) - ord * 1e-9) AS kind,
          arg_max(content, (content * 0.4 + CASE WHEN kind = page_type THEN confidence * 0.6 ELSE 0 END) - ord * 1e-9) AS content FROM each GROUP BY rid),
      fin AS (SELECT rid, url, u, CASE WHEN best > u THEN kind ELSE page_type END AS page_type, CASE WHEN best > u THEN content ELSE coalesce(own, 0) END AS c FROM top)
      SELECT rid, url, page_type, round(least(0.99, u * 0.5 + c * 0.5), 6) AS confidence, round(u, 6) AS url_score, round(c, 6) AS content_score FROM fin"""


ORACLE_SQL = {
    "url_canonical": f"SELECT id, 'https://' || lower({_part('f', 2)}) || {_no_slash(_path('f'))} AS canonical FROM (SELECT id, {_full('url')} AS f FROM ({_IDS}))",
    "url_strip_tracking": f"""
      WITH f AS (SELECT id, {_full('url')} AS f FROM ({_IDS})),
      p AS (SELECT id, f, list_filter(list_transform(list_filter(string_split({_part('f', 4)}, '&'), lambda p: contains(p, '=')),
          lambda p: {{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_replace(p, '^[^=]*=', ''), '+', ' '))}}),
          lambda p: p.v <> '' AND lower(p.k) NOT IN ({', '.join(f"'{x}'" for x in K.TRACKING_PARAMS)})) AS pairs FROM f),
      k AS (SELECT *, list_transform(pairs, lambda p: p.k) AS ks FROM p),
      e AS (SELECT id, f, flatten(list_transform(list_filter(ks, lambda x, i: list_position(ks, x) = i), lambda x: list_filter(pairs, lambda p: p.k = x))) AS g FROM k),
      q AS (SELECT id, f, list_aggregate(list_transform(g, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), 'string_agg', '&') AS q FROM e)
      SELECT id, lower({_part('f', 1)}) || '://' || lower({_part('f', 2)}) || {_no_slash(_path('f'))} || CASE WHEN q IS NULL OR q = '' THEN '' ELSE '?' || q END AS stripped FROM q""",
    "url_root_domain": f"SELECT id, coalesce(nullif(lower({_part('url', 1)}), ''), 'https') || '://' || {_host('url')} AS root, lower({_part('url', 2)}) AS domain, {_host('url')} AS site FROM ({_IDS})",
    "url_same_domain": f"SELECT id, coalesce(nullif(lower({_part('url', 1)}), ''), 'https') || '://' || {_host('url')} = 'https://acme.io' AS same FROM ({_IDS})",
    "url_depth": f"""SELECT id, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, '/')) END::BIGINT AS depth FROM (SELECT id, trim({_path('url')}, '/') AS p FROM ({_IDS}))""",
    "url_slug": f"SELECT id, coalesce(list_aggregate({_slug('url')}, 'string_agg', '|'), '') AS slug FROM ({_IDS})",
    "url_validate": f"""
      WITH h AS (SELECT url, regexp_replace(regexp_replace(lower({_part('url', 2)}), '^.*@', ''), ':.*$', '') AS host FROM {values(X.HOSTS, 'url string')}),
      l AS (SELECT *, string_split(host, '.') AS x FROM h),
      s AS (SELECT *, CASE WHEN regexp_matches(x[-1], '^[a-z]{{2}}$') AND len(x) > 1 AND x[-2] IN ({', '.join(f"'{w}'" for w in K.SECOND_LEVEL)}) THEN 2
        WHEN regexp_matches(x[-1], '^[a-z]{{2}}$') OR x[-1] IN ({', '.join(f"'{w}'" for w in K.GENERIC_SUFFIXES)}) THEN 1 ELSE 0 END AS n FROM l),
      m AS (SELECT url, CASE WHEN host IN ('localhost', '127.0.0.1', '::1') THEN 'Localhost URLs are not allowed: ' || host
        WHEN regexp_matches(host, '^(\\d{{1,3}}\\.){{3}}\\d{{1,3}}$') THEN 'IP address URLs are not allowed: ' || host
        WHEN n = 0 OR len(x) <= n OR list_contains(x, '') THEN 'Could not extract a valid domain from URL: ' || url ELSE '' END AS message FROM s)
      SELECT url, message = '' AS valid, message FROM m""",
    "page_score": f"WITH src AS (SELECT id AS rid, url FROM ({_IDS})), {_scored('src')} SELECT rid AS id, page_type, confidence, score FROM scored",
    "page_topk_per_site": f"""
      WITH src AS (SELECT site, path, 'https://' || site || path AS url, 'https://' || site || path AS rid FROM (SELECT DISTINCT {_host('url')} AS site FROM pages), (SELECT path FROM {values(X.PATHS, 'path string')})), {_scored('src')}
      SELECT site, url, score, page_type, rank FROM (SELECT site, url, score, page_type, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS rank FROM src JOIN scored USING (rid) WHERE score > 0) WHERE rank <= 6""",
    "page_type": f"SELECT id, {_EVIDENCE_TYPE} AS page_type FROM ({_IDS})",
    "classify_page": "SELECT url, page_type, confidence, url_score, content_score FROM ("
    + _classify_sql(f"SELECT pos AS rid, * FROM {values(X.SIGNALS, 'url string, title string, h1 string, meta_description string, body_text string')}") + ")",
    "candidate_urls": f"""
      WITH RECURSIVE {_WALK}, f AS (SELECT {_full('url')} AS f FROM ({_IDS}))
      SELECT 'https://' || lower({_part('f', 2)}) || {_no_slash(_path('f'))} AS url FROM f UNION SELECT url FROM walked""",
    "page_title_lang": f"""
      SELECT page_id, trim({_decode("regexp_extract(html, '<title>([^<]*)', 1)")}) AS title, trim({_decode("regexp_extract(html, '<h1>([^<]*)', 1)")}) AS shown,
        regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""",
    "page_headings": f"""
      SELECT page_id, 1::BIGINT AS level, text FROM (SELECT page_id, trim({_decode('raw')}) AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)', 1)) AS raw FROM pages))
      WHERE length(text) > 2 AND NOT {_any('lower(text)', K.HEADING_BOILERPLATE)}""",
    "page_paragraphs": f"WITH {_PARAGRAPHS} SELECT page_id, nth, text FROM paragraphs",
    "nav_links": f"""
      WITH n AS (SELECT page_id, {_ROOT} AS root, list_filter({_NAV}, lambda h: h <> '' AND NOT starts_with(h, '#')) AS hrefs FROM pages)
      SELECT page_id, coalesce(list_aggregate(list_transform(list_filter(hrefs, lambda h, i: list_position(hrefs, h) = i)[1:20], lambda h: root || {_decode('h')}), 'string_agg', '|'), '') AS links FROM n""",
    "internal_links": f"""
      WITH n AS (SELECT page_id, url, {_ROOT} AS root, unnest(regexp_extract_all({_BODY}, '<a href="([^"]*)"', 1)) AS h FROM pages),
      c AS (SELECT DISTINCT page_id, url, regexp_replace(regexp_replace(root || {_decode('h')}, '(?s)[?#].*$', ''), '/+$', '') AS link FROM n WHERE starts_with(h, '/'))
      SELECT p.page_id, coalesce(string_agg(link, '|' ORDER BY link) FILTER (WHERE link <> regexp_replace(p.url, '/+$', '')), '') AS links FROM pages p LEFT JOIN c USING (page_id) GROUP BY p.page_id""",
    "footer_text": f"""
      SELECT page_id, substr(t, 1, 500) AS footer, CASE WHEN contains(t, '©') OR contains(lower(t), 'copyright') THEN t ELSE '' END AS copyright
      FROM (SELECT page_id, trim({_decode("regexp_extract(html, '<footer>([^<]*)', 1)")}) AS t FROM pages)""",
    "email_extract": f"""
      WITH b AS (SELECT 'documents' AS kind, doc_id AS id, text AS body FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages
        UNION ALL SELECT 'literal', pos, body FROM {values(X.EMAILS, 'body string')}),
      e AS (SELECT DISTINCT kind, id, lower(unnest(regexp_extract_all(body, '{K.EMAIL_PATTERN}'))) AS email FROM b)
      SELECT kind, id, email FROM e WHERE {_VALID}""",
    "email_classify": f"""
      SELECT pos, email, category, CASE category {' '.join(f"WHEN '{c}' THEN {v}" for c, v in K.EMAIL_CONFIDENCE.items())} END::DOUBLE AS confidence,
        email = '' OR {_any('lower(email)', K.SYSTEM_MARKS)} AS is_system, {_any('lower(email)', K.FAKE_EMAIL_MARKS)} OR regexp_matches(lower(email), '^[a-f0-9]{{32,}}@') AS is_fake,
        regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') AS looks_valid
      FROM (SELECT pos, email, {_category('email')} AS category FROM {values(X.EMAILS, 'email string')})""",
    "email_verified": f"""
      WITH c AS (SELECT min(pos) AS pos, email, {_category('email')} AS category FROM {values(X.EMAILS, 'email string')} WHERE email <> '' GROUP BY email)
      SELECT row_number() OVER (ORDER BY list_position(['business', 'support', 'sales', 'marketing'], category), pos) - 1 AS nth, email FROM c
      WHERE category IN ('business', 'support', 'sales', 'marketing')""",
    "phone_extract": r"""
      SELECT DISTINCT doc_id, phone FROM (SELECT doc_id, '+' || regexp_replace(unnest(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')), '[^0-9]', '', 'g') AS phone FROM documents)
      WHERE regexp_matches(phone, '^\+1[2-9][0-9]{2}[2-9][0-9]{6}$')""",
    "address_extract": f"""
      WITH g AS (SELECT pos, regexp_extract_all(text, '{K.ADDRESS_PATTERN}', 1) AS a, regexp_extract_all(text, '{K.ADDRESS_PATTERN}', 2) AS b,
          regexp_extract_all(text, '{K.ADDRESS_PATTERN}', 3) AS c, regexp_extract_all(text, '{K.ADDRESS_PATTERN}', 4) AS d FROM {values(X.TEXTS, 'text string')}),
      r AS (SELECT pos, unnest(range(1, len(a) + 1)) AS i, a, b, c, d FROM g),
      o AS (SELECT pos, i, trim(a[i]) || ', ' || trim(b[i]) || ', ' || c[i] || ' ' || d[i] AS address, trim(b[i]) AS city FROM r WHERE c[i] IN ({', '.join(f"'{s}'" for s in K.US_STATES)}))
      SELECT g.pos, coalesce(string_agg(address, '|' ORDER BY i), '') AS addresses, count(DISTINCT city) AS locations FROM g LEFT JOIN o USING (pos) GROUP BY g.pos""",
    "social_links": f"""
      WITH h AS (SELECT pos, href, regexp_replace(lower({_part('href', 2)}), '^[w.]+', '') AS host FROM {values(X.LINKS, 'href string')} WHERE starts_with(href, 'http')),
      p AS (SELECT pos, href, CASE {' '.join(f"WHEN host = '{d}' OR ends_with(host, '.{d}') THEN '{p}'" for d, p in K.SOCIAL_DOMAINS.items())} END AS platform FROM h)
      SELECT pos, platform, CASE platform {' '.join("WHEN '{}' THEN {}".format(p, ' OR '.join(f"regexp_matches(lower(href), '{x}')" for x in pats)) for p, pats in K.SOCIAL_PATTERNS.items())} ELSE false END AS proper,
        CASE WHEN platform = 'twitter' THEN replace(href, 'twitter.com', 'x.com') ELSE href END AS normalised FROM p WHERE platform IS NOT NULL""",
    "tech_detect": f"""
      SELECT id, coalesce(list_filter({_hits('cms')}, lambda x: x IS NOT NULL)[1], '') AS cms,
        {', '.join(f"coalesce(list_aggregate(list_filter({_hits(c)}, lambda x: x IS NOT NULL), 'string_agg', '|'), '') AS {c}" for c in ('analytics', 'widgets', 'booking'))} FROM ({_MARKS})""",
    "feature_flags": f"""
      SELECT id, {', '.join(f'({_flag(n)}) AS {n}' for n in K.FEATURE_PATTERNS)}, ({' OR '.join(f"regexp_matches(lower(html), '{p}')" for p in K.TEAM_PAGE_PATTERNS)}) AS team_words FROM ({_MARKS})""",
    "jsonld_entities": f"""
      WITH b AS (SELECT pos, CASE WHEN json_valid(block) THEN block::JSON END AS j FROM {values(X.JSONLD, 'block string')}),
      o AS (SELECT pos, j FROM b WHERE json_type(j) = 'OBJECT' UNION ALL SELECT pos, unnest(from_json(j, '["JSON"]')) FROM b WHERE json_type(j) = 'ARRAY')
      SELECT pos, j->>'$."@type"' AS schema_type, coalesce(j->>'$.name', '') AS name, coalesce(j->>'$.telephone', '') AS telephone, coalesce(j->>'$.email', '') AS email,
        coalesce(CASE json_type(j, '$.logo') WHEN 'OBJECT' THEN j->>'$.logo.url' ELSE j->>'$.logo' END, '') AS logo, coalesce(j->>'$.address.addressLocality', '') AS city,
        CASE json_type(j, '$.openingHoursSpecification') WHEN 'OBJECT' THEN 1 WHEN 'ARRAY' THEN json_array_length(j, '$.openingHoursSpecification') ELSE 0 END::BIGINT AS hours
      FROM o WHERE json_type(j) = 'OBJECT' AND json_type(j, '$."@type"') = 'VARCHAR' AND lower(j->>'$."@type"') IN ({', '.join(f"'{t}'" for t in K.SCHEMA_TYPES)})""",
    "confidence_score": f"""
      WITH b AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {v}::DOUBLE)" for s, v in K.BASE_CONFIDENCE.items())}) AS t(source, base), (VALUES (true), (false)) AS v(valid), (VALUES (true), (false)) AS r(redundant)),
      a AS (SELECT *, CASE WHEN valid THEN least(0.99, base + 0.05) ELSE greatest(0.0, base - 0.30) END AS c FROM b)
      SELECT source, valid, redundant, round(CASE WHEN redundant THEN least(0.99, c + 0.08) ELSE c END, 2) AS confidence FROM a""",
    "merge_scores": f"""
      WITH s AS (SELECT * FROM (VALUES {', '.join(f"('{g}', {p}, {c}::DOUBLE, '{s}')" for g, p, c, s in X.SCORES)}) AS t(g, nth, confidence, source)),
      m AS (SELECT g, arg_max(source, confidence - nth * 1e-9) AS source, count(*) AS n, avg(confidence) AS mean, max(confidence) AS best FROM s GROUP BY g)
      SELECT g, source, CASE WHEN n = 1 THEN best ELSE round(least(0.99, mean + least(0.1, (n - 1) * 0.03)), 2) END AS confidence, n AS n_sources FROM m""",
    "site_dedupe_paragraphs": f"""
      WITH {_PARAGRAPHS} SELECT site, page_id, nth, text FROM (SELECT *, row_number() OVER (PARTITION BY site, lower(text) ORDER BY page_id, nth) AS n FROM paragraphs) WHERE n = 1""",
    "site_content_rollup": f"""
      WITH {_PARAGRAPHS},
      once AS (SELECT site, count(*) AS kept, sum(n)::BIGINT AS chars FROM (SELECT site, lower(text) AS k, min(length(text)) AS n FROM paragraphs GROUP BY ALL) GROUP BY site),
      heads AS (SELECT page_id, count(*) AS h FROM (SELECT page_id, trim({_decode('raw')}) AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)', 1)) AS raw FROM pages))
        WHERE length(text) > 2 AND NOT {_any('lower(text)', K.HEADING_BOILERPLATE)} GROUP BY page_id),
      per AS (SELECT page_id, count(*) AS p FROM paragraphs GROUP BY page_id)
      SELECT s.site, pages, headings, paragraphs, coalesce(kept, 0) AS kept, coalesce(chars, 0) AS chars FROM
        (SELECT {_host('url')} AS site, count(*) AS pages, sum(coalesce(h, 0))::BIGINT AS headings, sum(coalesce(p, 0))::BIGINT AS paragraphs
         FROM pages LEFT JOIN heads USING (page_id) LEFT JOIN per USING (page_id) GROUP BY 1) s LEFT JOIN once USING (site)""",
    "site_counters": f"""
      WITH t AS (SELECT {_host('url')} AS site, {_EVIDENCE_TYPE} AS page_type FROM pages)
      SELECT site, count(*) AS pages_scanned, count(DISTINCT page_type) FILTER (WHERE page_type NOT IN ('unknown', 'team_profile')) + count(*) FILTER (WHERE page_type IN ('unknown', 'team_profile')) AS pages_extracted FROM t GROUP BY site""",
    "site_features_or": f"SELECT {_host('url')} AS site, {', '.join(f'bool_or({_flag(n)}) AS {n}' for n in K.FEATURE_PATTERNS)} FROM pages GROUP BY 1",
    "page_failures": """
      SELECT page_id, url, false AS success, 'no content' AS error, '' AS details FROM (SELECT page_id, url, html FROM pages UNION ALL SELECT -1, 'https://acme.io/a', NULL UNION ALL SELECT -2, 'https://acme.io/b', '')
      WHERE html IS NULL OR html = ''""",
    "sitemap_urls": f"WITH RECURSIVE {_WALK} SELECT site, url FROM walked",
}
ORACLE_SQL["url_dedupe"] = (
    ORACLE_SQL["url_strip_tracking"].replace("WITH f AS", "WITH f AS", 1).rsplit("SELECT id, lower(", 1)[0].rstrip()
    + ", stripped AS (SELECT id, lower(" + ORACLE_SQL["url_strip_tracking"].rsplit("SELECT id, lower(", 1)[1]
    + f") SELECT i.id, i.url FROM ({_IDS}) i JOIN (SELECT stripped, min(id) AS id FROM stripped GROUP BY stripped) s USING (id)"
)
