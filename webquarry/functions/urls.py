"""URL expressions: all of them plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GENERIC_SUFFIXES, SECOND_LEVEL, SLUG_IGNORE, TRACKING_PARAMS
from .text import let, strip

#: scheme, authority, path, query, fragment
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def path_of(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(part(url, 3), ";[^/]*$", "")


def _with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))


def _rstrip_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def canonical_url(url: Column) -> Column:
    """https, lower-case authority, path without trailing slashes; no parameters, query or fragment."""
    return let(
        _with_scheme(strip(url)), lambda full: F.concat(F.lit("https://"), F.lower(part(full, 2)), _rstrip_slash(path_of(full)))
    )


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strip_tracking(url: Column) -> Column:
    """Scheme and authority in lower case, no trailing slash, no fragment, no tracking or blank parameters; repeated keys stand together."""
    def essential(query: Column) -> Column:
        pairs = F.transform(
            F.filter(F.split(query, "&", -1), lambda p: p.contains("=")),
            lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("v")),
        )
        return F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(*TRACKING_PARAMS))

    def grouped(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)))

    def rebuilt(full: Column) -> Column:
        params = F.transform(let(essential(part(full, 4)), grouped), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))
        query = F.regexp_replace(F.concat(F.lit("?"), F.array_join(params, "&")), r"^\?$", "")
        return F.concat(F.lower(part(full, 1)), F.lit("://"), F.lower(part(full, 2)), _rstrip_slash(path_of(full)), query)

    bare = lambda whole: F.when(whole.endswith("/") & ~whole.endswith("://"), _rstrip_slash(whole)).otherwise(whole)
    return F.when(url == "", F.lit("")).otherwise(let(let(_with_scheme(strip(url)), rebuilt), bare))


def domain_name(url: Column) -> Column:
    return F.lower(part(url, 2))


def root_domain(url: Column) -> Column:
    """scheme://authority, without a leading ``www.`` if a dot remains."""
    scheme = F.lower(part(url, 1))
    bare = F.regexp_replace(domain_name(url), r"^www\.(?=.*\.)", "")
    return F.concat(F.when(scheme == "", F.lit("https")).otherwise(scheme), F.lit("://"), bare)


def site_of(url: Column) -> Column:
    """The key of a site: the host of its root domain, so that http and https are one."""
    return F.regexp_replace(root_domain(url), "^[^:]*://", "")


def same_domain(a: Column, b: Column) -> Column:
    return root_domain(a) == root_domain(b)


def path_depth(url: Column) -> Column:
    """Number of segments of the path between its outer slashes."""
    path = F.regexp_replace(_rstrip_slash(path_of(url)), "^/+", "")
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "/", -1)))


def slug_words(url: Column) -> Column:
    """Words of the path: split at slashes and hyphens, of two characters or more, without the ignored ones."""
    words = F.split(F.lower(path_of(url)), "[/-]", -1)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*SLUG_IGNORE))


def lstripped_www(host: Column) -> Column:
    """Without any leading ``w`` and ``.`` (not the prefix "www." alone)."""
    return F.regexp_replace(host, r"^[w.]+", "")


def host_of(url: Column) -> Column:
    """Authority without user and port, lower case, without the brackets of an IPv6 address."""
    bare = F.regexp_replace(domain_name(url), "^.*@", "")
    return F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, ":.*$", ""))


def validate_url(url: Column) -> Column:
    """struct(valid, message): no loopback, no bare IPv4, a registered domain below a known suffix (documented subset)."""
    return let(host_of(url), lambda host: _checked(host, url))


def _checked(host: Column, url: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    last, second = F.element_at(labels, -1), F.when(F.size(labels) > 1, F.element_at(labels, -2)).otherwise("")
    country = last.rlike("^[a-z]{2}$")
    suffix = F.when(country & second.isin(*SECOND_LEVEL), F.lit(2)).when(country | last.isin(*GENERIC_SUFFIXES), F.lit(1)).otherwise(0)
    registered = (suffix > 0) & (F.size(labels) > suffix) & ~F.exists(labels, lambda x: x == "")
    message = (
        F.when(host.isin("localhost", "127.0.0.1", "::1"), F.concat(F.lit("Localhost URLs are not allowed: "), host))
        .when(host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), F.concat(F.lit("IP address URLs are not allowed: "), host))
        .when(~registered, F.concat(F.lit("Could not extract a valid domain from URL: "), url)).otherwise("")
    )
    return let(message, lambda m: F.struct((m == "").alias("valid"), m.alias("message")))


def requests(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of rows with a ``url``: stripped, canonical, validated; rejects say why."""
    seen = sites.withColumn("url", strip(F.coalesce("url", F.lit(""))))
    seen = seen.withColumn("canonical", canonical_url(F.col("url"))).withColumn("check", validate_url(F.col("canonical")))
    error = F.when(F.col("url") == "", F.lit("url must not be empty")).otherwise(F.col("check.message"))
    seen = seen.withColumn("error", error).drop("check")
    return seen.filter("error = ''").drop("error"), seen.filter("error <> ''")


def deduplicate_urls(df: DataFrame, url: str = "url", order: tuple[str, ...] = ("pos",), within: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose URL, tracking stripped, no row before them has (within a group, if ``within`` names one)."""
    key = strip_tracking(F.col(url))
    first = F.min(F.struct(*order)).alias("__first")
    keyed = df.withColumn("__key", key)
    firsts = keyed.groupBy("__key", *within).agg(first)
    joined = keyed.join(firsts, ["__key", *within]).filter(F.struct(*order) == F.col("__first"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns])
