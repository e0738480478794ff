"""Page types and scores, from URLs and from content."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTENT_KEYWORDS, EVIDENCE_TYPE_KEYWORDS, PAGE_TYPE_KEYWORDS, PAGE_TYPE_SCORES, PROFILE_MARKS, SIGNAL_WEIGHTS
from .text import has_any, let, strings
from .urls import path_of, slug_words


def url_page_type(url: Column) -> Column:
    """struct(type, confidence) by the words of the path: the type with most keywords, the first of equals."""
    return let(slug_words(url), _type_of_slug)


def _type_of_slug(slug: Column) -> Column:
    found = F.array(*[
        F.struct(F.least(F.size(F.array_intersect(slug, strings(words))), F.lit(2)).alias("n"),  # two matches or more are equally sure
                 F.lit(-i).alias("order"), F.lit(name).alias("type"))
        for i, (name, words) in enumerate(PAGE_TYPE_KEYWORDS.items())
    ])
    home = F.size(slug) == 0
    sure = lambda best: F.least(F.lit(0.99), F.lit(0.5) + best["n"] * F.lit(0.25))
    return let(
        F.array_max(found),
        lambda best: F.struct(
            F.when(home, "homepage").when(best["n"] == 0, "unknown").otherwise(best["type"]).alias("type"),
            F.when(home, 0.8).when(best["n"] == 0, 0.0).otherwise(sure(best)).alias("confidence"),
        ),
    )


def score_of_type(kind: Column, confidence: Column) -> Column:
    """Score of a page type: negative ones stay, halved below a confidence of 0.6, at most 100."""
    table = F.create_map(*[F.lit(x) for k, v in PAGE_TYPE_SCORES.items() for x in (k, float(v))])
    halved = F.coalesce(F.try_element_at(table, kind), F.lit(0.0)) * F.when(confidence < 0.6, 0.5).otherwise(1.0)
    return F.least(halved, F.lit(100.0))


def page_score(url: Column) -> Column:
    """struct(score, page_type, confidence)."""
    return let(
        url_page_type(url),
        lambda t: F.struct(score_of_type(t["type"], t["confidence"]).alias("score"), t["type"].alias("page_type"), t["confidence"].alias("confidence")),
    )


def rank_pages(df: DataFrame, k: int = 10, site: str = "site", url: str = "url") -> DataFrame:
    """The ``k`` best pages of each site with a score above 0, with ``rank``; ties to the smaller URL."""
    scored = df.withColumn("__s", page_score(F.col(url)))
    scored = scored.withColumns({"score": F.col("__s.score"), "page_type": F.col("__s.page_type")}).drop("__s").filter("score > 0")
    order = Window.partitionBy(site).orderBy(F.desc("score"), url)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def content_score(kind: str, signals: dict[str, Column]) -> Column:
    """Share of the weight of the signals, among those that are not empty, that hold a keyword of the type; 0.99 at most."""
    if kind not in CONTENT_KEYWORDS:
        return F.lit(0.0)
    weigh = lambda test: reduce(add, [F.when(test(s), F.lit(SIGNAL_WEIGHTS[n])).otherwise(0.0) for n, s in signals.items()])
    total = weigh(lambda s: s != "")
    hit = weigh(lambda s: (s != "") & has_any(s, CONTENT_KEYWORDS[kind]))
    return F.when(total > 0, F.least(F.lit(0.99), hit / total)).otherwise(0.0)


def classify(url: Column, signals: dict[str, Column]) -> Column:
    """struct(type, confidence, url_score, content_score): URL and content weighed 0.6 to 0.4; a type beats the URL's only if it is above it."""
    # the signals are bound once: each is looked through for every keyword
    return let(F.struct(*[s.alias(n) for n, s in signals.items()]), lambda s: _classify(url, {n: s[n] for n in signals}))


def _classify(url: Column, signals: dict[str, Column]) -> Column:
    contents = F.array(*[
        F.struct(F.lit(-i).alias("order"), F.lit(kind).alias("type"), content_score(kind, signals).alias("content")) for i, kind in enumerate(CONTENT_KEYWORDS)
    ])

    def combined(t: Column) -> Column:
        return F.transform(
            contents,
            lambda x: F.struct(
                (F.when(t["type"] == x["type"], t["confidence"] * 0.6).otherwise(0.0) + x["content"] * 0.4).alias("both"),
                x["order"].alias("order"), x["type"].alias("type"), x["content"].alias("content"),
            ),
        )

    def decided(t: Column, scores: Column) -> Column:
        best, own = F.array_max(scores), F.get(F.filter(scores, lambda x: x["type"] == t["type"]), F.lit(0))
        return let(
            F.struct(best.alias("best"), F.coalesce(own["content"], F.lit(0.0)).alias("own")),
            lambda b: F.when(b["best"]["both"] > t["confidence"], F.struct(b["best"]["type"].alias("type"), b["best"]["content"].alias("content"))).otherwise(
                F.struct(t["type"].alias("type"), b["own"].alias("content"))
            ),
        )

    def result(t: Column, x: Column) -> Column:
        sure = F.greatest(F.lit(0.0), F.least(F.lit(0.99), t["confidence"] * 0.5 + x["content"] * 0.5))
        return F.struct(x["type"].alias("type"), sure.alias("confidence"), t["confidence"].alias("url_score"), x["content"].alias("content_score"))

    return let(url_page_type(url), lambda t: let(let(combined(t), lambda s: decided(t, s)), lambda x: result(t, x)))


def evidence_page_type(url: Column, text: Column) -> Column:
    """Type of an evidence page: by the path, then by substrings of the whole URL in order, then by the text of a FAQ."""
    low = F.lower(url)
    path = F.regexp_replace(path_of(low), "/+$", "")
    deep = F.size(F.filter(F.split(path, "/", -1), lambda s: s != "")) >= 2
    count = lambda c, w: (F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w)
    faq = lambda words: words.contains("faq") & (count(words, "q:") + count(words, "question") > 5)
    c = F.when(path == "", "homepage").when(low.endswith("index.html"), "homepage").when(has_any(low, PROFILE_MARKS) & deep, "team_profile")
    for kind, marks in EVIDENCE_TYPE_KEYWORDS.items():
        c = c.when(has_any(low, marks), kind)
    return c.when(let(F.lower(F.coalesce(text, F.lit(""))), faq), "faq").otherwise("unknown")
