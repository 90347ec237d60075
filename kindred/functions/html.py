"""Image candidates in HTML as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.strings import html_attribute, resolve_url

# Where pages keep their logo, as CSS selectors.
SELECTORS = (
    'img[alt*="logo" i]', 'img[src*="logo" i]', 'img[class*="logo" i]', 'img[id*="logo" i]', ".logo img", "#logo img", "header img",
    ".header img", ".navbar img", ".brand img", ".site-logo img", ".header-logo img", ".navbar-brand img",
)
# The patterns of each strategy; dots match line ends, letters in either case.
JSON_LD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
AREA = r"(?is)<(?:header|nav)[^>]*>.*?</(?:header|nav)>"
IMG = r"(?is)<img[^>]*>"
HINT = r"(?i)(?:logo|brand|site-logo|company-logo)"
HOME_LINK = r"(?is)<a[^>]*href=[\"'](?:/|index|home)[^\"']*[\"'][^>]*>.*?</a>"
IMG_SRC = r"(?i)<img[^>]*src=[\"']([^\"']+)[\"'][^>]*>"
TOUCH_LINK = r"(?i)<link[^>]*rel=[\"'][^\"']*apple-touch-icon[^\"']*[\"'][^>]*>"
ICON_LINK = r"(?i)<link[^>]*rel=[\"'][^\"']*icon[^\"']*[\"'][^>]*>"
ANCHOR = r"(?is)<a\s[^>]*>"
TOP = 10

CANDIDATE = "array<struct<method:string,url:string,priority:int>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _as(urls: Column, method: str, priority: int) -> Column:
    known = F.filter(urls, lambda u: u.isNotNull() & (u != ""))
    return F.transform(known, lambda u: F.struct(F.lit(method).alias("method"), u.alias("url"), F.lit(priority).alias("priority"))).cast(CANDIDATE)


def json_ld_logos(html: Column) -> Column:
    """``logo`` or ``logo.url`` of each Organization or Brand, in single objects and lists; bad JSON is skipped."""
    item = "struct<`@type`:string,logo:string>"
    logo = lambda x: F.when(x["logo"].rlike(r"^\s*\{"), F.get_json_object(x["logo"], "$.url")).otherwise(x["logo"])
    items = lambda s: F.when(F.trim(s).startswith("["), F.from_json(s, f"array<{item}>")).otherwise(F.array(F.from_json(s, item)))
    found = F.flatten(F.transform(_all(html, JSON_LD, 1), lambda s: F.coalesce(items(s), F.array().cast(f"array<{item}>"))))
    return F.transform(F.filter(found, lambda x: x["@type"].isin("Organization", "Brand") & x["logo"].isNotNull()), logo)


def strategies(html: Column) -> list[Column]:
    """The candidates of each strategy in order of priority, URLs as they stand in the page."""
    areas = F.flatten(F.transform(_all(html, AREA), lambda a: _all(a, IMG)))
    hinted = F.filter(areas, lambda t: t.rlike(HINT))
    home = F.transform(_all(html, HOME_LINK), lambda a: F.regexp_extract(a, IMG_SRC, 1))
    href = lambda p: F.transform(_all(html, p), lambda t: html_attribute(t, "href"))
    return [
        _as(json_ld_logos(html), "json-ld", 1),
        _as(F.transform(hinted, lambda t: html_attribute(t, "src")), "header-nav", 2),
        _as(home, "homepage-link", 3),
        _as(href(TOUCH_LINK), "apple-touch-icon", 4),
        _as(F.filter(href(ICON_LINK), lambda u: ~u.endswith(".ico")), "favicon", 5),
    ]


def _first_of_each(found: Column) -> Column:
    """The first candidate of every URL, in order."""
    return F.aggregate(found, F.array().cast(CANDIDATE), lambda acc, x: F.when(F.exists(acc, lambda y: y["url"] == x["url"]), acc).otherwise(F.array_append(acc, x)))


def candidates(html: Column, base: Column, top: int = TOP) -> Column:
    """F16: all strategies by priority, made absolute, each URL once, the first ``top``."""
    found = F.concat(*strategies(html))
    absolute = F.transform(found, lambda c: F.struct(c["method"].alias("method"), resolve_url(c["url"], base).alias("url"), c["priority"].alias("priority")).cast(CANDIDATE[6:-1]))
    return F.slice(_first_of_each(absolute), 1, top)


def hinted_images(html: Column) -> Column:
    """F15, fourth strategy: any image whose id, class, alt or src speaks of a logo."""
    speaks = lambda t: F.exists(F.array(*[html_attribute(t, a) for a in ("id", "class", "alt", "src")]), lambda v: F.coalesce(v.rlike(HINT), F.lit(False)))
    return _as(F.transform(F.filter(_all(html, IMG), speaks), lambda t: html_attribute(t, "src")), "logo-hints", 4)


def candidates_full(html: Column, base: Column) -> Column:
    """six strategies in order (hinted images before the icons), nothing left out or merged."""
    s = strategies(html)
    icons = _as(F.transform(_all(html, ICON_LINK), lambda t: html_attribute(t, "href")), "favicon", 6)
    touch = F.transform(s[3], lambda c: F.struct(c["method"].alias("method"), c["url"].alias("url"), F.lit(5).alias("priority"))).cast(CANDIDATE)
    found = F.concat(s[0], s[1], s[2], hinted_images(html), touch, icons)
    return F.transform(found, lambda c: F.struct(c["method"].alias("method"), resolve_url(c["url"], base).alias("url"), c["priority"].alias("priority")))


# The quick version's patterns.
QUICK_JSON = r"\"logo\"[^}]*?\"(?:url\")?:\s*\"([^\"]+)\""
QUICK = (
    r"(?is)<(?:header|nav)[^>]*>.*?<img[^>]*src=[\"']([^\"']*logo[^\"']*)[\"'][^>]*>.*?</(?:header|nav)>",
    r"(?is)<img[^>]*(?:class|id|alt)=\"[^\"]*logo[^\"]*\"[^>]*src=[\"']([^\"']+)[\"']",
    r"(?is)<a[^>]*href=[\"'](?:/|index|home)[^\"']*[\"'][^>]*>.*?<img[^>]*src=[\"']([^\"']+)[\"']",
)
QUICK_TOUCH = r"<link[^>]*apple-touch-icon[^>]*href=[\"']([^\"']+)[\"']"


def candidates_quick(html: Column, base: Column) -> Column:
    """JSON-LD by pattern, two matches of each of three patterns, one icon; the first five URLs."""
    json_ld = _all(F.get(_all(html, JSON_LD, 0), F.lit(0)), QUICK_JSON, 1)
    parts = [F.coalesce(json_ld, F.array().cast("array<string>")), *[F.slice(_all(html, p, 1), 1, 2) for p in QUICK], F.slice(_all(html, QUICK_TOUCH, 1), 1, 1)]
    return F.slice(F.transform(F.concat(*parts), lambda u: resolve_url(u, base)), 1, 5)


def anchor_links(html: Column) -> Column:
    """Targets of all links, in page order."""
    return F.filter(F.transform(_all(html, ANCHOR), lambda t: html_attribute(t, "href")), lambda u: u.isNotNull())


def explode_candidates(pages: DataFrame, html: str = "html", base: str = "url", key: str = "page_id", top: int = TOP) -> DataFrame:
    """F16 as a table: one row a candidate with its rank."""
    rows = pages.select(key, F.posexplode(candidates(F.col(html), F.col(base), top)).alias("rank", "c"))
    return rows.select(key, (F.col("rank") + 1).alias("rank"), "c.method", "c.url", "c.priority")
