"""Domain, URL, JSON and text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _authority(url: Column) -> Column:
    """What stands between the scheme and the next slash, question mark or hash."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def clean_domain(url: Column) -> Column:
    """of http(s) URLs the host without one leading ``www.``; anything else as it is."""
    return F.when(url.rlike("^https?://"), F.regexp_replace(_authority(url), r"^www\.", "")).otherwise(url)


def extract_domain(url: Column) -> Column:
    """the host in lower case, ``www.`` included; a missing scheme is taken as https."""
    return F.lower(_authority(F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))))


def clean_url(url: Column) -> Column:
    """trimmed and with a scheme; null gives an empty text."""
    text = F.trim(F.coalesce(url, F.lit("")))
    return F.when(text == "", "").when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))


def sanitize_filename(name: Column) -> Column:
    """a name that any file system takes: odd characters to one underscore, no dots or spaces at the ends, 100 characters."""
    plain = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"(?U)[^\w\-_.]", "_")
    return F.left(F.regexp_replace(F.regexp_replace(plain, "_+", "_"), r"^[. ]+|[. ]+$", ""), F.lit(100))


def extract_domain_name(url: Column) -> Column:
    """the first label of the host, all ``www.`` removed, as a file name."""
    host = F.replace(F.when(url.rlike("^https?://"), _authority(url)).otherwise(url), F.lit("www."), F.lit(""))
    return sanitize_filename(F.split_part(host, F.lit("."), F.lit(1)))


def display_domain(url: Column) -> Column:
    """no scheme, nothing after the first slash."""
    return F.split_part(F.regexp_replace(url, "^https?://", ""), F.lit("/"), F.lit(1))


def brand_label(url: Column, length: int = 15) -> Column:
    """the penultimate label of the host (its only one if there is no other), cut to ``length``."""
    parts = F.split(display_domain(url), r"\.")
    return F.left(F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.element_at(parts, 1)), F.lit(length))


def fill_template(template: Column, domain: Column) -> Column:
    """``{domain}`` replaced by the domain."""
    return F.replace(template, F.lit("{domain}"), domain)


def fill_params(params: Column, domain: Column) -> Column:
    """F9 for a map of parameters."""
    return F.transform_values(params, lambda _, v: fill_template(v, domain))


def query_string(params: Column) -> Column:
    """Parameters as ``k=v&k=v`` in order of key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")


def resolve_url(url: Column, base: Column) -> Column:
    """absolute URL of a reference: with scheme, //host, /path, ?query, #fragment or a relative path.

    Dot segments are resolved; a base that isn't a URL gives the reference back.
    """
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    no_fragment, no_query = F.regexp_replace(base, "#.*$", ""), F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    joined = F.when(url.startswith("/"), url).otherwise(F.concat(folder, url))
    tail = F.regexp_extract(joined, r"([?#].*)$", 1)
    segments = F.split(F.regexp_replace(joined, r"[?#].*$", ""), "/")
    step = lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s))
    walked = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    dotted = F.concat(walked, F.when(F.element_at(segments, -1).isin(".", "..") & ~walked.endswith("/"), "/").otherwise(""))
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(site == "", url)
        .when(url == "", no_fragment)
        .when(url.startswith("//"), F.concat(scheme, url))
        .when(url.startswith("#"), F.concat(no_fragment, url))
        .when(url.startswith("?"), F.concat(F.when(no_query == site, F.concat(site, F.lit("/"))).otherwise(no_query), url))
        .otherwise(F.concat(site, dotted, tail))
    )


# What a TXT record may say, in order of preference; letters in either case.
TXT_PATTERNS = (
    r"(?i)logo[_-]?url[=:]\s*([^\s\"']+)",
    r"(?i)brand[_-]?logo[=:]\s*([^\s\"']+)",
    r"(?i)icon[_-]?url[=:]\s*([^\s\"']+)",
    r"(?i)(https?://[^\s\"']+\.(?:png|jpg|jpeg|svg|gif|webp))",
    r"(?i)assets[=:]\s*([^\s\"']+)",
)


def txt_logo_url(txt: Column) -> Column:
    """the first pattern whose value is an http(s) URL."""
    found = [F.regexp_extract(txt, p, 1) for p in TXT_PATTERNS]
    return F.coalesce(*[F.when(x.rlike("^https?://"), x) for x in found])


# Parts of a subdomain that promise a logo.
SUBDOMAIN_HINTS = ("logo", "brand", "assets", "cdn", "static")


def api_json_logo(body: Column, api: Column) -> Column:
    """logo URL in an API's JSON answer; null where the API gives none.

    Icons are compared by the text before the x of their size, as texts, the first of equals winning.
    """
    text = lambda p: F.get_json_object(body, p)
    icons = F.from_json(text("$.icons"), "array<struct<src:string,sizes:string>>")
    ranked = F.transform(icons, lambda x, i: F.struct(F.split_part(F.coalesce(x["sizes"], F.lit("0x0")), F.lit("x"), F.lit(1)).alias("w"), (-i).alias("o"), x["src"].alias("src")))
    answers = F.from_json(F.coalesce(text("$.Answer"), text("$.answer")), "array<struct<type:int,data:string>>")
    urls = F.transform(F.filter(answers, lambda x: x["type"] == 16), lambda x: txt_logo_url(F.coalesce(x["data"], F.lit(""))))
    hinted = F.filter(F.from_json(text("$.subdomains"), "array<string>"), lambda x: F.lower(x).rlike("|".join(SUBDOMAIN_HINTS)))
    return (
        F.when(api == "Wikipedia", F.coalesce(text("$.thumbnail.source"), text("$.originalimage.source")))
        .when(api == "Favicon Grabber", F.array_max(ranked)["src"])
        .when(api.rlike("DNS.* (Logo|Brand|Assets) TXT"), F.get(F.filter(urls, lambda u: u.isNotNull()), F.lit(0)))
        .when((api == "SecurityTrails DNS") & (F.size(hinted) > 0), F.concat(F.lit("https://"), F.get(hinted, F.lit(0)), F.lit("."), F.coalesce(text("$.domain"), F.lit("")), F.lit("/logo.png")))
    )


def logo_hint(*attributes: Column) -> Column:
    """whether id, class, alt or src speak of a logo."""
    return F.concat_ws(" ", *attributes).rlike("(?i)(logo|brand|site-logo|company-logo)")


def html_attribute(tag: Column, name: str) -> Column:
    """the value of a quoted attribute, null if there is none."""
    return F.nullif(F.regexp_extract(tag, f"(?i){name}=[\"']([^\"']+)[\"']", 1), F.lit(""))


def content_hash(content: Column) -> Column:
    """16 hex digits of SHA-256."""
    return F.left(F.sha2(content, 256), F.lit(16))


def cache_key(domain: Column) -> Column:
    """16 hex digits of MD5, an underscore and the domain."""
    return F.concat(F.left(F.md5(domain), F.lit(16)), F.lit("_"), domain)


def match_reason(phash_ok: Column, distance: Column, fft_ok: Column, fft: Column, fmt_ok: Column, fmt: Column) -> Column:
    """which rules tied a pair, with their figures."""
    return F.concat_ws(
        " + ",
        F.when(phash_ok, F.format_string("pHash (dist=%d)", distance.cast("int"))),
        F.when(fft_ok, F.format_string("FFT (sim=%.3f)", fft)),
        F.when(fmt_ok, F.format_string("FMT (sim=%.3f)", fmt)),
    )


def image_kind(data: Column) -> Column:
    """png, jpeg, gif, bmp or webp by the first bytes, else null (the signatures put right)."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("47494638"), "gif")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
    )


def run_label(ts: Column) -> Column:
    """the time stamp in file names."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")
