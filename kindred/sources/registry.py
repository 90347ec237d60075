"""Catalogue of image sources and its merging with a user's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.strings import fill_params, fill_template, query_string

# Tier, name, URL template and parameters of the known sources.  Keys that a service asks for come
# from the user's configuration.
CATALOGUE = """
1 | Clearbit | https://logo.clearbit.com/{domain} |
1 | LogoAPI | https://api.logo.dev/{domain} |
1 | BrandAPI | https://logo.api.brand.io/{domain} |
1 | Brandfetch | https://api.brandfetch.io/v2/brands/{domain} |
1 | LogoGrab | https://api.logograb.com/v1/logo/{domain} |
2 | Google Favicon | https://www.google.com/s2/favicons | domain={domain} sz=128
2 | Google Favicon HD | https://www.google.com/s2/favicons | domain={domain} sz=256
2 | Google Favicon XL | https://www.google.com/s2/favicons | domain={domain} sz=512
2 | Microsoft Bing | https://www.bing.com/th | id=OIP.{domain} w=128 h=128 c=7 r=0 o=5
2 | DuckDuckGo Favicon | https://icons.duckduckgo.com/ip3/{domain}.ico |
3 | Favicon.io | https://favicons.githubusercontent.com/{domain} |
3 | Icons8 | https://img.icons8.com/color/128/{domain} |
3 | Favicon Kit | https://www.faviconkit.com/{domain}/128 |
3 | Favicon Grabber | https://favicongrabber.com/api/grab/{domain} |
3 | GetFavicon | https://getfavicon.appspot.com/{domain} |
3 | Besticon | https://besticon-demo.herokuapp.com/icon | url=https://{domain} size=128
3 | Iconscout | https://cdn.iconscout.com/icon/{domain} |
4 | Wikipedia | https://en.wikipedia.org/api/rest_v1/page/summary/{domain} |
4 | Wikidata | https://www.wikidata.org/w/api.php | action=wbsearchentities search={domain} format=json language=en
4 | Company Logo DB | https://logo.clearbitjs.com/{domain} |
4 | LogoTyp | https://logotyp.us/logo/{domain} |
4 | OpenCorporates | https://api.opencorporates.com/companies/search | q={domain} format=json
5 | Internet Archive | https://web.archive.org/cdx/search/cdx | url={domain}/favicon.ico output=json limit=1
5 | Archive Today | https://archive.today/timemap/json/{domain} |
5 | Logo Garden | https://www.logoground.com/api/logo/{domain} |
6 | Direct Favicon | https://{domain}/favicon.ico |
6 | Apple Touch Icon | https://{domain}/apple-touch-icon.png |
6 | Apple Touch Icon 152 | https://{domain}/apple-touch-icon-152x152.png |
6 | Apple Touch Icon 180 | https://{domain}/apple-touch-icon-180x180.png |
6 | Android Chrome 192 | https://{domain}/android-chrome-192x192.png |
6 | Android Chrome 512 | https://{domain}/android-chrome-512x512.png |
6 | Site Logo PNG | https://{domain}/logo.png |
6 | Site Logo SVG | https://{domain}/logo.svg |
6 | Assets Logo | https://{domain}/assets/logo.png |
6 | Images Logo | https://{domain}/images/logo.png |
6 | Static Logo | https://{domain}/static/logo.png |
6 | Brand Logo | https://{domain}/brand/logo.png |
7 | WWW Favicon | https://www.{domain}/favicon.ico |
7 | WWW Logo | https://www.{domain}/logo.png |
7 | CDN Logo | https://cdn.{domain}/logo.png |
7 | Media Logo | https://media.{domain}/logo.png |
8 | DNS-over-HTTPS Logo TXT | https://cloudflare-dns.com/dns-query | name=logo.{domain} type=TXT ct=application/dns-json
8 | DNS-over-HTTPS Brand TXT | https://cloudflare-dns.com/dns-query | name=brand.{domain} type=TXT ct=application/dns-json
8 | DNS-over-HTTPS Assets TXT | https://cloudflare-dns.com/dns-query | name=assets.{domain} type=TXT ct=application/dns-json
8 | Google DNS Logo TXT | https://dns.google/resolve | name=logo.{domain} type=TXT
8 | WHOIS Brand API | https://www.whoisxmlapi.com/whoisserver/WhoisService | domainName={domain} outputFormat=JSON
8 | Domain Tools Logo | https://api.domaintools.com/v1/{domain}/hosting-history | format=json
8 | SecurityTrails DNS | https://api.securitytrails.com/v1/domain/{domain}/subdomains |
8 | VirusTotal Domain | https://www.virustotal.com/vtapi/v2/domain/report | domain={domain}
"""
# Direct icon addresses, tried in this order.
PROBES = (
    "https://{domain}/favicon.ico", "https://www.{domain}/favicon.ico",
    "https://{domain}/apple-touch-icon.png", "https://www.{domain}/apple-touch-icon.png",
    "https://{domain}/favicon-32x32.png", "https://www.{domain}/favicon-32x32.png",
    "https://{domain}/favicon-16x16.png", "https://www.{domain}/favicon-16x16.png",
    "https://{domain}/apple-touch-icon-120x120.png", "https://www.{domain}/apple-touch-icon-120x120.png",
)
SCHEMA = "pos int, name string, url string, params map<string,string>, headers map<string,string>, timeout int, tier int, kind string"


def built_in(spark: SparkSession) -> DataFrame:
    """The catalogue as a table, in order of preference."""
    rows = []
    for pos, line in enumerate(CATALOGUE.strip().splitlines()):
        tier, name, url, params = (x.strip() for x in line.split("|"))
        kind = "dns" if "DNS-over" in name or "Google DNS" in name else "whois" if int(tier) == 8 else "http"
        rows.append((pos, name, url, dict(p.split("=", 1) for p in params.split()), {}, 3 if int(tier) == 1 else 5, int(tier), kind))
    return spark.createDataFrame(rows, SCHEMA)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Sources in a JSON file (``logo_apis``), tier and timeout 5 by default, parameters folded into the URL."""
    schema = "logo_apis array<struct<name:string,url:string,params:map<string,string>,headers:map<string,string>,tier:int,timeout:int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("logo_apis").alias("pos", "x")).select("pos", "x.*")
    folded = F.when(F.size(F.coalesce("params", F.create_map().cast("map<string,string>"))) > 0, F.concat("url", F.lit("?"), query_string(F.col("params")))).otherwise(F.col("url"))
    return rows.filter("name <> ''").select("pos", "name", folded.alias("url"), F.create_map().cast("map<string,string>").alias("params"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), F.coalesce("timeout", F.lit(5)).alias("timeout"), F.coalesce("tier", F.lit(5)).alias("tier"), F.lit("http").alias("kind"))


def merged(own: DataFrame, more: DataFrame) -> DataFrame:
    """The built-in sources and those of ``more`` with another name (compared as lower case with underscores)."""
    key = lambda df: F.replace(F.lower(df["name"]), F.lit(" "), F.lit("_"))
    shift = own.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("shift"))
    new = more.join(F.broadcast(own), key(more) == key(own), "left_anti")
    return own.unionByName(new.join(F.broadcast(shift)).withColumn("pos", F.col("pos") + F.col("shift")).drop("shift"))


def requests(domains: DataFrame, registry: DataFrame, domain: str = "domain", max_tier: int = 99) -> DataFrame:
    """Every request that may be made for every domain, by tier and position (R13: tiers up to ``max_tier``).

    The registry is a small table of fixed size, so it is broadcast.
    """
    few = F.broadcast(registry.filter(F.col("tier") <= max_tier))
    d = F.col(domain)
    full = F.concat(fill_template(F.col("url"), d), F.when(F.size("params") > 0, F.concat(F.lit("?"), query_string(fill_params(F.col("params"), d)))).otherwise(""))
    return domains.join(few).select(d.alias("domain"), F.col("name").alias("source"), "tier", "pos", full.alias("url"), "timeout", "kind", "headers")


def tier_sizes(registry: DataFrame) -> DataFrame:
    """Number of sources in each tier and in all tiers up to it."""
    by = registry.groupBy("tier").agg(F.count("*").alias("n"))
    low = by.select(F.col("tier").alias("t"), F.col("n").alias("m"))
    return by.join(F.broadcast(low), F.col("t") <= F.col("tier")).groupBy("tier", "n").agg(F.sum("m").alias("n_up_to"))
