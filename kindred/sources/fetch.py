"""Fetching images in partitions with a pluggable fetcher.

A fetcher is a function (url, timeout, headers) -> (status, content type, bytes).  Tiers are tried in order and
nothing of a later tier is asked for once one has succeeded, so the short cut holds inside a task.  A source that
answers with JSON has the image it names fetched in the same step, and counts as one attempt.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.html import TOP, candidates
from kindred.functions.strings import SUBDOMAIN_HINTS, TXT_PATTERNS

Fetcher = Callable[[str, int, dict], tuple[int, str, bytes]]
RESULT = "domain string, success boolean, source string, tier_used int, attempts int, content_type string, data binary, size_bytes long, error string"


def http_fetch(url: str, timeout: int, headers: dict) -> tuple[int, str, bytes]:
    """The live fetcher."""
    with urlopen(Request(url, headers=headers or {"User-Agent": "kindred"}), timeout=timeout) as r:
        return r.status, r.headers.get("content-type", ""), r.read()


def acceptable(status: int, content_type: str, data: bytes, least_bytes: int) -> bool:
    """An image answer that is large enough."""
    kind = content_type.lower()
    return status == 200 and ("image/" in kind or "application/octet-stream" in kind) and len(data) > least_bytes


def _txt_url(txt: str) -> str | None:
    """F14 for one record."""
    found = (m[1] for m in (re.search(p, txt) for p in TXT_PATTERNS) if m)
    return next((x for x in found if re.match("https?://", x)), None)


def named_image(source: str, data: bytes) -> str | None:
    """F13 for one answer: the address of the image that a JSON answer of ``source`` names; None if it names none."""
    try:
        body = json.loads(data)
    except ValueError:
        return None
    if not isinstance(body, dict):
        return None
    dicts = lambda x: [y for y in x if isinstance(y, dict)] if isinstance(x, list) else []
    url = None
    if source == "Wikipedia":
        url = next((x["source"] for x in dicts([body.get("thumbnail"), body.get("originalimage")]) if x.get("source")), None)
    elif source == "Favicon Grabber":
        icons = dicts(body.get("icons"))
        url = max(icons, key=lambda x: str(x.get("sizes") or "0x0").split("x")[0])["src"] if icons else None
    elif re.search("DNS.* (Logo|Brand|Assets) TXT", source):
        records = (_txt_url(str(x.get("data") or "")) for x in dicts(body.get("Answer") or body.get("answer")) if x.get("type") == 16)
        url = next((x for x in records if x), None)
    elif source == "SecurityTrails DNS":
        names = [x for x in body.get("subdomains") or () if isinstance(x, str) and any(h in x.lower() for h in SUBDOMAIN_HINTS)]
        url = f"https://{names[0]}.{body.get('domain') or ''}/logo.png" if names else None
    return url if isinstance(url, str) else None


def fetch_tiered(requests: DataFrame, fetcher: Fetcher = http_fetch, least_bytes: int = 500) -> DataFrame:
    """First success by (tier, position) for each domain; ``attempts`` counts the sources of all tiers that were tried.

    Requests of a domain come together in one list, so a task needs one domain at a time.  A request without a URL is
    not made, but its domain has a row.
    """
    step = F.struct("tier", "pos", "source", "url", "timeout", F.map_entries("headers").alias("headers"))
    lists = requests.groupBy("domain").agg(F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), step))).alias("plan"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for domain, plan in zip(frame["domain"], frame["plan"], strict=True):
                rows.append(_one(domain, plan, fetcher, least_bytes))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return lists.mapInPandas(run, RESULT)


def _one(domain: str, plan, fetcher: Fetcher, least_bytes: int) -> tuple:
    attempts, tier, won, error = 0, None, None, None
    for step in plan:
        if won and step["tier"] != tier:
            break
        tier, attempts = step["tier"], attempts + 1
        if won:
            continue
        try:
            wait, headers = int(step["timeout"]), {h["key"]: h["value"] for h in step["headers"]} if step["headers"] is not None else {}
            status, kind, data = fetcher(step["url"], wait, headers)
            if status == 200 and not acceptable(status, kind, data, least_bytes) and (image := named_image(step["source"], data)):
                status, kind, data = fetcher(urljoin(step["url"], image), wait, {})  # another host: no keys go there
            if acceptable(status, kind, data, least_bytes):
                won = (step["source"], kind, data)
        except Exception as e:  # noqa: BLE001  a source that fails is one that has no image
            error = f"{type(e).__name__}: {e}"[:200]
    if won:
        return domain, True, won[0], int(tier), attempts, won[1], won[2], len(won[2]), None
    return domain, False, None, None, attempts, None, None, None, error or "no source has an image"


def fetch_pages(sites: DataFrame, fetcher: Fetcher = http_fetch, timeout: int = 10) -> DataFrame:
    """The HTML of each site, or why there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    status, _, data = fetcher(url, timeout, {})
                    rows.append((url, data.decode("utf-8", "replace") if status == 200 else None, None if status == 200 else f"status {status}"))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return sites.select("url").mapInPandas(run, "url string, html string, error string")


def fetch_candidates(pages: DataFrame, fetcher: Fetcher = http_fetch, least_bytes: int = 500, timeout: int = 5, top: int = TOP) -> DataFrame:
    """From page to image: the first of each page's candidates (F16) that is an image; ``pages`` has domain, url, html.

    A page without candidates, or that could not be read, has a row without success.
    """
    ranked = pages.select("domain", F.posexplode_outer(candidates(F.col("html"), F.col("url"), top)).alias("rank", "c"))
    headers = F.create_map().cast("map<string,string>").alias("headers")
    steps = ranked.select("domain", F.col("c.method").alias("source"), F.col("rank").alias("tier"), F.col("rank").alias("pos"), "c.url", F.lit(timeout).alias("timeout"), headers)
    return fetch_tiered(steps, fetcher, least_bytes)
