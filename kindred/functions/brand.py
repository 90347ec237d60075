"""Brand families and industries of domains by rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Needles of each brand family, in order of precedence.
FAMILIES = {
    "google": "google youtube gmail chrome android drive",
    "microsoft": "microsoft windows office azure teams outlook",
    "amazon": "amazon aws prime alexa kindle twitch",
    "apple": "apple iphone ipad mac ios safari",
    "meta": "facebook instagram whatsapp messenger meta",
    "disney": "disney pixar marvel starwars espn hulu",
}
# Key words of each industry; ties go to the first.
INDUSTRIES = {
    "technology": "tech software app digital cloud ai data microsoft google apple amazon meta adobe oracle salesforce zoom slack dropbox github",
    "finance": "bank financial capital investment credit loan visa mastercard paypal stripe square amex jpmorgan goldman wells chase citibank",
    "ecommerce": "shop store market buy sell retail commerce amazon ebay etsy shopify walmart target bestbuy alibaba wish",
    "cosmetics": "cosmetics beauty makeup skincare loreal maybelline sephora ulta revlon covergirl olay clinique",
    "automotive": "auto car vehicle motor ford toyota honda bmw mercedes audi volkswagen tesla uber lyft",
    "food": "food restaurant cafe pizza burger starbucks mcdonalds subway dominos kfc cocacola pepsi",
    "fashion": "fashion clothing apparel style nike adidas zara hm gap uniqlo forever21 guess",
    "media": "news media tv radio streaming netflix youtube spotify cnn bbc espn disney hulu",
    "healthcare": "health medical hospital care pharmacy cvs walgreens pfizer johnson abbott medtronic",
    "education": "education school university learning course harvard stanford mit coursera udemy khan",
}
# What is taken out of a domain to get its brand, in this order.
STRIPPED = ("www.", ".com", ".org", ".net", ".co")


def _holds(domain: Column, needle: str, match: str) -> Column:
    return domain.contains(needle) if match == "substring" else domain.rlike(rf"(^|[^a-z0-9]){needle}([^a-z0-9]|$)")


def brand_family(domain: Column, match: str = "substring") -> Column:
    """the first family one of whose needles stands in the domain, else the brand in the domain itself.

    ``match='token'`` asks for whole labels, so that pharmacy isn't apple (through mac).
    """
    name = F.lower(domain)
    rules = [(reduce(Column.__or__, [_holds(name, n, match) for n in needles.split()]), family) for family, needles in FAMILIES.items()]
    bare = F.split_part(reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), STRIPPED, name), F.lit("."), F.lit(1))
    chosen = F.when(rules[0][0], rules[0][1])
    for rule, family in rules[1:]:
        chosen = chosen.when(rule, family)
    return chosen.otherwise(F.when(bare == "", "unknown").otherwise(bare))


def industry(domain: Column, match: str = "substring") -> Column:
    """F8: the industry with most key words in the domain, the first of equals; general if none has one."""
    name = F.lower(domain)
    scores = [reduce(Column.__add__, [_holds(name, w, match).cast("int") for w in words.split()]) for words in INDUSTRIES.values()]
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, (n, s) in enumerate(zip(INDUSTRIES, scores, strict=True))]))
    return F.when(best["score"] > 0, best["name"]).otherwise("general")
