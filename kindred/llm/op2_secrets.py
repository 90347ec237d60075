"""Secret scan with corpus-wide ownership frequency (native DataFrame operations only).

Candidates are found by pattern in every whole text; each candidate's hash is then counted over distinct
repositories and owners.  What many owners hold is a copied example; what one owner holds is live-looking.

A value in many owners' or in many repositories' texts (a repository is a source and a language) is an example; one
in a single owner's few repositories is live; what lies between is shared.

Edge cases, each with a defined result: null and empty texts have no spans; very long texts are searched whole, in a
time below the square of the number of matches; a null source or language counts as one of its own; repeated rows
count once for ownership and each get the same answer; spans with one start are ordered by kind; an empty table
gives an empty result; extra columns are ignored in the report and kept, whatever their names, in redaction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

# The patterns of the base kinds; letters of the key words in either case.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same spans as AKIA[A-Z0-9]+ of 18 characters or more: runs are maximal
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "token")
LEAST_VALUE = 12
#: Owners, or repositories, from which on a value is a widely copied example; and up to which both it is its owner's.
MANY_OWNERS, MANY_REPOS = 3, 6
OWN, OWN_REPOS = 1, 2

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs, places counted in code points.

    The pieces between matches give the places: split() and regexp_extract_all() walk the same matches.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("found"), values.alias("value"))

    def placed(steps: Column) -> Column:
        lengths = F.transform(steps, lambda x: x["gap"] + F.length(x["found"]))
        both = F.arrays_zip(steps.alias("step"), _sums_before(lengths).alias("at"))
        return F.transform(both, lambda z: _span(z["at"] + z["step"]["gap"], z["step"], kind))

    matches = F.filter(steps, lambda x: x["found"].isNotNull())
    places = F.get(F.transform(F.array(matches), placed), F.lit(0))  # bound, so the text is searched once
    return F.when(text.rlike(pattern), places).otherwise(F.array().cast(SPAN))


def _span(start: Column, step: Column, kind: int) -> Column:
    end = start + F.length(step["found"])
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), step["value"].alias("value"))


def _fold(lengths: Column) -> Column:
    """Sums before each place, by a fold that copies what it has: for short arrays."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def _sums_before(lengths: Column) -> Column:
    """Sums before each place, by blocks of about the root of the length, so a text of very many matches is no
    matter of their number's square."""

    def blocked(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.slice(x, i * width + 1, width))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), _fold(sums).alias("o")), lambda z: F.transform(_fold(z["b"]), lambda n: n + z["o"])))

    return F.when(F.size(lengths) <= 64, _fold(lengths)).otherwise(F.get(F.transform(F.array(lengths), blocked), F.lit(0)))


def base_spans(text: Column) -> Column:
    """All assign, access and hex spans, by start and then kind."""
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(F.array().cast(SPAN))
    return F.array_sort(F.concat(assign, access, _spans(text, HEX, 2)))


def token_spans(text: Column, base: Column) -> Column:
    """Long strings that mix digits and both cases and touch no base span: candidates that need ownership evidence."""
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(_spans(text, TOKEN, 3), lambda s: mixed(s) & apart(s))


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: its spans with value hashes instead of values.  The only scan of the texts."""
    text = F.coalesce("text", F.lit(""))
    owner = F.coalesce("source", F.lit("")) if "source" in docs.columns else F.lit("")
    repo = F.concat_ws("/", owner, F.coalesce("lang", F.lit(""))) if "lang" in docs.columns else owner
    found = docs.select("doc_id", owner.alias("owner"), repo.alias("repo"), *keep, text.alias("body")).withColumn("base", base_spans(F.col("body")))
    found = found.withColumn("more", token_spans(F.col("body"), F.col("base"))).drop("body")
    hashed = lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash"))
    return found.select(
        "doc_id", "owner", "repo", *keep,
        F.transform("base", hashed).alias("base"),
        F.transform("more", hashed).alias("more"),
    )


def ownership(occurrences: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos and the verdict; three partial aggregations, so a value in every row stays small."""
    by_repo = occurrences.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    by_hash = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))
    verdict = F.when((F.col("n_owners") >= MANY_OWNERS) | (F.col("n_repos") >= MANY_REPOS), "example").when((F.col("n_owners") <= OWN) & (F.col("n_repos") <= OWN_REPOS), "live").otherwise("shared")
    return by_hash.withColumn("verdict", verdict)


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, base and kept spans, and by hash the verdicts of the document's candidates.

    Two documents' rows are told apart by doc_id and spans, so repeated rows are judged once.  The table of
    ownership is written first: then both sides of the join are plain shuffles, and a hash that sits in a
    third of all rows is split by the skew join.
    """
    found = materialise(
        candidates(docs, *keep).withColumn("row_key", F.xxhash64("doc_id", F.concat("base", "more"))), "secrets"
    )
    each = found.select("doc_id", "row_key", "owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["hash"]))).alias("hash"))
    owned = materialise(ownership(each), "secret-owners")
    judged = each.select("doc_id", "row_key", "hash").distinct().join(owned.select("hash", "verdict"), "hash")
    by_verdict = [F.collect_set(F.when(F.col("verdict") == v, F.col("hash"))).alias(v) for v in ("live", "shared", "example")]
    per_doc = judged.groupBy("doc_id", "row_key").agg(*by_verdict)
    plain, with_spans = found.filter(F.size("base") + F.size("more") == 0), found.filter(F.size("base") + F.size("more") > 0)
    none = [F.array().cast("array<string>").alias(v) for v in ("live", "shared", "example")]
    key = with_spans["doc_id"].eqNullSafe(per_doc["doc_id"]) & (with_spans["row_key"] == per_doc["row_key"])
    full = with_spans.join(per_doc, key).select(with_spans["*"], "live", "shared", "example")
    both = plain.select("*", *none).unionByName(full)
    return both.withColumn("added", F.filter("more", lambda s: F.array_contains("live", s["hash"])))


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document the counts, the digest of its base spans, all spans and how its candidates were judged."""
    both = F.array_sort(F.concat("base", "added"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    judged = lambda v: F.size(F.filter(both, lambda s: F.array_contains(v, s["hash"]))).cast("long")
    return scan(docs).select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(both).alias("spans"),
        judged("live").alias("n_live"), judged("shared").alias("n_shared"), judged("example").alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span that isn't a widely copied example replaced by ``mark``; other columns stay.

    Only documents that have spans to replace get a new text; n_chars follows the text where it exists.  Places
    belong to an id and a text: rows that share an id, or have none, are masked at their own spans only.
    """
    cut, key, got, text_key, got_key = fresh(docs, "cut", "new_text", "doc_id_", "text_key", "text_key_")
    docs = docs.withColumn(text_key, F.sha2(F.coalesce("text", F.lit("")), 256))
    judged = scan(docs, text_key)
    spans = F.array_sort(F.filter(F.concat("base", "added"), lambda s: ~F.array_contains("example", s["hash"])))
    places = judged.select(F.col("doc_id").alias(got), F.col(text_key).alias(got_key), spans.alias(cut)).filter(F.size(cut) > 0).groupBy(got, got_key).agg(F.first(cut).alias(cut))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ahead = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], ahead).otherwise(acc["out"]).alias("out"))

    rebuilt = F.aggregate(F.col(cut), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    joined = docs.join(places, docs["doc_id"].eqNullSafe(places[got]) & (docs[text_key] == places[got_key]), "left")
    changed = F.col(cut).isNotNull() & text.isNotNull()
    joined = joined.withColumn(key, F.when(changed, rebuilt))
    out = {"text": F.coalesce(F.col(key), docs["text"]).alias("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.coalesce(F.length(key).cast("long"), docs["n_chars"]).alias("n_chars")
    return joined.select(*[out.get(c, docs[c]) for c in docs.columns if c != text_key])


def oracle() -> str:
    """DuckDB SQL for the columns that don't depend on ownership, and for all spans."""
    kinds = (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("token", TOKEN, 0))
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for n, (kind, pattern, group) in enumerate(kinds):
        found = f"regexp_extract_all(t, {quoted(pattern)})"
        values = f"regexp_extract_all(t, {quoted(pattern)}, {group})"
        parts.append(
            f"select doc_id, owner, repo, {n} kind, '{kind}' name, unnest(range(1, len(f) + 1)) i, f, v, g from (select doc_id, owner, repo,"
            f" {found} f, {values} v, string_split_regex(t, {quoted(pattern)}) g from d) where len(f) > 0"
        )
    union = reduce(lambda a, b: f"{a} union all {b}", parts)
    return f"""
with d as (select doc_id, coalesce(source, '') as owner, coalesce(source, '') || '/' || coalesce(lang, '') as repo, coalesce(text, '') t from documents),
m as ({union}),
p as (select doc_id, owner, repo, kind, name, f[i] m, v[i] v,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) s from m),
b0 as (select doc_id, owner, repo, kind, name, s::bigint s, (s + length(m))::bigint e, v from p where kind <> 0 or length(v) >= {LEAST_VALUE}),
b as (select * from b0 where kind < 3 or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')
  and not exists (select 1 from b0 x where x.doc_id = b0.doc_id and x.kind < 3 and x.s < b0.e and b0.s < x.e))),
o as (select v, count(distinct owner) n, count(distinct repo) r from b group by v),
j as (select b.*, case when n >= {MANY_OWNERS} or r >= {MANY_REPOS} then 'example' when n <= {OWN} and r <= {OWN_REPOS} then 'live' else 'shared' end verdict from b join o using (v)),
k as (select * from j where kind < 3 or verdict = 'live'),
r as (select doc_id, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
  string_agg(name || ':' || s || ':' || e, ',' order by s, kind) filter (kind < 3) base, string_agg(name || ':' || s || ':' || e, ',' order by s, kind) spans,
  count(*) filter (verdict = 'live') n_live, count(*) filter (verdict = 'shared') n_shared, count(*) filter (verdict = 'example') n_example from k group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_shared, 0) n_shared, coalesce(n_example, 0) n_example
from d left join r using (doc_id)
"""
