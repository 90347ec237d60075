"""Registered queries of the library's own operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import PRESETS, Config
from kindred.functions import brand, fusion, html, strings, vectors
from kindred.operators import blocking, fallback, graph, merge, reports
from kindred.plans import pipelines
from kindred.plans.scratch import materialise
from kindred.sources import readers, registry, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Bits within which edited copies of a vector lie, narrowly and widely.
BITS, WIDE = 6, 8
#: Every vector comes with edited copies, in which one coordinate of so many has its sign turned.
EDITS = (23, 13, 9)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Vectors as images: the median of an 8 x 8 block gives a 64-bit hash


def edited(spark: SparkSession, d: str) -> DataFrame:
    """Every vector and its edited copies: id (4 x vec_id, then the copies), vec_id, label, embedding."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(n).alias("n")) for j, n in enumerate((0, *EDITS))])).alias("edit"))
    turned = F.transform("embedding", lambda x, i: F.when((F.col("edit.n") > 0) & ((i + F.col("vec_id")) % F.greatest(F.col("edit.n"), F.lit(1)) == 0), -x).otherwise(x))
    return e.select((F.col("vec_id") * 4 + F.col("edit.j")).alias("id"), "vec_id", "label", turned.alias("embedding"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    e = edited(spark, d).withColumn("bits", vectors.median_bits(F.col("embedding")))
    return e.withColumn("word", vectors.pack_bits(F.col("bits")))


HASHES = f"""originals as (select vec_id, label, embedding::double[] e, unnest([0, 1, 2, 3]) j from embeddings),
  copies as (select vec_id * 4 + j id, label, list_transform(range(1, len(e) + 1), lambda i: case when j > 0 and (i - 1 + vec_id) % [1, {", ".join(map(str, EDITS))}][j + 1] = 0 then -e[i] else e[i] end) e from originals),
  h as (select id, label, e, array_to_string(list_transform(e, lambda x: case when x > list_median(e) then '1' else '0' end), '') bits from copies)"""


def near(spark: SparkSession, d: str, bits: int = BITS) -> DataFrame:
    """Pairs of near words, exactly; the hashes are written once, so they aren't made anew in each part of the plan."""
    return blocking.hamming_pairs(materialise(hashes(spark, d).select("id", "word"), "hashes"), "word", bits)


def near_sql(bits: int = BITS) -> str:
    return f"""{HASHES}, p as (select a.id id_a, b.id id_b, hamming(a.bits, b.bits)::bigint distance, a.e ea, b.e eb, a.label la, b.label lb
  from h a join h b on a.id < b.id where hamming(a.bits, b.bits) <= {bits})"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs with their vectors, labels, cosine, scaled L1 similarity and Euclidean distance."""
    e = hashes(spark, d).select("id", "embedding", "label", vectors.norm(F.col("embedding")).alias("norm"))
    w = blocking.with_features(near(spark, d, WIDE), e, "id", "embedding", "label", "norm")
    a, b = F.col("embedding_a"), F.col("embedding_b")
    return w.withColumns({"cos": vectors.cosine(a, b, norms=(F.col("norm_a"), F.col("norm_b"))), "l1": vectors.l1_similarity(a, b), "l2": vectors.euclidean(a, b), "same": F.col("label_a") == F.col("label_b")})


MEASURED = f"""with {near_sql(WIDE)}, m as (select id_a, id_b, distance, la, lb, la = lb same, list_cosine_similarity(ea, eb) cos,
  1 - list_sum(list_transform(list_zip(ea, eb), lambda x: abs(x[1] - x[2]))) / 2 l1, list_distance(ea, eb) l2 from p)"""


@query(f"""with recursive {near_sql()}, e as (select id_a a, id_b b from p union all select id_b, id_a from p),
  r(id, other) as (select id, id from h union select r.id, e.b from r join e on r.other = e.a),
  l as (select id, min(other) label from r group by id), c as (select label, count(*) size from l group by label)
  select size, count(*)::bigint clusters, (size * count(*))::bigint members from c group by size""")
def hash_cluster_sizes(spark, d):
    """Flagship: hash, block, compare, components, sizes."""
    h = hashes(spark, d)
    labels = graph.components_with_nodes(h, near(spark, d), "id", "id_a", "id_b")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("clusters"), F.sum("size").alias("members"))


@query(f"with {HASHES} select id, bits, length(replace(bits, '0', ''))::bigint ones from h")
def median_hash(spark, d):
    """I2's threshold step, I25."""
    return hashes(spark, d).select("id", "bits", vectors.ones(F.col("bits")).cast("long").alias("ones"))


@query(f"with {HASHES} select id, list_sum(list_transform(range(0, 32), lambda i: (bits[i + 1] = '1')::bigint * (1::bigint << i)))::bigint low32, round(list_var_pop(e), 6) var from h")
def bits_and_variance(spark, d):
    """I26, I27."""
    return hashes(spark, d).select("id", vectors.low_number(F.col("bits")).alias("low32"), F.round(vectors.variance(F.col("embedding")), 6).alias("var"))


@query(f"with {near_sql()} select id_a, id_b, distance from p")
def hamming_pairs(spark, d):
    """Exact by pigeonhole segments."""
    return near(spark, d).select("id_a", "id_b", F.col("distance").cast("long").alias("distance"))


@query(f"with {HASHES} select a.id id_a, b.id id_b from h a join h b on a.id < b.id and left(a.bits, 8) = left(b.bits, 8)")
def bucket_pairs(spark, d):
    """First bits as bucket."""
    return blocking.bucket_pairs(hashes(spark, d).withColumn("bucket", F.left("bits", F.lit(8))), "bucket")


@query(f"with {HASHES} select a.id id_a, b.id id_b from h a join h b on a.id < b.id and hamming(left(a.bits, 16), left(b.bits, 16)) between 1 and 2")
def near_bucket_pairs(spark, d):
    """Neighbouring buckets of 16 bits."""
    w = hashes(spark, d).withColumn("bucket", vectors.pack_bits(F.left("bits", F.lit(16))))
    return blocking.near_bucket_pairs(w, "bucket", 2, 16)


@query(f"with {HASHES} select a.id id_a, b.id id_b from h a join h b on a.id < b.id and hamming(left(a.bits, 16), left(b.bits, 16)) <= 2")
def candidate_pairs(spark, d):
    """J4."""
    return blocking.candidate_pairs(hashes(spark, d).withColumn("bucket", vectors.pack_bits(F.left("bits", F.lit(16)))), "bucket", 2, 16)


@query(f"""with {near_sql()}, x as (select *, sha256(ea::varchar) s from p) select id_a, id_b, (64 - distance)::bigint agree, round(greatest(0, (64 - distance) / 64.0), 6) similarity from x""")
def hash_similarity(spark, d):
    """J5's normalisation."""
    p = near(spark, d)
    return p.select("id_a", "id_b", (64 - F.col("distance")).cast("long").alias("agree"), F.round(vectors.hash_similarity(F.col("distance")), 6).alias("similarity"))


@query("""with x as (select doc_id, sha256(coalesce(text, '')) h from documents), y as (select doc_id a, doc_id + 1 b from documents)
  select y.a, y.b, list_sum(list_transform(range(0, 64), lambda i: bit_count(xor(('0x' || p.h[i + 1])::int, ('0x' || q.h[i + 1])::int))))::bigint distance
  from y join x p on p.doc_id = y.a join x q on q.doc_id = y.b""")
def hamming_hex256(spark, d):
    """256-bit hashes in hex, of each document and its successor."""
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    p, q = x.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.col("h").alias("ha")), x.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"))
    return p.join(q, "b").select("a", "b", vectors.hamming_hex(F.col("ha"), F.col("hb")).cast("long").alias("distance"))


@query("""with e as (select vec_id, embedding::double[] e from embeddings) select a.vec_id id_a, b.vec_id id_b, round(list_cosine_similarity(a.e, b.e), 6) cos from e a join e b on a.vec_id < b.vec_id
  order by list_cosine_similarity(a.e, b.e) desc, 1, 2 limit 50""")
def cosine_pairs_topk(spark, d):
    """Of all pairs."""
    top = reports.cosine_top_pairs(table(spark, d, "embeddings"), "embedding", 50, "vec_id")
    return top.select("id_a", "id_b", F.round("cos", 6).alias("cos"))


@query(MEASURED + " select id_a, id_b, round(l1, 6) l1, round(l2, 6) l2 from m")
def l1_and_euclidean(spark, d):
    """J8, J11."""
    return measured(spark, d).select("id_a", "id_b", F.round("l1", 6).alias("l1"), F.round("l2", 6).alias("l2"))


@query(f"with {near_sql(WIDE)}" + """, s as (select id_a, id_b, unnest(range(-63, 64)) lag, ea x, eb y from p)
  select id_a, id_b, round(max(greatest(coalesce(list_sum(list_transform(range(1, 65), lambda i: case when i + lag between 1 and 64 then x[i] * y[i + lag] else 0 end)), 0), 0)), 6) corr from s group by id_a, id_b""")
def corr_max_linear(spark, d):
    """Over all lags of whole vectors."""
    return measured(spark, d).select("id_a", "id_b", F.round(vectors.correlation_max(F.col("embedding_a"), F.col("embedding_b")), 6).alias("corr"))


SCORED = MEASURED + """, w as (select *, (distance <= 5)::int + (l1 >= 0.4)::int + (cos >= 0.75)::int + same::int signals,
  0.5 * greatest(0, (64 - distance) / 64.0) + 0.25 * l1 + 0.15 * cos + 0.1 * (1 - distance / 64.0) + case when same then 0.1 else 0 end raw from m)"""


@query(SCORED + " select id_a, id_b, signals::bigint signals, round(least(case when signals = 0 and raw > 0.5 then raw * 0.5 else raw end, 1.0), 6) similarity from w")
def weighted_similarity(spark, d):
    """P2, P3."""
    c = Config(thresholds=PRESETS["strict"].__class__(5, 0, 0.4))
    m = measured(spark, d)
    signals = fusion.match_signals(c.thresholds, F.col("distance"), F.col("l1"), F.when(F.col("cos") >= 0.75, 1).otherwise(-1), F.col("same"))
    m = m.withColumn("signals", signals)
    s = fusion.weighted_similarity(c, F.col("distance"), F.col("l1"), F.col("cos"), 1 - F.col("distance") / 64.0, F.col("same"), F.col("signals"))
    return m.select("id_a", "id_b", F.col("signals").cast("long").alias("signals"), F.round(s, 6).alias("similarity"))


@query(MEASURED + """ select id_a, id_b, concat_ws(' + ', case when distance <= 3 then printf('pHash (dist=%d)', distance) end, case when cos >= 0.85 then printf('FFT (sim=%.3f)', cos) end,
  case when l1 >= 0.5 then printf('FMT (sim=%.3f)', l1) end) reason from m where distance <= 3 or cos >= 0.85 or l1 >= 0.5""")
def or_rule_reason(spark, d):
    """P1, F23, G4."""
    m = measured(spark, d)
    tests = (F.col("distance") <= 3, F.col("cos") >= 0.85, F.col("l1") >= 0.5)
    kept = m.filter(fusion.or_rule(F.col("distance"), F.col("cos"), F.col("l1"), 3, 0.85, 0.5))
    return kept.select("id_a", "id_b", strings.match_reason(tests[0], F.col("distance"), tests[1], F.col("cos"), tests[2], F.col("l1")).alias("reason"))


CALIBRATED = MEASURED + """, t as (select *, 1 - distance / 64.0 fused, greatest(0, cos) fft, greatest(0, l1 + 2) hu, greatest(0, 1 - l2 / 2) col, 1 - distance / 64.0 ph from m),
  c as (select *, (0.35 * fused + 0.25 * ph + 0.2 * fft + 0.15 * hu + 0.05 * col)
   / (case when fused > 0 then 0.35 else 0 end + case when ph > 0 then 0.25 else 0 end + case when fft > 0 then 0.2 else 0 end + case when hu > 0 then 0.15 else 0 end + case when col > 0 then 0.05 else 0 end) cal from t)"""


def _calibrated(m: DataFrame) -> DataFrame:
    z = lambda c: F.greatest(F.lit(0.0), c)
    m = m.withColumns({"fused": 1 - F.col("distance") / 64, "fft": z(F.col("cos")), "hu": z(F.col("l1") + 2)})
    return m.withColumn("cal", fusion.calibrated_fusion(F.col("fused"), F.col("fused"), F.col("fft"), F.col("hu"), F.col("l2")))


@query(CALIBRATED + " select id_a, id_b, round(cal, 6) calibrated, round(case when cal < 0.1 then greatest(fft, hu) else cal end, 6) score from c")
def calibrated_fusion(spark, d):
    """P5, P7."""
    m = _calibrated(measured(spark, d))
    return m.select("id_a", "id_b", F.round("cal", 6).alias("calibrated"), F.round(fusion.composite_score(F.col("cal"), F.col("fft"), F.col("hu")), 6).alias("score"))


@query(CALIBRATED + """, v as (select *, cal >= 0.75 vc, distance / 64.0 <= 0.25 vf, distance <= 6 vp, cos >= 0.985 vt, hu >= 0.75 vh from c),
  x as (select *, (vc::int + vf::int + vp::int + vt::int + vh::int) / 6.0 conf from v)
  select id_a, id_b, round(conf, 6) confidence, case when cal >= 0.85 then true when conf >= 0.5 and vc then true when vf and (vp or vt) then true else vp or vt or vh end is_similar from x""")
def decision_tree(spark, d):
    """P6 with the channels at hand."""
    m = _calibrated(measured(spark, d))
    votes = fusion.channel_votes({"fused": F.col("distance") / 64, "phash": F.col("distance"), "fft": F.col("cos"), "hu": F.col("hu"), "calibrated": F.col("cal")})
    return m.select("id_a", "id_b", F.round(fusion.confidence(votes), 6).alias("confidence"), fusion.decision_tree(votes, F.col("cal")).alias("is_similar"))


@query(MEASURED + """ select id_a, id_b, round(0.4 * (64 - distance) / 64.0 + 0.3 * cos + 0.3 * l1, 6) legacy,
  (distance <= 4)::int + (round(cos * 100) >= 25)::int + (l1 >= 0.9)::int >= 2 multi, distance <= 62 or l1 >= 0.05 or cos >= 0.1 or same accept from m""")
def other_decisions(spark, d):
    """P8, P9, P11."""
    m = measured(spark, d)
    legacy = fusion.legacy_similarity((64 - F.col("distance")) / 64, F.col("cos"), F.col("l1"))
    multi, _ = fusion.multi_criteria(F.col("distance"), F.round(F.col("cos") * 100), F.col("l1"))
    accept = fusion.singleton_accept(Config(), F.col("distance"), F.col("l1"), F.col("cos"), F.col("same"), F.lit(False))
    return m.select("id_a", "id_b", F.round(legacy, 6).alias("legacy"), multi.alias("multi"), accept.alias("accept"))


@query(f"""with recursive {near_sql()}, g as (select *, list_distance(ea, eb) l2 from p), e as (select id_a a, id_b b from g where l2 <= 0.55 union all select id_b, id_a from g where l2 <= 0.55),
  r(id, other) as (select id, id from h union select r.id, e.b from r join e on r.other = e.a) select id, min(other) label from r group by id""")
def color_gated_components(spark, d):
    """P10, G1, G2."""
    e = hashes(spark, d)
    pairs = blocking.with_features(near(spark, d), e, "id", "embedding")
    gated = pairs.filter(fusion.color_gate(vectors.euclidean(F.col("embedding_a"), F.col("embedding_b")), 0.55))
    return graph.components_with_nodes(e, gated, "id", "id_a", "id_b")


@query(f"""with recursive {near_sql(WIDE)}, e as (select id_a a, id_b b from p where (64 - distance) / 64.0 >= 0.89 union all select id_b, id_a from p where (64 - distance) / 64.0 >= 0.89),
  r(id, other) as (select id, id from h union select r.id, e.b from r join e on r.other = e.a) select id, min(other) label from r group by id""")
def single_linkage_cut(spark, d):
    """The flat cut is the components of near enough pairs."""
    pairs = near(spark, d, WIDE).withColumn("similarity", vectors.hash_similarity(F.col("distance")))
    return graph.single_linkage_cut(hashes(spark, d), pairs, 1 - 0.89, "id", "id_a", "id_b")


@query(f"""with recursive {near_sql()}, e as (select id_a a, id_b b from p union all select id_b, id_a from p),
  r(id, other) as (select id, id from h union select r.id, e.b from r join e on r.other = e.a), l as (select id, min(other) label from r group by id),
  c as (select label, count(*) size, list(id order by id) m from l group by label having count(*) > 1)
  select row_number() over (order by size desc, label) cluster_id, size, array_to_string(m, ',') members, label representative from c""")
def cluster_table(spark, d):
    """Numbered clusters of several members with their representative."""
    labels = graph.components_with_nodes(hashes(spark, d), near(spark, d), "id", "id_a", "id_b")
    return graph.clusters(labels, min_size=2).withColumn("members", F.array_join("members", ","))


@query(f"""with recursive {near_sql(WIDE)}, t as (select unnest([2.0, 4.0, 6.0, 8.0]) t), e as (select t, id_a a, id_b b from p, t where distance <= t union all select t, id_b, id_a from p, t where distance <= t),
  r(t, id, other) as (select t, id, id from h, t union select r.t, r.id, e.b from r join e on r.other = e.a and r.t = e.t),
  l as (select t, id, min(other) label from r group by t, id), c as (select t, count(distinct label) clusters from l group by t)
  select t::double threshold, clusters, t = (select arg_min(t, struct_pack(a := abs(clusters - 1000), b := t)) from c) chosen from c""")
def threshold_sweep(spark, d):
    """Which threshold gives about 1000 clusters."""
    return merge.threshold_sweep(hashes(spark, d), near(spark, d, WIDE), F.col("distance").cast("double"), [2, 4, 6, 8], 1000)


@query()
def singleton_merge(spark, d):
    """Greedy merging of single vectors by the exact rule (sequential by nature, so tested on small cases)."""
    e = hashes(spark, d).select("id", "word", "label")
    labels = materialise(graph.components_with_nodes(e, near(spark, d), "id", "id_a", "id_b"), "labels")
    single = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").select("id")
    close = lambda a, b: bin((int(a["word"]) ^ int(b["word"])) & (1 << 64) - 1).count("1") <= 10 or a["label"] == b["label"]
    merged = merge.merge_singletons(e.join(single, "id", "left_semi"), close)
    return merge.renumbered(labels.join(single, "id", "left_anti"), merged)


# Documents: content hashes


@query("""with x as (select doc_id, left(sha256(coalesce(text, '')), 16) h from documents) select h content_hash, count(*) copies, min(doc_id) representative from x group by h having count(*) > 1""")
def content_hash_groups(spark, d):
    """F21, G3."""
    x = table(spark, d, "documents").select("doc_id", strings.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return x.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("representative")).filter("copies > 1")


@query("""with u as (select text, min(doc_id) rep, length(text) - length(replace(text, 'e', '')) n_e from documents group by text) select doc_id, rep representative, n_e::bigint n_e from documents join u using (text)""")
def dedupe_then_join_back(spark, d):
    """Features of distinct contents, joined back to every row."""
    docs = table(spark, d, "documents")
    once = docs.groupBy("text").agg(F.min("doc_id").alias("representative")).withColumn("n_e", (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).cast("long"))
    return docs.select("doc_id", "text").join(once, "text").select("doc_id", "representative", "n_e")


@query("select doc_id, md5('42|' || doc_id) draw from documents order by draw, doc_id limit 100")
def sample_by_hash(spark, d):
    """A reproducible sample of exact size."""
    docs = table(spark, d, "documents").select("doc_id")
    return readers.sample_by_hash(docs, 100, "doc_id").select("doc_id", F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))).alias("draw"))


@query("select distinct source domain from documents where source is not null order by md5('42|' || source), source limit 10")
def distinct_sample(spark, d):
    """S3."""
    return readers.distinct_sample(table(spark, d, "documents"), 10, "source").select(F.col("source").alias("domain"))


@query("select url domain from pages where url is not null order by url limit 40")
def head_sites(spark, d):
    """Website column found by name, first rows in order."""
    return readers.head_sites(readers.sites(table(spark, d, "pages")), 40, "domain")


# Pages: domains and HTML

AUTH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query(f"""select page_id, case when url ~ '^https?://.*' then regexp_replace({AUTH}, '^www\\.', '') else url end clean, lower({AUTH}) domain, trim(url) clean_url,
  left(regexp_replace(regexp_replace(split_part(replace({AUTH}, 'www.', ''), '.', 1), '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), 100) name,
  split_part(regexp_replace(url, '^https?://', ''), '/', 1) display from pages""")
def domain_functions(spark, d):
    """F1-F6."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", strings.clean_domain(u).alias("clean"), strings.extract_domain(u).alias("domain"), strings.clean_url(u).alias("clean_url"), strings.extract_domain_name(u).alias("name"), strings.display_domain(u).alias("display"))


@query(f"""with x as (select page_id, {AUTH} h from pages) select page_id, left(case when len(string_split(h, '.')) > 1 then string_split(h, '.')[-2] else h end, 15) brand,
  left(md5(h), 16) || '_' || h key, 'https://' || h || '/favicon.ico' probe from x""")
def brand_label_and_keys(spark, d):
    """F6, F9, F22."""
    h = strings.extract_domain(F.col("url"))
    return table(spark, d, "pages").select("page_id", strings.brand_label(F.col("url")).alias("brand"), strings.cache_key(h).alias("key"), strings.fill_template(F.lit("https://{domain}/favicon.ico"), h).alias("probe"))


def _family_sql(c: str) -> str:
    rules = " ".join(f"when {' or '.join(f'contains({c}, {chr(39)}{n}{chr(39)})' for n in needles.split())} then '{f}'" for f, needles in brand.FAMILIES.items())
    bare = c
    for s in brand.STRIPPED:
        bare = f"replace({bare}, '{s}', '')"
    return f"case {rules} when split_part({bare}, '.', 1) = '' then 'unknown' else split_part({bare}, '.', 1) end"


def _industry_sql(c: str) -> str:
    scores = ", ".join(f"struct_pack(s := {' + '.join(f'contains({c}, {chr(39)}{w}{chr(39)})::int' for w in words.split())}, o := {-i}, n := '{n}')" for i, (n, words) in enumerate(brand.INDUSTRIES.items()))
    return f"(list_reverse_sort([{scores}])[1])"


@query(f"""with x as (select p_partkey, lower(replace(p_name, ' ', '') || '.com') dom from part), y as (select p_partkey, {_family_sql('dom')} family, {_industry_sql('dom')} best from x)
  select p_partkey, family, case when best.s > 0 then best.n else 'general' end industry from y""")
def brand_family_and_industry(spark, d):
    """F7, F8 on names that read like domains."""
    dom = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".com"))
    return table(spark, d, "part").select("p_partkey", brand.brand_family(dom).alias("family"), brand.industry(dom).alias("industry"))


@query("""with a as (select page_id, url base, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>')) t, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*>'), 1) i from pages),
  b as (select page_id, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_extract(t, '(?i)href=["'']([^"'']+)["'']', 1) link, min(i) i from a group by 1, 2),
  c as (select page_id, link, row_number() over (partition by page_id order by i) rank from b) select page_id, rank, link from c where rank <= 10""")
def anchor_candidates_top10(spark, d):
    """F15-F19 on anchors: attribute, absolute URL, each URL once, first ten in page order."""
    links = html.anchor_links(F.col("html"))
    found = F.slice(F.array_distinct(F.transform(links, lambda u: strings.resolve_url(u, F.col("url")))), 1, 10)
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("rank", "link")).select("page_id", (F.col("rank") + 1).cast("long").alias("rank"), "link")


LOGO_HTML = """<html><head><script type="application/ld+json">{"@type": "Organization", "logo": "/ld.png"}</script><script type="application/ld+json">[{"@type": "Brand", "logo": {"url": "http://cdn.x/b.png"}}]</script>
<link rel="apple-touch-icon" href="/touch.png"><link rel="icon" href="/fav.png"><link rel="shortcut icon" href="/fav.ico"></head><body><header><img class="logo" src="img/l.png"></header><a href="/"><img src="/home.png"></a></body></html>"""


@query("""select page_id, rank::bigint rank, method, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || path url, priority::bigint priority from pages cross join (values
  (1, 'json-ld', '/ld.png', 1), (3, 'header-nav', NULL, 2), (4, 'homepage-link', '/home.png', 3), (5, 'apple-touch-icon', '/touch.png', 4), (6, 'favicon', '/fav.png', 5)) v(rank, method, path, priority) where path is not null
  union all select page_id, 2, 'json-ld', 'http://cdn.x/b.png', 1 from pages""")
def logo_candidates(spark, d):
    """Every strategy on one page of markup, at the base of each page (the relative header image apart)."""
    pages = table(spark, d, "pages").select("page_id", "url", F.lit(LOGO_HTML).alias("html"))
    rows = html.explode_candidates(pages)
    return rows.filter("method <> 'header-nav'").select("page_id", F.col("rank").cast("long").alias("rank"), "method", "url", F.col("priority").cast("long").alias("priority"))


@query("""select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) first_value, len(json_keys(props))::bigint n_keys from events""")
def json_props(spark, d):
    """F13's shape: values out of JSON texts."""
    e = table(spark, d, "events")
    keys = F.json_object_keys("props")
    values = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.get(F.map_values(values), F.lit(0)).alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


# Events: attempts at sources.  The user is the domain, the type is the source, its length the tier


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("domain"), F.col("event_type").alias("source"), F.length("event_type").alias("tier"), F.col("event_id").alias("pos"), (F.col("value") > 100).alias("success"), "value")


ATTEMPTS = "a as (select user_id domain, event_type source, length(event_type)::int tier, event_id pos, value > 100 success, value from events)"


@query(f"""with {ATTEMPTS}, r as (select *, row_number() over (partition by domain order by tier, pos) n from a where success), t as (select domain, count(*) n_tried from a group by domain)
  select t.domain, r.domain is not null success, tier, pos, source, round(value, 6) as value, n_tried from t left join r on t.domain = r.domain and r.n = 1""")
def tiered_first_success(spark, d):
    """R4, R5."""
    return fallback.first_success(attempts(spark, d)).withColumn("value", F.round("value", 6))


@query(f"""with {ATTEMPTS}, z as (select tier, count(distinct source) n from a group by tier), s as (select tier, sum(n) over (order by tier) n from z),
  w as (select domain, min(case when success then tier end) tier from a group by domain)
  select domain, w.tier, coalesce(s.n, (select max(n) from s))::bigint attempts from w left join s using (tier)""")
def attempts_used(spark, d):
    """R4's count, R13."""
    a = attempts(spark, d)
    sources = a.select("source", "tier").distinct().withColumnRenamed("source", "name")
    won = a.groupBy("domain").agg(F.min(F.when(F.col("success"), F.col("tier"))).alias("tier"))
    return fallback.with_attempts(won, registry.tier_sizes(sources)).select("domain", "tier", "attempts")


@query(f"""with {ATTEMPTS}, b as (select *, case source when 'purchase' then 1 when 'click' then 2 else 0 end l from a), c as (select *, case when source = 'error' then 2 when l > 0 then 0 else 1 end g, case when l > 0 then l else pos end p from b),
  k as (select *, row_number() over (partition by domain, g order by p, source) nth from c), f as (select * from k where g <> 1 or nth <= 3), r as (select *, row_number() over (partition by domain order by g, p, tier, pos) n from f where success)
  select t.domain, r.source, r.g::bigint as "group", t.n n_tried from (select domain, count(*) n from f group by domain) t left join r on r.domain = t.domain and r.n = 1""")
def priority_sources(spark, d):
    """Listed sources, then three others, then a last resort."""
    a = attempts(spark, d)
    return fallback.priority_list(a, ["purchase", "click"], extra=3, last="error").select("domain", "source", F.col("group").cast("long").alias("group"), "n_tried")


@query(f"""with {ATTEMPTS}, m as (select *, row_number() over (partition by domain order by md5('0|' || domain || '|' || source), source, pos) place from (select domain, source, bool_or(success) success, min(pos) pos from a group by 1, 2)),
  w as (select domain, min(case when success then place end) place, count(*) n from m group by domain) select domain, place::bigint place, least(ceil(coalesce(place, n) / 5.0) * 5, n)::bigint attempts from w""")
def shuffled_retry(spark, d):
    """R7."""
    a = attempts(spark, d).groupBy("domain", "source").agg(F.bool_or("success").alias("success"), F.min("pos").alias("pos"))
    return fallback.shuffled_retry(a).select("domain", F.col("place").cast("long").alias("place"), "attempts")


FIRST = "f as (select domain, bool_or(success) success, max(value) v from a where tier <= 5 group by domain), g as (select domain, bool_or(success) success, max(value) v from a where tier > 5 group by domain)"


@query(f"with {ATTEMPTS}, {FIRST} select f.domain, case when not f.success and g.success then true else f.success end success, round(case when not f.success and g.success then g.v else f.v end, 6) v, (not f.success and coalesce(g.success, false)) recovered from f left join g using (domain)")
def recovery_overwrite(spark, d):
    """R8, J16."""
    a = attempts(spark, d)
    part = lambda test: a.filter(test).groupBy("domain").agg(F.bool_or("success").alias("success"), F.max("value").alias("v"))
    return fallback.recovered(part("tier <= 5"), part("tier > 5")).withColumn("v", F.round("v", 6))


@query(f"with {ATTEMPTS}, {FIRST} select domain, success, round(v, 6) v from f where success union all select domain, success, round(v, 6) from g where domain not in (select domain from f where success)")
def hybrid_sources(spark, d):
    """R9, A28, A29."""
    a = attempts(spark, d)
    part = lambda test: a.filter(test).groupBy("domain").agg(F.bool_or("success").alias("success"), F.round(F.max("value"), 6).alias("v"))
    return fallback.hybrid(part("tier <= 5"), part("tier > 5"))


@query(f"with {ATTEMPTS}, k as (select distinct domain from a), c as (select distinct domain from a where success and source = 'click') select domain, left(md5(domain::varchar), 16) || '_' || domain cache_key, domain in (select domain from c) hit from k")
def cache_lookup(spark, d):
    """Hits by semi-join, misses by anti-join."""
    a = attempts(spark, d).withColumn("domain", F.col("domain").cast("string"))
    cache = readers.cache_rows(a.filter("source = 'click'").withColumn("data", F.col("value")).groupBy("domain").agg(F.bool_or("success").alias("success"), F.max("data").alias("data")))
    hits, misses = readers.cache_hits(a.select("domain").distinct(), cache.select("cache_key", "domain"))
    both = hits.select("domain", "cache_key", F.lit(True).alias("hit")).unionByName(misses.select("domain", "cache_key", F.lit(False).alias("hit")))
    return both.select(F.col("domain").cast("long").alias("domain"), "cache_key", "hit")


@query("select event_id, epoch(timestamp '2024-01-15 00:00:00')::bigint - epoch(date_trunc('second', ts))::bigint age from events where epoch(timestamp '2024-01-15 00:00:00')::bigint - epoch(date_trunc('second', ts))::bigint < 86400")
def ttl_cache(spark, d):
    """Entries younger than a day at a given time."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("written_at"))
    return readers.live_cache(e, now).select("event_id", (F.unix_timestamp(now) - F.unix_timestamp("written_at")).alias("age"))


@query(f"with {ATTEMPTS}, r as (select count(*) total, count(*) filter (success) succeeded, 100.0 * count(*) filter (success) / count(*) rate from a) select total, succeeded, round(rate, 6) rate, case when rate >= 98 then 'excellent' when rate >= 97 then 'very good' when rate >= 95 then 'good' when rate >= 90 then 'fair' else 'poor' end label, rate < 98 retry from r")
def quality_gate(spark, d):
    """A1, A35, R8's gate."""
    a = attempts(spark, d)
    r = reports.success_rate(a, F.col("success"))
    return r.withColumn("label", fallback.quality_gate(F.col("rate"))).join(fallback.needs_recovery(a).select("retry"))


@query(f"with {ATTEMPTS} select source, tier::bigint tier, count(*) n, round(sum(value), 2) bytes, round(100.0 * count(*) / sum(count(*)) over (), 6) pct from a group by source, tier")
def source_breakdown(spark, d):
    """A2, A3, A5."""
    b = reports.breakdown(attempts(spark, d).withColumn("tier", F.col("tier").cast("long")), "source", "tier", size="value")
    return b.withColumn("bytes", F.round("bytes", 2))


@query(f"with {ATTEMPTS} select domain, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 6) pct from a group by domain order by n desc, domain limit 8")
def top_services(spark, d):
    """A3: the eight largest."""
    return reports.breakdown(attempts(spark, d), "domain", top=8)


@query(f"with {ATTEMPTS} select source, count(*) n, count(*) filter (success) succeeded, round(count(*) filter (success) / count(*), 6) rate from a group by source")
def method_success_rate(spark, d):
    """A4."""
    return reports.rate_by(attempts(spark, d), "source", F.col("success"))


@query(f"with {ATTEMPTS}, l as (select unnest([4, 6, 8]) max_tier), k as (select distinct domain from a), f as (select domain, min(tier) t from a where success group by domain), r as (select max_tier, count(*) n, count(*) filter (t <= max_tier) found from k cross join l left join f using (domain) group by max_tier) select max_tier::bigint max_tier, n, found, max_tier = (select max_tier from r order by found desc, max_tier limit 1) best from r")
def config_compare_best(spark, d):
    """A34."""
    return fallback.compare_tiers(attempts(spark, d), (4, 6, 8)).withColumn("max_tier", F.col("max_tier").cast("long"))


@query(f"with {ATTEMPTS} select source, round(min(value), 6) low, round(quantile_cont(value, 0.25), 6) q25, round(quantile_cont(value, 0.5), 6) q50, round(quantile_cont(value, 0.75), 6) q75, round(max(value), 6) high from a group by source")
def method_quantiles(spark, d):
    """A20."""
    q = reports.quantiles(attempts(spark, d), "source", "value")
    return q.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("select n_name domain from nation where n_regionkey not in (select r_regionkey from region where r_name in ('ASIA', 'EUROPE'))")
def skip_list(spark, d):
    """R11, J17, S16."""
    skip = table(spark, d, "region").filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_regionkey").alias("n_regionkey"))
    return fallback.without(table(spark, d, "nation"), skip, "n_regionkey").select(F.col("n_name").alias("domain"))


@query("""with b as (select p_partkey, left(regexp_replace(regexp_replace(split_part(p_name, '.', 1), '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), 100) b, p_name from part),
  n as (select p_partkey, b, row_number() over (partition by b order by p_name, p_partkey) - 1 n from b) select p_partkey % 1 z, b || case when n > 0 then '_' || n else '' end || '.jpg' file_name from n""")
def export_names(spark, d):
    """File names, sanitised and made unique."""
    named = sinks.with_file_names(table(spark, d, "part").select(F.col("p_name").alias("domain"), "p_partkey"))
    return named.select(F.lit(0).cast("long").alias("z"), "file_name")


@query("select n_nationkey::bigint id, n_name as name from nation")
def rows_as_json(spark, d):
    """K4: to JSON and back."""
    rows = sinks.as_json(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    return rows.select(F.from_json("json", "id long, name string").alias("r")).select("r.*")


# Orders as clusters of line items; suppliers as clusters of brands

SIZES = "s as (select l_orderkey, count(*) size from lineitem group by l_orderkey)"


def order_sizes(spark: SparkSession, d: str) -> DataFrame:
    return reports.cluster_sizes(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id")))


def part_sizes(spark: SparkSession, d: str) -> DataFrame:
    return reports.cluster_sizes(table(spark, d, "lineitem").select(F.col("l_partkey").alias("cluster_id")))


@query(f"""with {SIZES}, o as (select list(size order by size) l, count(*) n from s)
  select count(*) clusters, sum(size)::bigint members, min(size) min_size, max(size) max_size, round(avg(size), 6) avg_size, (select l[n // 2 + 1] from o) upper_median, round(quantile_cont(size, 0.5), 6) median,
  round(stddev_pop(size), 6) std_size, count(*) filter (size = 1) singletons, round(count(*) filter (size = 1) / sum(size), 6) singletons_per_member, round(count(*) filter (size = 1) / count(*), 6) singletons_per_cluster from s""")
def size_stats(spark, d):
    """A6, A7, D10."""
    return reports.size_stats(order_sizes(spark, d))


def _scheme_sql(key: str, scheme: tuple) -> str:
    low, parts = 0, []
    for top, name in scheme:
        parts.append(f"select '{name}' bucket, count(*) filter (size > {low}" + (f" and size <= {top}" if top else "") + ") clusters, count(*) total from s")
        low = top or low
    return f"with s as (select {key}, count(*) size from lineitem group by {key}), u as ({' union all '.join(parts)}) select bucket, clusters, round(100.0 * clusters / total, 6) pct from u"


@query(_scheme_sql("l_orderkey", reports.SIZE_A))
def size_histogram_a(spark, d):
    """A8."""
    return reports.size_histogram(order_sizes(spark, d), reports.SIZE_A)


@query(_scheme_sql("l_partkey", reports.SIZE_B))
def size_histogram_b(spark, d):
    """A9."""
    return reports.size_histogram(part_sizes(spark, d), reports.SIZE_B)


@query(f"with {SIZES} select count(*) clusters, sum(size)::bigint members, max(size) largest, count(*) filter (size = 1) singles, round((sum(size) - count(*) filter (size = 1)) / sum(size), 6) grouped_share from s")
def dashboard(spark, d):
    """A38."""
    return reports.dashboard(order_sizes(spark, d))


@query(f"with {SIZES} select count(*) clusters, round(avg(size), 6) mean_size from s")
def nunique(spark, d):
    """A26."""
    return reports.nunique(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id")))


def members(spark: SparkSession, d: str, cluster: str = "l_suppkey") -> DataFrame:
    """Line items as members: their part's brand is the family.  The part table follows the data: a plain join."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    items = table(spark, d, "lineitem").select(F.col(cluster).alias("cluster_id"), "l_partkey", "l_linenumber", "l_orderkey")
    return items.join(parts, "l_partkey")


def _members_sql(cluster: str = "l_suppkey") -> str:
    return f"m as (select {cluster} cluster_id, p_brand brand, l_partkey, l_orderkey, l_linenumber from lineitem join part on p_partkey = l_partkey), f as (select cluster_id, brand, count(*) n from m group by 1, 2), c as (select cluster_id, sum(n)::bigint size, count(*) families, max(n) top, arg_min(brand, struct_pack(a := -n, b := brand)) best from f group by 1)"


@query(f"with {_members_sql('l_orderkey')} select count(*) filter (size > 1) clusters, count(*) filter (size > 1 and (families = 1 or (size > 2 and top >= 0.7 * size))) coherent, round(count(*) filter (size > 1 and (families = 1 or (size > 2 and top >= 0.7 * size))) / count(*) filter (size > 1), 6) coherence from c")
def brand_coherence(spark, d):
    """A10."""
    return reports.brand_coherence(members(spark, d, "l_orderkey"))


@query(f"with {_members_sql('l_orderkey')} select cluster_id, size, families, top largest_n, best largest, round(100.0 * top / size, 6) largest_pct, case when families = 1 then 'COHERENT' when families <= 3 then 'MOSTLY' else 'MIXED' end label from c")
def coherence_label(spark, d):
    """A11."""
    return reports.coherence_by_cluster(members(spark, d, "l_orderkey"))


@query(f"with {_members_sql('l_orderkey')} select count(*) filter (families = 1) coherent, count(*) filter (families > 1) mixed from c")
def coherence_totals(spark, d):
    """A12."""
    return reports.coherence_totals(members(spark, d, "l_orderkey"))


@query(f"with {_members_sql()}, r as (select cluster_id, brand, n, row_number() over (partition by cluster_id order by n desc, brand) rank from f) select * from r where rank <= 10")
def top_families(spark, d):
    """Ten largest families of each cluster."""
    return reports.top_families(members(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("with r as (select label cluster_id, vec_id id, row_number() over (partition by label order by vec_id) rank from embeddings) select cluster_id::bigint cluster_id, id, rank from r where rank <= 5")
def first_k_per_cluster(spark, d):
    """A13, A17."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("id"))
    return reports.first_members(e, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {HASHES} select label::bigint cluster_id, count(*) size, round(avg(length(replace(bits, '0', ''))), 6) mean_bits, round(avg(list_var_pop(e)), 6) mean_var from h group by label order by size desc, cluster_id limit 20")
def cluster_feature_means_top20(spark, d):
    """A14, A15."""
    h = hashes(spark, d).withColumn("cluster_id", F.col("label").cast("long"))
    return reports.cluster_means(h, {"mean_bits": vectors.ones(F.col("bits")), "mean_var": vectors.variance(F.col("embedding"))})


@query(MEASURED + " select least(floor((cos + 1) / 0.1), 19)::bigint bin, count(*) n, round(avg(cos), 6) mean from m group by 1")
def score_histogram(spark, d):
    """A18."""
    return reports.score_histogram(measured(spark, d), F.col("cos"), 20, -1.0, 1.0).withColumn("bin", F.col("bin").cast("long"))


@query(MEASURED + ", t as (select unnest([0.6, 0.7, 0.75, 0.8, 0.85, 0.9]) threshold) select threshold::double threshold, count(*) filter (cos > threshold) n from m cross join t group by threshold")
def threshold_curve(spark, d):
    """A19."""
    return reports.threshold_curve(measured(spark, d), F.col("cos"), [0.6, 0.7, 0.75, 0.8, 0.85, 0.9])


@query(MEASURED + """ select 'distance' a, 'cos' b, round(corr(distance, cos), 6) r from m union all select 'distance', 'l1', round(corr(distance, l1), 6) from m union all select 'distance', 'l2', round(corr(distance, l2), 6) from m
  union all select 'cos', 'l1', round(corr(cos, l1), 6) from m union all select 'cos', 'l2', round(corr(cos, l2), 6) from m union all select 'l1', 'l2', round(corr(l1, l2), 6) from m""")
def method_correlation(spark, d):
    """A21."""
    return reports.correlations(measured(spark, d), ["distance", "cos", "l1", "l2"])


@query("""with m as (select label cluster_id, list_sum(embedding::double[]) v from embeddings), t as (select cluster_id from m group by 1 order by count(*) desc, 1 limit 10),
  x as (select m.*, min(v) over (partition by m.cluster_id) lo, max(v) over (partition by m.cluster_id) hi from m semi join t using (cluster_id))
  select cluster_id::bigint cluster_id, case when hi = lo then 0 else least(floor((v - lo) / ((hi - lo) / 10)), 9) end::bigint bin, count(*) n from x group by 1, 2""")
def feature_distribution(spark, d):
    """A22."""
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    e = table(spark, d, "embeddings").withColumn("cluster_id", F.col("label").cast("long"))
    return reports.feature_distribution(e, total).withColumn("bin", F.col("bin").cast("long"))


@query(f"with {HASHES}, s as (select id, bits from h order by id limit 60) select a.id id_a, b.id id_b, hamming(a.bits, b.bits)::bigint distance from s a join s b on a.id < b.id")
def heat_map(spark, d):
    """All distances within a small sample (a report of fixed size)."""
    s = hashes(spark, d).select("id", "word").orderBy("id").limit(60)
    return blocking.all_pairs(s, "id", "word").select("id_a", "id_b", vectors.hamming_long(F.col("word_a"), F.col("word_b")).cast("long").alias("distance"))


@query()
def principal_components(spark, d):
    """A24 (checked against a decomposition in the tests)."""
    return reports.principal_components(table(spark, d, "embeddings"), "embedding", 64, 2, "vec_id")[0]


@query("""with p as (select vec_id, unnest(embedding::double[]) v from embeddings), q as (select vec_id, avg(v) m, stddev_pop(v) s from p group by vec_id), z as (select p.vec_id, avg(power((v - m) / s, 3)) k from p join q using (vec_id) group by 1)
  select vec_id, round(m, 6) mean, round(s, 6) std, round(k, 6) skew from q join z using (vec_id)""")
def pixel_moments(spark, d):
    """I19 on vectors as pixels: mean, spread and biased skewness."""
    p = table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return p.groupBy("vec_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.skewness("v"), 6).alias("skew"))


@query(f"with {SIZES}, a as (select count(*) c, sum(size)::bigint m from s) select 'clusters: ' || c line from a union all select 'members: ' || m from a")
def report_lines(spark, d):
    """K3, K7: two of the report's lines."""
    lines = reports.report_lines(reports.size_stats(order_sizes(spark, d)), order_sizes(spark, d))
    return lines.filter("line rlike '^(clusters|members): '")


@query()
def registry_requests(spark, d):
    """Every request for the pages' hosts up to tier three."""
    hosts = table(spark, d, "pages").select(strings.extract_domain(F.col("url")).alias("domain")).distinct()
    return registry.requests(hosts, registry.built_in(spark), "domain", 3).drop("headers")


@query("select l_returnflag source, l_linestatus status, count(*) n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def bench_aggregate(spark, d):
    """A pushed-down filter and a partial aggregate over the largest table."""
    x = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    value: Column = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("revenue"))


# Vectors drawn as images: 8 x 8 blocks of colour, as PNG bytes


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """(id, domain, content): every fifth picture is a byte-identical copy of the one before it."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    source = e.select((F.col("vec_id") - (F.col("vec_id") % 5 == 4).cast("long")).alias("of"), F.col("vec_id").alias("id"))
    drawn = e.select(F.col("vec_id").alias("of"), "embedding").join(source, "of").select("id", "embedding")

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        from kindred.functions.image import encode_png

        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.clip(128 + 400 * np.array(v).reshape(8, 8), 0, 255).astype(np.uint8)
                out.append(encode_png(np.repeat(np.repeat(np.dstack([x, x.T, 255 - x]), 6, 0), 8, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "content"])

    made = drawn.mapInArrow(draw, "id long, content binary")
    return made.select("id", F.concat(F.lit("site"), F.col("id") % 97, F.lit(".com")).alias("domain"), "content")


#: The pictures' 64 cells: blue, green and red, then grey, hue, saturation and value.
CELLS = """with o as (select vec_id id, vec_id - (vec_id % 5 = 4)::int of from embeddings), px as (select o.id, unnest(range(64)) i, e.embedding::double[] e from o join embeddings e on e.vec_id = o.of),
  bgr as (select id, i, floor(least(greatest(128 + 400 * e[i + 1], 0), 255)) b, floor(least(greatest(128 + 400 * e[i % 8 * 8 + i // 8 + 1], 0), 255)) g from px),
  rgb as (select id, i, b, g, 255 - b r, 0.114 * b + 0.587 * g + 0.299 * (255 - b) grey from bgr),
  m as (select *, greatest(r, g, b) v, greatest(r, g, b) - least(r, g, b) span from rgb),
  hue as (select *, case when span = 0 then 0 when v = r then (60 * (g - b) / span + 360) % 360 when v = g then 60 * (2 + (b - r) / span) else 60 * (4 + (r - g) / span) end % 360 hue from m),
  hsv as (select *, least(round_even(hue / 2, 0), 179.999) % 180 h, case when v = 0 then 0 else round_even(255 * span / v, 0) end s from hue)"""


@query(CELLS + """, bins as (select id, unnest([least(floor(h * 10 / 180), 9), 10 + least(floor(s * 10 / 256), 9), 20 + least(floor(v * 10 / 256), 9)])::int bin from hsv), n as (select id, bin, count(*) n from bins group by id, bin),
  hist as (select id, list_transform(range(30), lambda k: coalesce(list_extract(map(list(bin), list(n))[k::int], 1), 0)) x from (select id, bin, n from n) group by id)
  select o.id, true as valid, array_to_string(x, ',') histogram, 64::bigint hash_length, 'square' layout, 64::bigint dct_length, (o.id <> of)::bigint is_copy from o join hist using (id)""".replace("list_extract(map(list(bin), list(n))[k::int], 1)", "map(list(bin), list(n))[k::int]"))
def image_features(spark, d):
    """Features of every picture, one decode for identical bytes; the histogram by cells."""
    made = pipelines.image_features(pictures(spark, d))
    cells = F.transform("color_histogram", lambda x: F.round(x * 64).cast("long"))
    return made.select(
        "id", "valid", F.array_join(cells, ",").alias("histogram"), F.length("phash").cast("long").alias("hash_length"),
        "composition.layout", F.length("dct_hash").cast("long").alias("dct_length"), (F.col("id") % 5 == 4).cast("long").alias("is_copy"),
    )


def _moments_sql(c: str) -> str:
    return f"round(avg({c}) / 255 + 1e-9, 5) mean_{c}, round(stddev_pop({c}) / 255 + 1e-9, 5) std_{c}"


@query(CELLS + f""", mean as (select id, avg(grey) m, avg(r) mr, stddev_pop(r) sr, avg(g) mg, stddev_pop(g) sg from hsv group by id)
  select id, {", ".join(_moments_sql(c) for c in "rgbhsv")}, round(avg(power((r - mr) / sr, 3)) / 255 + 1e-9, 5) skew_r, round(avg(power((g - mg) / sg, 3)) / 255 + 1e-9, 5) skew_g,
  string_agg((grey > m)::int::varchar, '' order by i) average_hash from hsv join mean using (id) group by id""")
def image_moments(spark, d):
    """Colour moments and the average hash of every picture."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        from kindred.functions import image

        for batch in batches:
            rows = []
            for id_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                img = image.decode(data)
                rgb, hsv, vector = image.rgb_moments(img), image.hsv_moments(img), image.color_vector(img)
                assert np.allclose(vector, [*rgb[::3], hsv[2], hsv[4]])
                rows.append((id_, *rgb[:8], *hsv, image.average_hash(img)))
            names = ["id", "mean_r", "std_r", "skew_r", "mean_g", "std_g", "skew_g", "mean_b", "std_b", "mean_h", "std_h", "mean_s", "std_s", "mean_v", "std_v", "average_hash"]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), preserve_index=False)

    numbers = ["mean_r", "std_r", "skew_r", "mean_g", "std_g", "skew_g", "mean_b", "std_b", "mean_h", "std_h", "mean_s", "std_s", "mean_v", "std_v"]
    made = pictures(spark, d).select("id", "content").mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in numbers) + ", average_hash string")
    return made.select("id", *[F.round(F.col(n) + 1e-9, 5).alias(n) for n in numbers], "average_hash")  # the last place of a tie is the same


@query("with h as (select vec_id - (vec_id % 5 = 4)::bigint origin, vec_id from embeddings) select origin, count(*) copies from h group by origin having count(*) > 1")
def image_copies(spark, d):
    """Identical pictures by content hash."""
    p = pictures(spark, d).select("id", strings.content_hash(F.col("content")).alias("h"))
    return p.groupBy("h").agg(F.min("id").alias("origin"), F.count("*").alias("copies")).filter("copies > 1").select("origin", "copies")


@query()
def image_clusters(spark, d):
    """Entry A on pictures: features, blocking, fusion, linkage cut, merge by the exact rule."""
    return pipelines.cluster_images(pictures(spark, d), Config.preset("strict"))["membership"]


@query()
def image_research_features(spark, d):
    """I6, I7, I10-I23 of every picture (their values are tested against plain loops)."""
    from kindred.functions import image

    made = image.with_features(pictures(spark, d), image.g2_features, image.G2_SCHEMA).select("id", "features.*")
    return made.agg(F.count("*").alias("images"), F.count_if("valid").alias("valid"), F.max(F.size("sift_signature")).cast("long").alias("sift_length"), F.max(F.size("zernike_moments")).cast("long").alias("zernike_length"))
