"""The library's own operators: goldens, brute force, metamorphic image tests."""

import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.config import PRESETS, Config
from kindred.functions import brand, fusion, html, image, strings, vectors
from kindred.operators import blocking, fallback, graph, merge, reports
from kindred.plans import pipelines
from kindred.sources import fetch, readers, registry, sinks
from kindred.streaming.incremental import HashClusters


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items()) or "x int"
    row = tuple(v[1] for v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


# Strings and brands


@pytest.mark.parametrize(("domain", "family"), [("google.com", "google"), ("youtube.com", "google"), ("unknown-site.com", "unknown-site"), ("pharmacy.com", "apple"), ("www..com", "unknown"), ("", "unknown")])
def test_brand_families(spark, domain, family):
    assert one(spark, brand.brand_family(F.col("d")), d=("string", domain)) == family


def test_brand_tokens(spark):
    assert one(spark, brand.brand_family(F.col("d"), "token"), d=("string", "pharmacy.com")) == "pharmacy"


@pytest.mark.parametrize(("domain", "name"), [("apple.com", "technology"), ("jpmorgan.com", "finance"), ("amazon.com", "technology"), ("zzz.zz", "general")])
def test_industries(spark, domain, name):
    assert one(spark, brand.industry(F.col("d")), d=("string", domain)) == name


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("/a.png", "http://x.com/p/q?z", "http://x.com/a.png"), ("b.png", "http://x.com/p/q", "http://x.com/p/b.png"), ("../c.png?v=1", "http://x.com/p/q/r", "http://x.com/p/c.png?v=1"),
        ("//cdn.y/d", "https://x.com", "https://cdn.y/d"), ("http://z/e", "http://x.com", "http://z/e"), ("f.png", "http://x.com", "http://x.com/f.png"), ("#t", "http://x.com/p#s", "http://x.com/p#t"),
        ("?q=2", "http://x.com/p?q=1", "http://x.com/p?q=2"), ("g", "not a url", "g"), ("./h", "http://x.com/p/", "http://x.com/p/h"), ("data:x", "http://x.com", "data:x"),
    ],
)
def test_resolve_url(spark, url, base, want):
    assert one(spark, strings.resolve_url(F.col("u"), F.col("b")), u=("string", url), b=("string", base)) == want


def test_file_names(spark):
    get = lambda s: one(spark, strings.sanitize_filename(F.col("s")), s=("string", s))
    assert get('a<b>:"c/d') == "a_b_c_d" and get("..name. ") == "name._" and get("é ü") == "é_ü" and len(get("x" * 300)) == 100


def test_api_answers(spark):
    get = lambda api, body: one(spark, strings.api_json_logo(F.col("b"), F.lit(api)), b=("string", body))
    assert get("Wikipedia", '{"originalimage": {"source": "u"}}') == "u"
    assert get("Favicon Grabber", '{"icons": [{"src": "a", "sizes": "16x16"}, {"src": "b", "sizes": "9x9"}, {"src": "c"}]}') == "b"  # sizes compare as texts
    assert get("Google DNS Logo TXT", '{"Answer": [{"type": 1, "data": "http://n/x.png"}, {"type": 16, "data": "v=1 logo_url=https://l/y.png"}]}') == "https://l/y.png"
    assert get("SecurityTrails DNS", '{"domain": "d.com", "subdomains": ["www", "cdn1"]}') == "https://cdn1.d.com/logo.png"
    assert get("Wikidata", "{}") is None and get("Wikipedia", "broken") is None


def test_txt_records(spark):
    get = lambda t: one(spark, strings.txt_logo_url(F.col("t")), t=("string", t))
    assert get("LOGO-URL: http://a/b") == "http://a/b" and get("logo_url=ftp://a assets=https://c/d") == "https://c/d" and get("see https://x/y.SVG now") == "https://x/y.SVG" and get("none") is None


def test_image_kinds(spark):
    assert one(spark, strings.image_kind(F.col("d")), d=("binary", bytearray(b"\x89PNG\r\n\x1a\n....."))) == "png"
    assert one(spark, strings.image_kind(F.col("d")), d=("binary", bytearray(b"GIF89a......"))) == "gif" and one(spark, strings.image_kind(F.col("d")), d=("binary", bytearray(b"plain"))) is None


PAGE = """<script type="application/ld+json">{"@type": "Organization", "logo": "/a.png"}</script><script type="application/ld+json">{"@type": "Brand", "logo": {"url": "b.png"}}</script>
<script type="application/ld+json">oops</script><nav><img alt="our logo" src="/c.png"><img src="/plain.png"></nav><a href="/index"><img src="/d.png"></a><img id="site-logo" src="/e.png">
<link rel="apple-touch-icon" href="/t.png"><link rel="icon" href="/f.ico"><link rel="icon" href="/a.png">"""


def test_html_candidates(spark):
    got = one(spark, html.candidates(F.col("h"), F.lit("http://x.com/p/")), h=("string", PAGE))
    # the touch icon's link matches the icon pattern too, but its URL is known already
    assert [(c["method"], c["url"], c["priority"]) for c in got] == [("json-ld", "http://x.com/a.png", 1), ("json-ld", "http://x.com/p/b.png", 1), ("header-nav", "http://x.com/c.png", 2), ("homepage-link", "http://x.com/d.png", 3), ("apple-touch-icon", "http://x.com/t.png", 4)]
    full = one(spark, html.candidates_full(F.col("h"), F.lit("http://x.com/")), h=("string", PAGE))
    assert [c["method"] for c in full].count("logo-hints") == 2 and full[-1]["url"].endswith("a.png")
    assert len(one(spark, html.candidates_quick(F.col("h"), F.lit("http://x.com/")), h=("string", PAGE))) <= 5
    many = "".join(f'<link rel="icon" href="/{i}.png">' for i in range(30))
    assert len(one(spark, html.candidates(F.col("h"), F.lit("http://x.com/")), h=("string", many))) == 10
    assert one(spark, html.candidates(F.col("h"), F.lit("http://x.com/")), h=("string", "")) == []


# Vectors and fusion


def test_hashes_and_distances(spark):
    rng = random.Random(1)
    for d in (0, 1, 2, 3, 60, 61, 63, 64, 256):
        a = rng.getrandbits(256)
        b = a
        for i in rng.sample(range(256), d):
            b ^= 1 << i
        x, y = f"{a:064x}", f"{b:064x}"
        assert one(spark, vectors.hamming_hex(F.col("a"), F.col("b")), a=("string", x), b=("string", y)) == d
        assert one(spark, vectors.hamming_words(vectors.hex_words(F.col("a")), vectors.hex_words(F.col("b"))), a=("string", x), b=("string", y)) == d
        assert one(spark, vectors.hash_similarity(F.lit(d))) == max(0, (64 - d) / 64)


def test_correlation(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random(9).tolist(), rng.random(9).tolist()
    got = one(spark, vectors.correlation_max(F.col("a"), F.col("b")), a=("array<double>", a), b=("array<double>", b))
    assert got == pytest.approx(image.correlation_max(np.array(a), np.array(b))) and got == pytest.approx(max(np.correlate(a, b, "full")))
    round_ = one(spark, vectors.correlation_max(F.col("a"), F.col("b"), True), a=("array<double>", a), b=("array<double>", b))
    assert round_ == pytest.approx(max(np.dot(a, np.roll(b, k)) for k in range(9)))


def test_weighted_similarity(spark):
    c = Config.preset("ultra_relaxed")
    s = fusion.weighted_similarity(c, F.lit(0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(4))
    assert one(spark, s) == 1.0
    assert one(spark, fusion.weighted_similarity(c, F.lit(0), F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0), F.lit(False), F.lit(0))) == pytest.approx((0.5 + 0.125 + 0.1) / 2)
    assert PRESETS["strict"].orb == 15


def test_calibrated_uses_positive_channels_only(spark):
    got = one(spark, fusion.calibrated_fusion(F.lit(0.8), F.lit(0.0), F.lit(-0.5), F.lit(None).cast("double"), F.lit(0.4)))
    assert got == pytest.approx((0.35 * 0.8 + 0.05 * 0.8) / 0.4)


# Blocking and graphs


@pytest.mark.parametrize("distance", [0, 1, 3, 7])
def test_pigeonhole_is_exact(spark, distance):
    rng = random.Random(distance)
    words = [rng.getrandbits(63)]
    for _ in range(60):
        w = rng.choice(words)
        for i in rng.sample(range(64), rng.randint(0, 6)):
            w ^= 1 << i
        words.append(w)
    words = [w - (1 << 64) if w >= 1 << 63 else w for w in words]
    df = spark.createDataFrame(list(enumerate(words)), "id long, w long")
    got = {(r["id_a"], r["id_b"], r["distance"]) for r in blocking.hamming_pairs(df, "w", distance).collect()}
    dist = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert got == {(i, j, dist(words[i], words[j])) for i in range(61) for j in range(i + 1, 61) if dist(words[i], words[j]) <= distance}


def test_blocking_meets_few_pairs(spark):
    rng, n = random.Random(1), 3000
    words = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
    df = spark.createDataFrame([(w,) for w in words], "w long")
    for distance, most in ((6, 0.02), (8, 0.05)):
        masks = blocking.scheme(64, distance, n)
        assert blocking.word_candidates(df, df, masks).filter("wa < wb").count() < most * n * n / 2
    for rows in (1, 10**4, 10**7):  # whatever the scheme, words that differ in so many bits share a key
        masks = blocking.scheme(64, 6, rows)
        for _ in range(200):
            flips = sum(1 << i for i in rng.sample(range(64), 6))
            assert any(not flips & m for m in masks)


#: Queries on measured pairs: on small data every join of them could be a broadcast.
MEASURED = ["l1_and_euclidean", "score_histogram", "threshold_curve", "or_rule_reason", "method_correlation", "other_decisions", "weighted_similarity"]


@pytest.mark.parametrize("name", MEASURED)
def test_measured_pairs_are_never_broadcast(spark, sf, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and "Broadcast" not in plan


@pytest.mark.parametrize("name", MEASURED)
def test_measured_pairs_are_not_broadcast_once_their_sizes_are_known(spark, sf, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["id"]: r["label"] for r in graph.connected_components(df).collect()}


def test_features_of_pairs_are_never_broadcast(spark):
    pairs = spark.createDataFrame([(1, 2)], "id_a long, id_b long")
    wide = blocking.with_features(pairs, spark.range(3).withColumn("v", F.col("id") * 10), "id", "v")
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert [tuple(r) for r in wide.select("id_a", "id_b", "v_a", "v_b").collect()] == [(1, 2, 10, 20)]


@pytest.mark.parametrize(("bits", "distance", "rows"), [(64, 8, 300_000), (64, 8, 10**7), (64, 6, 1), (64, 64, 1), (16, 2, 10**4)])
def test_of_the_shared_keys_the_first_counts(spark, bits, distance, rows):
    rng, masks = random.Random(bits + distance + rows), blocking.scheme(bits, distance, rows)
    differ = [0, *[sum(1 << i for i in rng.sample(range(bits), rng.randint(1, min(distance, 10)))) for _ in range(40)]]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(i, signed(x), k, m) for i, x in enumerate(differ) for k, m in enumerate(masks) if not x & m], "i long, x long, k long, mask long")
    got = df.filter(blocking._first_key(F.col("mask"), F.col("x"), blocking._segments(bits, distance, rows)[0])).select("i", "k").collect()
    want = [(i, next(k for k, m in enumerate(masks) if not x & m)) for i, x in enumerate(differ) if any(not x & m for m in masks)]
    assert sorted(tuple(r) for r in got) == want


def test_shared_keys_are_compared_without_a_list_of_all_keys(spark):
    words = spark.range(50).select(F.xxhash64("id").alias("w"))
    plan = blocking.near_words(words, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "get(" not in plan


def test_no_table_of_keys_is_broadcast(spark):
    df = spark.range(300).select("id", F.xxhash64("id").alias("word"))
    plan = blocking.hamming_pairs(df, "word", 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    assert components(spark, [(0, 1), (2, 3), (1, 4)]) == {0: 0, 1: 0, 4: 0, 2: 2, 3: 2}
    chain = list(range(60))
    random.Random(3).shuffle(chain)
    assert set(components(spark, list(zip(chain, chain[1:], strict=False))).values()) == {0}
    assert components(spark, [(5, i) for i in range(6, 40)] + [(7, 7), (99, 99), (5, 6), (None, 3)])[39] == 5
    assert components(spark, [(99, 99)]) == {99: 99}
    assert spark.createDataFrame([], "a long, b long").transform(graph.connected_components).count() == 0
    rng = random.Random(4)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)]
    parent = list(range(201))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert components(spark, edges) == {x: find(x) for e in edges for x in e}


def test_components_make_the_pairs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 5)], "a long, b long").mapInArrow(count, "a long, b long")
    assert {tuple(r) for r in graph.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5)}
    assert made.value == 3


def test_greedy_merge(spark):
    assert merge.greedy_groups(list("abcdef"), lambda i, j: (i - j) % 2 == 0, 2) == [["a", "c"], ["b", "d"], ["e"], ["f"]]
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, k int")
    rows = merge.merge_singletons(df, lambda a, b: a["k"] == b["k"]).collect()
    assert {r["id"]: r["seed"] for r in rows} == {i: i % 3 for i in range(9)}


# Reports


def test_reports_on_sizes(spark):
    sizes = [1, 2, 5, 6, 10, 11, 15, 16, 20, 21, 50, 51]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "cluster_id long, size long")
    s = reports.size_stats(df).first()
    assert s["upper_median"] == sorted(sizes)[6] and s["median"] == np.median(sizes) and s["std_size"] == pytest.approx(np.std(sizes), abs=1e-5)
    assert {r["bucket"]: r["clusters"] for r in reports.size_histogram(df).collect()} == {"1": 1, "2-5": 2, "6-10": 2, "11-20": 4, ">20": 3}
    assert {r["bucket"]: r["clusters"] for r in reports.size_histogram(df, reports.SIZE_B).collect()} == {"<=5": 3, "6-15": 4, "16-50": 4, ">50": 1}
    assert reports.size_histogram(df.limit(0)).filter("clusters = 0").count() == 5
    lines = [r["line"] for r in reports.report_lines(reports.size_stats(df), df).collect()]
    assert lines[0] == "Cluster report" and lines[-1].startswith("size >20: 3")


def test_coherence_boundary(spark):
    rows = [(1, "a")] * 7 + [(1, "b")] * 3 + [(2, "a"), (2, "b")] + [(3, "a")] * 2 + [(4, "x")] + [(5, "a")] * 6 + [(5, "b")] * 4
    r = reports.brand_coherence(spark.createDataFrame(rows, "cluster_id long, brand string")).first()
    assert (r["clusters"], r["coherent"]) == (4, 2)


def test_principal_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    out, share = reports.principal_components(df, "v", 5)
    got = np.array([[r["pc1"], r["pc2"]] for r in out.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2])) and share.first()["explained"] == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_cosine_top_pairs_are_those_of_all_pairs(spark, sf):
    import __spark_entry__ as entry

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    unit = np.array([r["embedding"] for r in rows], float)
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    ids, cos = [r["vec_id"] for r in rows], unit @ unit.T
    want = sorted((-round(cos[i, j], 12), *sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i))[:50]
    got = entry.queries()["cosine_pairs_topk"](spark, sf).collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [w[1:] for w in want]
    assert np.allclose([r["cos"] for r in got], [-w[0] for w in want], atol=1e-6)


def test_cosine_top_pairs_edges(spark):
    rows = [(i, [1.0, 2.0]) for i in range(9)] + [(20, [0.0, 0.0]), (21, None), (22, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = [(r["id_a"], r["id_b"]) for r in reports.cosine_top_pairs(df, "v", 5, rows=2).collect()]
    assert got == [(0, i) for i in range(1, 6)]
    assert reports.cosine_top_pairs(df, "v", 100, rows=2).count() == 45
    assert reports.cosine_top_pairs(df.limit(0), "v", 5).count() == 0


def test_throughput(spark):
    rate, left = reports.throughput(F.lit(50), F.lit(5.0), F.lit(100))
    assert one(spark, rate) == 10 and one(spark, left) == 5


# Sources and sinks


def test_column_inference(spark):
    df = lambda *names: spark.createDataFrame([tuple("x" for _ in names)], list(names))
    assert readers.website_column(df("id", "link", "url")) == "url" and readers.website_column(df("id", "my_web_page")) == "my_web_page" and readers.website_column(df("a", "b")) == "a"
    with pytest.raises(ValueError):
        readers.website_column(df("a", "b"), strict=True)


def test_lists_and_samples(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a.com\n\n b.com \n")
    assert [r[0] for r in readers.read_sites(spark, str(tmp_path / "s.txt")).collect()] == ["a.com", "b.com"]
    df = spark.createDataFrame([(i,) for i in range(50)], "id long")
    assert readers.sample_by_hash(df, 7, "id").collect() == readers.sample_by_hash(df.repartition(9), 7, "id").collect()
    assert readers.sample_sites(spark).count() > 5


def test_registry(spark, tmp_path):
    own = registry.built_in(spark)
    assert own.count() == 49 and {r["tier"]: r["n"] for r in registry.tier_sizes(own).collect()} == {1: 5, 2: 5, 3: 7, 4: 5, 5: 3, 6: 12, 7: 4, 8: 8}
    (tmp_path / "r.json").write_text('{"logo_apis": [{"name": "Clearbit", "url": "x"}, {"name": "My API", "url": "http://m/{domain}", "params": {"b": "2", "a": "1"}}]}')
    both = registry.merged(own, registry.from_json(spark, str(tmp_path / "r.json")))
    new = both.filter("name = 'My API'").first()
    assert both.count() == 50 and new["url"] == "http://m/{domain}?a=1&b=2" and new["tier"] == 5 and new["timeout"] == 5
    urls = [r["url"] for r in registry.requests(spark.createDataFrame([("d.com",)], "domain string"), own, max_tier=2).orderBy("pos").collect()]
    assert urls[0] == "https://logo.clearbit.com/d.com" and "domain=d.com&sz=128" in urls[5]


def test_tiered_fetching(spark):
    def fake_fetch(url, timeout, headers):
        """Images for a.com at tier two, for b.com only at a direct address; errors elsewhere."""
        if "a.com" in url and "google" in url or url == "https://www.b.com/favicon.ico":
            return 200, "image/png", b"x" * 600
        if "c.com" in url:
            raise TimeoutError("too slow")
        return 404, "text/html", b""

    sites = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",)], "domain string")
    rows = {r["domain"]: r for r in fetch.fetch_tiered(registry.requests(sites, registry.built_in(spark), max_tier=3), fake_fetch).collect()}
    assert rows["a.com"]["source"] == "Google Favicon" and rows["a.com"]["attempts"] == 10 and rows["a.com"]["tier_used"] == 2
    assert not rows["b.com"]["success"] and rows["b.com"]["attempts"] == 17 and "too slow" in rows["c.com"]["error"]
    out = {r["domain"]: r for r in pipelines.extract_images(sites, registry.built_in(spark), fake_fetch, max_tier=3).collect()}
    assert out["b.com"]["success"] and out["b.com"]["recovered"] and not out["a.com"]["recovered"]


ANSWERS = [
    ("Wikipedia", '{"thumbnail": {"source": "https://w/t.png"}}', "https://w/t.png"),
    ("Wikipedia", '{"originalimage": {"source": "https://w/o.png"}}', "https://w/o.png"),
    ("Favicon Grabber", '{"icons": [{"src": "https://g/1"}, {"src": "https://g/2", "sizes": "64x64"}, {"src": "https://g/3", "sizes": "64x64"}]}', "https://g/2"),
    ("Google DNS Logo TXT", '{"Answer": [{"type": 1, "data": "logo_url=https://d/no"}, {"type": 16, "data": "logo_url=ftp://d/no"}, {"type": 16, "data": "v=1 Logo-URL: https://d/l.png"}]}', "https://d/l.png"),
    ("SecurityTrails DNS", '{"domain": "s.com", "subdomains": ["www", "MyBrand"]}', "https://MyBrand.s.com/logo.png"),
    ("Wikipedia", "{}", None),
    ("Favicon Grabber", '{"icons": []}', None),
    ("Wikidata", '{"search": [1]}', None),
    ("Wikipedia", "not JSON", None),
]


def test_answers_name_the_same_image_in_both_forms(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(ANSWERS)], "i int, api string, body string, want string")
    got = rows.select("i", strings.api_json_logo(F.col("body"), F.col("api")).alias("got")).orderBy("i").collect()
    assert [r["got"] for r in got] == [w for _, _, w in ANSWERS] == [fetch.named_image(a, b.encode()) for a, b, _ in ANSWERS]
    assert fetch.named_image("Wikipedia", b"\xff\xfe[") is None and fetch.named_image("Wikipedia", b"[1]") is None


def test_an_answer_leads_to_its_image(spark):
    def fake_fetch(url, timeout, headers):
        """JSON that names an image for a.com, one that is gone for b.com."""
        if "wikipedia.org" in url:
            host = "a" if url.endswith("a.com") else "b"
            return 200, "application/json", ('{"thumbnail": {"source": "https://img.org/%s.png"}}' % host).encode()
        if url == "https://img.org/a.png":
            return 200, "image/png", b"x" * 600
        return 404, "text/html", b""

    sites = spark.createDataFrame([("a.com",), ("b.com",)], "domain string")
    only = registry.built_in(spark).filter("name in ('Wikipedia', 'Wikidata')")
    rows = {r["domain"]: r for r in fetch.fetch_tiered(registry.requests(sites, only), fake_fetch).collect()}
    assert rows["a.com"]["success"] and rows["a.com"]["source"] == "Wikipedia" and rows["a.com"]["size_bytes"] == 600 and rows["a.com"]["attempts"] == 2
    assert not rows["b.com"]["success"] and rows["b.com"]["attempts"] == 2


def test_a_page_leads_to_its_image(spark):
    def fake_fetch(url, timeout, headers):
        return (200, "image/png", b"x" * 600) if url == "https://a.com/touch.png" else (404, "text/html", b"")

    html = '<header><img class="logo" src="/gone.png"></header><link rel="apple-touch-icon" href="/touch.png">'
    pages = spark.createDataFrame([("a.com", "https://a.com/", html), ("b.com", "https://b.com/", "<p>none</p>"), ("c.com", "https://c.com/", None)], "domain string, url string, html string")
    rows = {r["domain"]: r for r in fetch.fetch_candidates(pages, fake_fetch).collect()}
    assert rows["a.com"]["source"] == "apple-touch-icon" and rows["a.com"]["attempts"] == 2
    assert not rows["b.com"]["success"] and not rows["c.com"]["success"] and rows["c.com"]["attempts"] == 0


def test_fallback_edges(spark):
    df = spark.createDataFrame([("a", 1, 1, False, "x"), ("a", 2, 1, True, "y"), ("a", 1, 2, True, "z"), ("b", 1, 1, False, "x")], "domain string, tier int, pos int, success boolean, source string")
    rows = {r["domain"]: r for r in fallback.first_success(df).collect()}
    assert rows["a"]["source"] == "z" and rows["b"]["source"] is None and not rows["b"]["success"] and rows["a"]["n_tried"] == 3
    assert fallback.first_success(df.limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("http://www.a.com", b"1"), ("a.org", b"22"), ("b?.x", b"333")], "domain string, content binary")
    named = sinks.with_file_names(rows)
    assert sorted(r["file_name"] for r in named.collect()) == ["a.jpg", "a_1.jpg", "b_.jpg"]
    out = sinks.export_images(named, f"file://{tmp_path}/img")
    assert sum(r["size_bytes"] for r in out.collect()) == 6 and len(list((tmp_path / "img").iterdir())) == 3
    clusters = spark.createDataFrame([(1, "a.com", 2), (1, "b.com", 2)], "cluster_id int, domain string, cluster_size int")
    sinks.write_clusters_csv(clusters, f"{tmp_path}/c")
    assert readers.read_clusters_csv(spark, f"{tmp_path}/c").count() == 2


def test_caches(spark):
    cache = spark.createDataFrame([("k1", "2024-01-01 00:00:00"), ("k2", "2024-01-01 23:00:00")], "url string, written_at string").withColumn("written_at", F.col("written_at").cast("timestamp")).withColumn("candidates", F.array())
    live = readers.live_cache(cache, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert [r["url"] for r in live.collect()] == ["k2"]


# Images


def picture(seed=0, h=96, w=120):
    rng = np.random.default_rng(seed)
    img = np.full((h, w, 3), 230, np.uint8)
    for _ in range(6):
        y, x = rng.integers(5, h - 30), rng.integers(5, w - 30)
        img[y : y + rng.integers(8, 25), x : x + rng.integers(8, 25)] = rng.integers(0, 255, 3)
    return img


def bits(hex_text):
    return bin(int(hex_text, 16))[2:].zfill(256)


def apart(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def test_decoding():
    img = picture()
    assert np.array_equal(image.decode(image.encode_png(img)), img)
    alpha = np.dstack([img, np.zeros(img.shape[:2], np.uint8)])
    assert (image.decode(image.encode_png(alpha)) == 255).all()
    h, w = img.shape[:2]
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + img[::-1].tobytes()
    assert np.array_equal(image.decode(bmp), img)
    for bad in (None, b"", b"junk", image.encode_png(img)[:60], image.encode_png(picture(1)[:8, :8])):
        assert image.decode(bad) is None
    assert image.g3_features(b"junk")["valid"] is False


def test_hash_invariances():
    a, b = picture(1), picture(2)
    bright = np.clip(a.astype(int) + 10, 0, 255).astype(np.uint8)
    for f in (image.phash, image.dct_hash, image.fft_hash):
        assert f(a) == f(a.copy())
    assert apart(bits(image.phash(a)), bits(image.phash(bright))) < 20 < apart(bits(image.phash(a)), bits(image.phash(b)))
    turned = np.ascontiguousarray(np.rot90(a))
    assert image.hsv_histogram(a) == pytest.approx(image.hsv_histogram(turned), abs=1e-9)
    assert image.hsv_histogram(a).reshape(3, 10).sum(1) == pytest.approx([1, 1, 1], abs=1e-5)
    assert image.hu_moments(a)[:6] == pytest.approx(image.hu_moments(turned)[:6], rel=0.05)
    assert len(image.zernike(a)) == 42 and len(image.fft_features(a)) == 1024 and len(image.fmt_signature(a)) == 64 and len(image.color_fmt(a)) == 48 and len(image.saliency_fft(a)) == 1024
    assert image.fused_hash(a).sum() == 32 and np.array_equal(image.fused_hash(a), image.fused_hash(a.copy()))
    assert image.composition(np.full((20, 60, 3), 9, np.uint8)) == {"text_score": 1.0, "symbol_score": 0.0, "edge_density": 0.0, "layout": "horizontal"}


def test_texture_and_colour():
    flat, a = np.full((64, 64, 3), 100, np.uint8), picture(3)
    assert image.glcm_stats(flat) == pytest.approx([0, 1, 1, 1]) and image.rgb_moments(flat)[1] == 0
    assert image.rgb_moments(a)[0] == pytest.approx(a[:, :, 2].mean() / 255) and len(image.lbp_stats(a)) == 3 and len(image.gabor_stats(a)) == 12 and len(image.hsv_moments(a)) == 6
    red = np.zeros((20, 20, 3), np.uint8)
    red[:, :, 2] = 255
    assert image.hsv(red)[0, 0].tolist() == [0, 255, 255] and image.dominant_colors(red)[:4].tolist() == [255, 0, 0, 1]
    assert image.palette(red)["color_count"] == 5 and image.color_vector(red) == pytest.approx([1, 0, 0, 1, 1])
    assert image.ssim(a, a) == pytest.approx(1) and image.ssim(a, picture(4)) < 0.9 and len(image.hog(a)) == 1764 and image.edge_histogram(a).sum() == pytest.approx(1)
    assert len(image.average_hash(a)) == len(image.difference_hash(a)) == 64


def test_dominant_colours_are_those_of_plain_means():
    for seed, shades in ((0, 3), (1, 9), (2, 256)):
        img = np.random.default_rng(seed).integers(0, shades, (20, 30, 3)).astype(np.uint8)
        px, rng, best = img[:, :, ::-1].reshape(-1, 3).astype(float), np.random.default_rng(0), (np.inf,)
        for _ in range(10):
            c = px[rng.choice(len(px), 3, replace=False)]
            for _ in range(20):
                d = ((px[:, None] - c) ** 2).sum(2)
                own = d.argmin(1)
                new = np.array([px[own == i].mean(0) if (own == i).any() else c[i] for i in range(3)])
                if np.allclose(new, c):
                    break
                c = new
            best = min(best, (d.min(1).sum(), c, np.bincount(own, minlength=3) / len(px)), key=lambda t: t[0])
        order = np.argsort(-best[2], kind="stable")
        assert image.dominant_colors(img) == pytest.approx(np.hstack([best[1][order], best[2][order, None]]).ravel())


def test_pictures_are_dealt_out_to_all_tasks(spark):
    from pyspark import TaskContext

    df = spark.range(60).select("id", F.col("id").cast("string").cast("binary").alias("content"))
    made = image.with_features(df, lambda data: {"task": TaskContext.get().partitionId()}, "task int")
    assert made.select("features.task").distinct().count() == 4 and made.count() == 60


def test_average_hash_settles_ties_by_colour():
    for seed in range(40):
        half = np.random.default_rng(seed).integers(1, 120, 31)
        x = np.concatenate([120 + half, 120 - half, [120, 120]])  # the mean is the last two cells' shade
        img = np.repeat(np.repeat(np.dstack([x, x, 255 - x]).reshape(8, 8, 3).astype(np.uint8), 6, 0), 8, 1)
        shades = [0.114 * v + 0.587 * v + 0.299 * (255 - v) for v in map(float, x)]
        total = 0.0
        for v in shades:
            total += v
        assert image.average_hash(img) == "".join("1" if v > total / 64 else "0" for v in shades)
    odd = np.random.default_rng(5).integers(0, 256, (5, 21, 3)).astype(np.uint8)  # enlarged one way, shrunk the other by no whole number
    g = image.resize(image.grey(odd), 8, 8).ravel()
    assert image.average_hash(odd) == "".join("1" if v > g.mean() else "0" for v in g)


def test_keypoints():
    a, b = picture(5), picture(6)
    for make, match in ((image.orb, lambda x, y: image.match_orb(x, y)[1]), (image.sift, image.match_sift)):
        x, y = make(a), make(b)
        assert 3 < len(x) <= 100 and match(x, x) > 0.6 > match(x, y)
        assert match(x, x[:0]) == 0
    assert len(image.signature(image.sift(a), True)) == 256 and len(image.signature(image.orb(a))) == 32


def test_clustering_pipeline(spark, tmp_path):
    a, b = picture(7), picture(8)
    bright = np.clip(a.astype(int) + 4, 0, 255).astype(np.uint8)
    rows = [("a1.com", a), ("a2.com", a), ("a3.com", bright), ("google.com", b), ("youtube.com", picture(9)), ("odd.com", None)]
    for name, img in rows:
        (tmp_path / f"{name}.png").write_bytes(b"broken" if img is None else image.encode_png(img))
    out = pipelines.run_clustering(spark, str(tmp_path))
    members = {r["domain"]: r["cluster_id"] for r in out["membership"].collect()}
    assert members["a1.com"] == members["a2.com"] and members["google.com"] == members["youtube.com"] and "odd.com" not in members
    assert out["features"].filter("not valid").count() == 1 and out["metrics"].first()["members"] == 5


def test_research_pipeline(spark):
    a = picture(10)
    rows = [(1, "a.com", image.encode_png(a)), (2, "b.com", image.encode_png(a)), (3, "c.com", image.encode_png(picture(11))), (4, "d.com", b"x")]
    out = pipelines.cluster_research(spark.createDataFrame(rows, "id long, domain string, content binary"))
    labels = {r["id"]: r["label"] for r in out["membership"].collect()}
    assert labels[1] == labels[2] == 1 and 4 not in labels and out["pairs"].count() == 3
    assert out["pairs"].filter("id_a = 1 and id_b = 2").first()["score"] == pytest.approx(1, abs=0.01)


# Streaming


def test_incremental_clusters(spark, tmp_path):
    rng = random.Random(5)
    words = [rng.getrandbits(62) for _ in range(8)]
    words += [w ^ 1 for w in words[:4]]
    frame = pd.DataFrame({"id": range(12), "word": words})
    for part in range(3):
        spark.createDataFrame(frame[part::3]).write.mode("append").parquet(f"{tmp_path}/in")
    runner = HashClusters(f"{tmp_path}/state", 2)
    stream = spark.readStream.schema("id long, word long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = runner.start(stream, f"{tmp_path}/cp")
    q.awaitTermination(120)
    labels = {r["id"]: r["label"] for r in runner.labels(spark).collect()}
    assert labels == {i: i - 8 if i >= 8 else i for i in range(12)}


def test_entry_contract(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """The first 80 vectors and documents, as a folder of tables."""
    folder = f"file://{tmp_path_factory.mktemp('small')}"
    spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 80").write.parquet(f"{folder}/embeddings.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 80").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_research_features_of_every_picture(spark, small):
    import __spark_entry__ as entry

    row = entry.queries()["image_research_features"](spark, small).first()
    assert (row["images"], row["valid"]) == (80, 80)


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cluster_id"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def test_singleton_merge_meets_every_single(spark, small):
    import __spark_entry__ as entry
    from kindred import queries as own

    rows = sorted(own.hashes(spark, small).select("id", "word", "label").collect(), key=lambda r: r["id"])
    bits = lambda a, b: bin((a["word"] ^ b["word"]) & (1 << 64) - 1).count("1")
    group = {r["id"]: {r["id"]} for r in rows}
    for a in rows:
        for b in rows:
            if bits(a, b) <= own.BITS and group[a["id"]] is not group[b["id"]]:
                both = group[a["id"]] | group[b["id"]]
                group |= dict.fromkeys(both, both)
    single = [r for r in rows if len(group[r["id"]]) == 1]
    merged = merge.greedy_groups([r["id"] for r in single], lambda i, j: bits(single[i], single[j]) <= 10 or single[i]["label"] == single[j]["label"])
    want = merged + [sorted(g) for g in {min(g): g for g in group.values() if len(g) > 1}.values()]
    assert groups_of(entry.queries()["singleton_merge"](spark, small).collect()) == sorted(want)


def test_image_clusters_meet_every_single(spark, small):
    import __spark_entry__ as entry
    from kindred import queries as own

    out = pipelines.cluster_images(own.pictures(spark, small), Config.preset("strict"))
    got = groups_of(entry.queries()["image_clusters"](spark, small).collect())
    assert got == groups_of(out["membership"].collect())
    features = {r["id"]: r.asDict() for r in out["features"].filter("valid").collect()}
    accepts = pipelines.accepts_singleton(Config.preset("strict"))
    ones = [g[0] for g in got if len(g) == 1]
    assert not any(accepts(features[a], features[b]) for a in ones for b in ones if a < b)


def test_correlation_of_whole_vectors(spark, small):
    import __spark_entry__ as entry

    from kindred import queries as own

    e = {r["id"]: np.array(r["embedding"], float) for r in own.edited(spark, small).collect()}
    got = entry.queries()["corr_max_linear"](spark, small).collect()
    assert got and all(r["corr"] == pytest.approx(max(0, np.correlate(e[r["id_a"]], e[r["id_b"]], "full").max()), abs=2e-6) for r in got)


def test_hex_distance_of_every_neighbour(spark, small):
    import __spark_entry__ as entry
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    number = {i: int(hashlib.sha256(t.encode()).hexdigest(), 16) for i, t in texts.items()}
    got = {(r["a"], r["b"]): r["distance"] for r in entry.queries()["hamming_hex256"](spark, small).collect()}
    assert got == {(i, i + 1): bin(number[i] ^ number[i + 1]).count("1") for i in number if i + 1 in number}


def test_jpeg_files_are_decoded_by_the_engine(spark, tmp_path):
    from kindred.sources import readers

    jvm = spark.sparkContext._jvm
    made = jvm.java.awt.image.BufferedImage(32, 24, 1)
    for y in range(24):
        for x in range(32):
            made.setRGB(x, y, 0xC83214 if x < 16 else 0x1432C8)
    assert jvm.javax.imageio.ImageIO.write(made, "jpg", jvm.java.io.File(f"{tmp_path}/a.com.jpg"))
    (tmp_path / "b.com.jpg").write_bytes(b"no picture")
    (tmp_path / "c.com.png").write_bytes(image.encode_png(picture(1)))
    rows = {r["domain"]: r for r in readers.scan_images(spark, f"file://{tmp_path}").collect()}
    img = image.decode(bytes(rows["a.com"]["content"]))
    assert img.shape == (24, 32, 3) and np.abs(img[12, 4].astype(int) - [0x14, 0x32, 0xC8]).max() < 12 and np.abs(img[12, 28].astype(int) - [0xC8, 0x32, 0x14]).max() < 12
    assert image.decode(bytes(rows["b.com"]["content"] or b"")) is None and image.decode(bytes(rows["c.com"]["content"])) is not None
    assert pipelines.run_clustering(spark, f"file://{tmp_path}")["features"].filter("valid").count() == 2


def test_registered_functions(spark):
    from kindred.functions.register import register

    names = register(spark)
    spark.createDataFrame([(1, bytearray(image.encode_png(picture(1)))), (2, bytearray(b"x"))], "id int, content binary").createOrReplaceTempView("imgs")
    rows = {r["id"]: r for r in spark.sql("select id, image_phash(content) h, size(image_hsv_histogram(content)) n from imgs").collect()}
    assert rows[1]["h"] == image.phash(picture(1)) and rows[1]["n"] == 30 and rows[2]["h"] is None and len(names) > 10
    assert [r["href"] for r in spark.sql("select * from html_links('<a href=\"/x\">1</a><a class=q href=\"/y\">2</a>')").collect()] == ["/x", "/y"]


def test_command_line(spark, tmp_path):
    from kindred.__main__ import main

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"d{i}.png").write_bytes(image.encode_png(picture(i % 2)))
    main([str(tmp_path / "in"), f"file://{tmp_path}/out", "--preset", "moderate", "--shards", "2"])
    assert spark.read.parquet(f"{tmp_path}/out/membership").count() == 3 and spark.read.text(f"{tmp_path}/out/report").count() > 10


def test_event_windows(spark, sf, tmp_path):
    from kindred.streaming.incremental import attempts_by_window

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/e").schema).parquet(f"{tmp_path}/e")
    q = attempts_by_window(stream, late="1000 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
