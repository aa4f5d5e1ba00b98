"""Rules, scores, merging, comparison, exploring and reports on literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X
from crawlquarry.operators import compare, engine, explore, merge, persist, report, rollups
from crawlquarry.operators.rules import CATALOGUE, RECORD, Rule, usable

FIELDS = [f.split(" ", 1)[0] for f in RECORD.split(", ")]
GOOD = {
    "audit_id": "a", "content_type": "text/html", "status_code": 200, "indexability": "INDEXABLE", "title_length": 40, "meta_description": "d", "meta_description_length": 100, "meta_robots": "index",
    "word_count": 500, "crawl_depth": 1, "inlinks": 3, "outlinks": 2, "response_time_ms": 100, "images": 1, "images_missing_alt": 0, "in_sitemap": True, "raw_issues": [],
}


def pages(spark, rows):
    full = []
    for n, r in enumerate(rows):
        url = r.get("url", f"https://x.test/{n}")
        full.append(GOOD | {"ord": n, "url": url, "title": f"T{n}", "h1": f"H{n}", "canonical": url} | r)
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in full], RECORD)


def hits(spark, rows):
    return {(r.rule_key, r.ord, r.evidence) for r in engine.matches(engine.records(pages(spark, rows))).collect()}


CASES = [
    ({}, set()),
    ({"meta_robots": "NOINDEX, follow"}, {("INDEXABLE_NOINDEX", "NOINDEX, follow")}),
    ({"meta_robots": "noindex", "status_code": None}, set()),
    ({"indexability": "NON_INDEXABLE", "indexability_status": "x", "title": None}, {("NON_INDEXABLE_PAGES", "x")}),
    ({"indexability": None, "title": None}, set()),
    ({"inlinks": None}, {("ORPHAN_PAGES", "0 inlinks")}),
    ({"inlinks": 0, "content_type": "image/png"}, set()),
    ({"crawl_depth": 5}, set()),
    ({"crawl_depth": 6}, {("DEEP_PAGES", "depth 6")}),
    ({"status_code": 700, "inlinks": 0, "indexability": "UNKNOWN"}, {("STATUS_5XX", "HTTP 700")}),
    ({"status_code": 404}, {("STATUS_4XX", "HTTP 404"), ("BROKEN_INTERNAL_LINKS", "HTTP 404, 3 inlinks")}),
    ({"status_code": 301, "redirect_url": None}, {("REDIRECT_3XX", "→ ?")}),
    ({"status_code": 301, "redirect_url": ""}, {("REDIRECT_3XX", "→ ")}),
    ({"url": "https://x.test/self", "redirect_url": "https://x.test/self"}, {("REDIRECT_CHAIN", "→ https://x.test/self")}),
    ({"canonical": "   "}, {("CANONICAL_MISSING", None)}),
    ({"canonical": "https://other.test/", "content_type": None}, {("CANONICAL_NON_SELF", "canonical → https://other.test/")}),
    ({"title": "\t"}, {("META_TITLE_MISSING", None)}),
    ({"title_length": 29}, {("META_TITLE_LENGTH", "29 caratteri")}),
    ({"title_length": 60}, set()),
    ({"title_length": None}, set()),
    ({"meta_description": ""}, {("META_DESC_MISSING", None)}),
    ({"meta_description_length": 161, "content_type": "image/png"}, {("META_DESC_LENGTH", "161 caratteri")}),
    ({"h1": None}, {("H1_MISSING", None)}),
    ({"word_count": 199}, {("THIN_CONTENT", "199 parole")}),
    ({"word_count": None}, set()),
    ({"images_missing_alt": 2}, {("IMAGES_MISSING_ALT", "2 immagini")}),
    ({"raw_issues": ["bad HREFLANG", None]}, {("HREFLANG_ERROR", None)}),
    ({"raw_issues": ["Schema x"]}, {("STRUCTURED_DATA_INVALID", None)}),
    ({"response_time_ms": 1000}, set()),
    ({"response_time_ms": 1001}, {("SLOW_RESPONSE", "1001 ms")}),
    ({"in_sitemap": None}, set()),
    ({"in_sitemap": False}, {("INDEXABLE_NOT_IN_SITEMAP", None)}),
    ({"url": "HTTP://x.test/p"}, {("NON_HTTPS", None)}),
]


def test_row_rules(spark):
    got = hits(spark, [r for r, _ in CASES])
    for n, (r, want) in enumerate(CASES):
        assert {(k, e) for k, o, e in got if o == n} == want, r


def test_redirects_and_groups(spark):
    rows = [
        {"url": "A", "redirect_url": "B", "status_code": 301}, {"url": "B", "redirect_url": "A", "status_code": 301}, {"url": "C", "redirect_url": "D", "status_code": 301}, {"url": "E", "redirect_url": "A", "status_code": 301, "audit_id": "b"},
        {"title": " Foo "}, {"title": "foo"}, {"title": "FOO", "indexability": "NON_INDEXABLE"}, {"h1": "same", "content_type": "image/png"}, {"h1": "SAME"}, {"title": "foo", "audit_id": "b"},
    ]
    got = hits(spark, rows)
    assert {o for k, o, _ in got if k == "REDIRECT_CHAIN"} == {0, 1}
    assert {(o, e) for k, o, e in got if k == "META_TITLE_DUPLICATE"} == {(4, "2 occorrenze"), (5, "2 occorrenze")}
    assert {o for k, o, _ in got if k == "H1_DUPLICATE"} == {7, 8}


def test_a_faulty_rule_is_left_out(spark):
    bad = Rule("BAD", "X", "LOW", "P3", "LOW", "", "", lambda: F.col("no_such_column") > 1)
    assert [r.key for r in usable(spark, [*CATALOGUE[:2], bad])] == [r.key for r in CATALOGUE[:2]]


def found(spark, rows):
    """Issues from (audit, rule, affected, total)."""
    h = spark.createDataFrame([(a, k, n, t) for a, k, n, t in rows], "audit_id string, rule_key string, affected bigint, total bigint")
    from crawlquarry.operators.rules import metadata

    return h.join(metadata(spark), "rule_key").withColumn("pct", X.rounded(F.col("affected") / F.col("total") * 100, tenths=True))


def test_penalties(spark):
    by = {"CRITICAL": "STATUS_5XX", "HIGH": "STATUS_4XX", "MEDIUM": "REDIRECT_3XX", "LOW": "DEEP_PAGES"}
    want = {"CRITICAL": [130, 162, 250, 250, 250], "HIGH": [78, 97, 171, 180, 180], "MEDIUM": [39, 49, 85, 90, 90], "LOW": [13, 16, 28, 30, 30]}
    rows = [(f"{s}{n}", k, n, 100) for s, k in by.items() for n in (1, 5, 50, 60, 100)]
    got = {r.audit_id: r.tenths for r in engine.penalties(found(spark, rows)).collect()}
    assert {s: [got[f"{s}{n}"] for n in (1, 5, 50, 60, 100)] for s in by} == want


SAMPLE = {"INDEXABLE_NOINDEX": 1, "STATUS_4XX": 1, "BROKEN_INTERNAL_LINKS": 1, "META_TITLE_MISSING": 1, "NON_HTTPS": 1, "NON_INDEXABLE_PAGES": 3, "REDIRECT_3XX": 1, "META_DESC_MISSING": 1, "THIN_CONTENT": 1, "META_TITLE_LENGTH": 7, "META_DESC_LENGTH": 5, "IMAGES_MISSING_ALT": 3, "INDEXABLE_NOT_IN_SITEMAP": 2}


def test_scores_and_order(spark):
    issues = found(spark, [("a", k, n, 8) for k, n in SAMPLE.items()])
    audits = spark.createDataFrame([("a",), ("clean",), ("a",)], "audit_id string")
    got = {r.audit_id: (r.score, r.total_penalty) for r in engine.scores(issues, audits).collect()}
    assert got == {"a": (5, 94.6), "clean": (100, 0.0)}
    placed = engine.ordered(issues)
    assert [r.rule_key for r in placed.orderBy("place").collect()] == list(SAMPLE)
    assert [r.penalty for r in engine.breakdown(issues).orderBy("place").limit(2).collect()] == [11.7, 11.7]
    assert {r.severity: r.n for r in rollups.severity_histogram(issues, audits).where("audit_id = 'a'").collect()} == {"CRITICAL": 0, "HIGH": 5, "MEDIUM": 4, "LOW": 4, "INFO": 0}
    assert report.shortlist(placed).count() == 5
    text = report.to_csv(placed)
    assert text.split("\n")[0].startswith("ruleKey,title") and len(text.split("\n")) == 14 and not text.endswith("\n")
    html = report.to_html({"label": "<script>", "score": 5}, placed, spark.createDataFrame([("a", "STATUS_4XX", "https://x.test/?a&b", 1)], "audit_id string, rule_key string, url string, place int"))
    assert "<script>" not in html and "a&amp;b" in html and "poor" in html


def test_link_cap_keeps_the_count(spark):
    rows = spark.range(2500).select(F.lit("a").alias("audit_id"), F.lit("DEEP_PAGES").alias("rule_key"), F.col("id").cast("string").alias("url"), F.lit(None).cast("string").alias("evidence"), F.col("id").alias("group_ord"), F.col("id").alias("ord"))
    assert engine.links(rows).count() == 2000
    assert rows.groupBy("rule_key").count().first()["count"] == 2500


def test_no_task_sorts_a_hot_issue(spark, monkeypatch):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 'b', 'a') as audit_id", "'DEEP_PAGES' as rule_key", "cast(id as string) as url", "cast(id * 7919 % 5003 as bigint) as group_ord", "id as ord")
    want = sorted(map(tuple, engine.first_of(rows, ["audit_id", "rule_key"], ["group_ord", "ord"], 900).collect()))
    monkeypatch.setattr(engine, "GROUP_LIMIT", 50)
    cut = engine.first_of(rows, ["audit_id", "rule_key"], ["group_ord", "ord"], 900)
    assert sorted(map(tuple, cut.collect())) == want and len(want) == 1800
    assert cut._jdf.queryExecution().executedPlan().toString().count("Window") >= 2


def test_issues_are_counted_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    engine.records(pages(spark, [r for r, _ in CASES] * 2 + [{"url": "R", "redirect_url": "R", "status_code": 301}, {"url": "S", "redirect_url": "R", "status_code": 301}, {"url": "T", "redirect_url": "Z", "status_code": 200}])).write.parquet(path)
    p = spark.read.parquet(path)
    got = engine.summarized(p)
    columns = ["audit_id", "rule_key", "affected", "total", "pct"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, engine.issues(engine.matches(p), p).select(*columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_stored_audits_are_replaced_as_a_unit(spark, tmp_path):
    store = persist.Store(spark, str(tmp_path / "store"))
    assert store.manifest().count() == 0
    rows = pages(spark, [{"url": "u", "title": None}, {"url": "v", "audit_id": "b", "crawl_depth": 9}, {"url": "w", "audit_id": "c"}, {"url": "", "audit_id": "b"}])
    audits = lambda *ids: spark.createDataFrame([(i,) for i in ids], "audit_id string")
    store.replace(rows, audits("a", "b", "empty"))
    head = {r.audit_id: r for r in store.read("header").collect()}
    assert set(head) == {"a", "b", "empty"} and (head["empty"].score, head["empty"].total_urls, head["a"].total_urls) == (100, 0, 1)
    assert {(r.audit_id, r.rule_key) for r in store.read("links").collect()} == {("a", "META_TITLE_MISSING"), ("b", "DEEP_PAGES")}
    store.replace(rows.limit(0), audits("a"))
    head = {r.audit_id: r for r in store.read("header").collect()}
    assert (head["a"].score, head["a"].total_urls, head["b"].total_urls) == (100, 0, 1)
    assert {r.audit_id for r in store.read("urls").collect()} == {"b"} == {r.audit_id for r in store.read("issues").collect()}
    assert store.read("issues").first().impact


def test_coercion(spark):
    ints = {"2.4": 24, "-": None, "--5": None, "5-": 5, "12-34": 12, "1e5": 15, "1,234": 1234, "": None, "99999999999": None}
    df = spark.createDataFrame([(k,) for k in ints], "c string").select("c", X.to_int(F.col("c")).alias("v"))
    assert {r.c: r.v for r in df.collect()} == ints
    bools = {"SÌ": True, "x": False, " ": None, "Yes": True, "1": True, "no": False}
    assert {r.c: r.v for r in spark.createDataFrame([(k,) for k in bools], "c string").select("c", X.to_bool(F.col("c")).alias("v")).collect()} == bools
    flags = {"": "UNKNOWN", "noindex": "INDEXABLE", "non indexable": "NON_INDEXABLE", "foo": "UNKNOWN", "Non-Indexable": "NON_INDEXABLE", None: None}
    assert {r.c: r.v for r in spark.createDataFrame([(k,) for k in flags], "c string").select("c", X.to_indexability(F.col("c")).alias("v")).collect()} == flags


def test_merge(spark):
    rows = [("a", " u ", 1, "UNKNOWN", 0, False, None, {"x": "1"}), ("a", "u", 2, "INDEXABLE", 5, True, "t", {"x": "2", "y": "3"}), ("a", "", 3, None, 1, None, None, None), ("a", None, 4, None, 1, None, None, None)]
    df = spark.createDataFrame(rows, "audit_id string, url string, ord bigint, indexability string, n int, flag boolean, title string, extra map<string,string>")
    out = merge.first_wins(df).collect()
    assert [(r.url, r.ord, r.indexability, r.n, r.flag, r.title, r.extra) for r in out] == [("u", 1, "UNKNOWN", 0, False, "t", {"x": "2", "y": "3"})]
    again = merge.first_wins(merge.first_wins(df)).collect()
    assert again == out
    last = engine.last_wins(df.select("audit_id", "url", "ord", "n")).orderBy("ord").collect()
    assert [(r.url, r.ord, r.n) for r in last] == [(" u ", 1, 0), ("u", 2, 5)]
    c = merge.import_status(merge.counters(df), 1).first()
    assert (c.rows_total, c.rows_skipped, c.rows_kept, c.rows_imported, c.status) == (4, 2, 2, 1, "PARTIAL")


def test_replace_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    merge.replace_snapshot(spark.createDataFrame([("a", 1), ("b", 1)], "audit_id string, n int"), path)
    merge.replace_snapshot(spark.createDataFrame([("a", 2)], "audit_id string, n int"), path)
    assert {(r.audit_id, r.n) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_page_diff(spark):
    day = dt.datetime(2025, 1, 1)
    audits = spark.createDataFrame([("a1", "p", day, 60), ("a2", "p", day + dt.timedelta(1), 72), ("x", "q", day, None)], "audit_id string, project_id string, audit_date timestamp, score int")
    pairs = compare.latest_pairs(audits)
    assert pairs.collect()[0].asDict() == {"project_id": "p", "current_id": "a2", "base_id": "a1"}
    rows = [("a1", "u", 200, None, "c", "INDEXABLE"), ("a2", "u", 301, "", "c", "NON_INDEXABLE"), ("a1", "old", 1, "", "", ""), ("a2", "new", 1, "", "", ""), ("a1", "n", None, "t", None, "x"), ("a2", "n", 200, "t", "", "x")]
    df = spark.createDataFrame(rows, "audit_id string, url string, status_code int, title string, canonical string, indexability string")
    got = {(r.url, r.kind, r.from_value, r.to_value) for r in compare.page_diff(df, pairs).collect()}
    assert got == {("u", "status_code", "200", "301"), ("u", "indexability", "INDEXABLE", "NON_INDEXABLE"), ("old", "removed", None, None), ("new", "new", None, None), ("n", "status_code", None, "200")}
    assert compare.page_diff(df, pairs.withColumn("base_id", F.col("current_id"))).where("kind not in ('new','removed')").isEmpty()
    assert compare.score_delta(audits, pairs).first().delta == 12
    issues = spark.createDataFrame([("a1", "STATUS_4XX", 2), ("a1", "META_TITLE_MISSING", 3), ("a2", "META_TITLE_MISSING", 1), ("a2", "SLOW_RESPONSE", 1)], "audit_id string, rule_key string, affected bigint")
    assert {(r.rule_key, r.kind, r.from_count, r.to_count) for r in compare.issue_diff(issues, pairs).collect()} == {("STATUS_4XX", "resolved", 2, None), ("META_TITLE_MISSING", "persistent", 3, 1), ("SLOW_RESPONSE", "new", None, 1)}


def test_explore(spark):
    df = spark.createDataFrame([("b", 1), ("A", None), ("é", 3), (None, 2)], "s string, n int")
    assert {r.s for r in explore.search(df, "É", ["s", "n"]).collect()} == {"é"}
    assert explore.search(df, "  ", ["s"]).count() == 4
    assert [r.s for r in df.orderBy(*explore.ordering(df, "s")).collect()] == [None, "A", "b", "é"]
    assert [r.n for r in df.orderBy(*explore.ordering(df, "n")).collect()] == [None, 1, 2, 3]
    assert [r.n for r in explore.page(df, [F.asc_nulls_first("n")], 99, 3).collect()] == [3]
    assert explore.facets(df, {"n": "3", "s": "", "zz": "1"}).count() == 1


@pytest.mark.parametrize("n", [1, 3, 7])
def test_results_don_t_depend_on_partitions(spark, n):
    rows = [r for r, _ in CASES] * 3
    p = engine.last_wins(engine.records(pages(spark, [{**r, "url": r.get("url", f"https://x.test/{k % 40}")} for k, r in enumerate(rows)]).repartition(n)))
    out = engine.ordered(engine.issues(engine.matches(p), p)).select("rule_key", "affected", "pct", "place").orderBy("place").collect()
    assert hash(tuple(out)) == test_results_don_t_depend_on_partitions.__dict__.setdefault("first", hash(tuple(out)))
