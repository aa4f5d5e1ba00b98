from crawlquarry.operators import units as U

SCALE = [("response_time_ms", "ms", "ms", 1, 1), ("response_time_ms", "s", "ms", 1000, 1), ("response_time_ms", "us", "ms", 1, 1000), ("response_time_ms", "min", "ms", 60000, 1), ("title_length", "char", "char", 1, 1), ("title_length", "px", "char", 1, 9)]


def build(spark, urls, audits):
    u = spark.createDataFrame([(*r, "clash") for r in urls], "ord bigint, audit_id string, url string, title string, response_time_ms string, title_length string, locale string")
    a = spark.createDataFrame(audits, "audit_id string, project_id string, locale string")
    return U.Units(u, a, spark.createDataFrame(SCALE, "measure string, unit_name string, common_unit string, numerator int, denominator int"))


def values(u):
    return {(r.ord, r.field_name): r.common_value for r in u.values().collect()}


def test_written_units_and_locales(spark):
    cells = ["1.5 s", "1,5 s", "100 ms", "2000 µs", "PT1M2.5S", "00:01:02.500", "1 s 20 ms", "n/a", "", None, "-5 ms", "0 s", "1.234 ms", "0.002 min", "5 parsec", "1,234,000 us", "9 sec."]
    urls = [(n, "p", f"u{n}", None, c, None) for n, c in enumerate(cells)] + [(100, "d", "u", None, "1,5 s", "90 px"), (101, "d", "v", None, "1.234 ms", "9 Zeichen")]
    u = build(spark, urls, [("p", "x", None), ("d", "x", "de-DE")])
    got = values(u)
    want = [1500, 1500, 100, 2, 62_500, 62_500, 1020, None, None, None, None, 0, 1, 120, None, 1234, 9000]
    assert [got[n, "response_time_ms"] for n in range(len(cells))] == want
    assert (got[100, "response_time_ms"], got[100, "title_length"], got[101, "response_time_ms"], got[101, "title_length"]) == (1500, 10, 1234, 9)
    case = {(r.ord, r.field_name) for r in u.converted().collect()}
    assert (2, "response_time_ms") not in case and (11, "response_time_ms") in case and (100, "title_length") in case and (101, "title_length") not in case


def test_plain_numbers_by_linked_sources(spark):
    ms = [120 + 37 * n for n in range(30)]
    urls = [(n, "A", f"https://x.test/{n}", "t" * 20, f"{v} ms", "180") for n, v in enumerate(ms)]
    urls += [(100 + n, "B", f"http://www.x.test/{n}/", "t" * 20, f"{v / 1000:.3f}", "20") for n, v in enumerate(ms)]  # same pages, other audit
    urls += [(200 + n, "C", f"https://x.test/{1000 + n}", None, str(v * 1000), None) for n, v in enumerate(ms)]  # no shared page: by deciles
    urls += [(300 + n, "B", f"http://www.x.test/{n}/", "t" * 20, "0", "0") for n in range(2)]
    u = build(spark, urls, [("A", "p", None), ("B", "p", None), ("C", "p", None)])
    unit = {(r.audit_id, r.field_name): r.unit for r in u.sources.collect()}
    assert unit == {("A", "title_length"): "px", ("B", "response_time_ms"): "s", ("B", "title_length"): "char", ("C", "response_time_ms"): "us"}
    got = values(u)
    assert all(got[100 + n, "response_time_ms"] == v and got[200 + n, "response_time_ms"] == v and got[n, "title_length"] == 20 for n, v in enumerate(ms))
    assert got[300, "response_time_ms"] == 0


def test_unknown_audit_and_empty(spark):
    assert values(build(spark, [], [])) == {}
    u = build(spark, [(1, None, None, None, "12", "3"), (2, "lost", "u", None, "1,200", "x" * 1000), (2, "lost", "u", None, "1,200", None)], [])
    assert values(u) == {(1, "response_time_ms"): 12, (1, "title_length"): 3, (2, "response_time_ms"): 1200, (2, "title_length"): None}


def test_chains_of_any_length(spark):
    """Sixty audits of which only the first says its unit; each shares pages with the next alone, and the values drift so
    far that deciles mislead."""
    urls, n = [], 0
    for k in range(60):
        for page in range(k * 4, k * 4 + 8):
            ms = 100 * 1.3 ** (page / 4) * (1 + page % 3 / 50)
            cell = f"{ms:.3f} ms" if k == 0 else f"{ms / 1000:.6f}" if k % 2 else f"{ms:.3f}"
            urls.append((n, f"A{k:03}", f"https://x.test/{page}", None, cell, None))
            n += 1
    u = build(spark, urls, [(f"A{k:03}", "p", None) for k in range(60)])
    unit = {r.audit_id: r.unit for r in u.sources.collect()}
    assert unit == {f"A{k:03}": "s" if k % 2 else "ms" for k in range(1, 60)}
    assert u.links.where("kind = 'page' and (offset is null or abs(offset) > 0.2)").isEmpty()


def test_rows_without_an_address_are_no_shared_page(spark):
    urls = [(n, "A", None, None, "5 s", None) for n in range(5)] + [(10 + n, "B", " ", None, str(7000 + n), None) for n in range(5)]
    u = build(spark, urls, [("A", "p", None), ("B", "p", None)])
    assert u.links.where("kind = 'page'").isEmpty() and {(r.audit_id, r.unit) for r in u.sources.collect()} == {("B", "ms")}
