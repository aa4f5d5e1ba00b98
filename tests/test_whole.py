"""Queries over whole tables, held against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def both(spark, sf_dir):
    """Rows of a query and rows of its SQL."""

    def run(name):
        con = duckdb.connect()
        for t in ("orders", "crawled_urls"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        return [tuple(r) for r in entry.queries()[name](spark, sf_dir).collect()], con.execute(entry.oracle_sql()[name]).fetchall()

    return run


def test_task_board(spark, sf_dir, both):
    got, want = both("task_board")
    assert got == want and len(got) == spark.read.parquet(f"{sf_dir}/orders.parquet").count() > 500
    assert {r[1] for r in got} == {"TODO", "IN_PROGRESS", "DONE"} and {r[2] for r in got} == {"P0", "P1", "P2", "P3"}


PAGE = ["content_type", "status_code", "indexability", "indexability_status", "title", "title_length", "meta_description", "meta_description_length", "h1", "canonical", "meta_robots", "hreflang"]
PAGE += ["word_count", "crawl_depth", "inlinks", "outlinks", "redirect_url", "response_time_ms", "images", "images_missing_alt", "structured_data", "structured_data_types", "in_sitemap"]


def test_url_attributes_unpivot(spark, sf_dir, both):
    got, want = both("url_attributes_unpivot")
    assert Counter(got) == Counter(want)
    assert Counter(label for _, label, _ in got) == Counter(dict.fromkeys([*PAGE, "h2"], spark.read.parquet(f"{sf_dir}/crawled_urls.parquet").count()))


def test_merge_first_wins(spark, sf_dir, both):
    got, want = both("merge_first_wins")
    assert Counter(got) == Counter(want)
    assert entry.queries()["merge_first_wins"](spark, sf_dir).columns == ["audit_id", "url", "ord", *PAGE]
