"""A crawl made from the orders table by modular arithmetic, in which every rule has hits. One row per order; 40 audits, one
of which has a third of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Valid in Spark and in the database that checks it; ``{src}`` is the orders table.
FIXTURE_SQL = """
select case when k % 3 = 0 then 'a0' else concat('a', cast(k % 40 as string)) end as audit_id, k as ord,
  concat(case when k % 17 = 0 then 'http' else 'https' end, '://shop.test/p/', cast(k as string)) as url,
  case when k % 29 = 0 then 'application/pdf' when k % 31 = 0 then '' when k % 37 = 0 then null else 'text/HTML; charset=utf-8' end as content_type,
  cast(case when k % 97 = 0 then 503 when k % 11 = 0 then 404 when k % 7 = 0 then 301 when k % 53 = 0 then null else 200 end as int) as status_code,
  case when k % 6 = 0 then 'NON_INDEXABLE' when k % 43 = 0 then null else 'INDEXABLE' end as indexability,
  case when k % 6 = 0 then 'Canonicalised' end as indexability_status,
  case when k % 23 = 0 then null when k % 19 = 0 then '   ' when k % 13 = 0 then concat(' Shared TITLE ', cast(k % 5 as string), ' ') when k % 26 = 1 then concat('shared title ', cast(k % 5 as string)) else concat('Page number ', cast(k as string)) end as title,
  cast(case when k % 47 = 0 then null else k % 80 end as int) as title_length,
  case when k % 9 = 0 then '' else concat('Description of page ', cast(k as string)) end as meta_description,
  cast(k % 220 as int) as meta_description_length,
  case when k % 21 = 0 then null when k % 10 = 7 then concat(' Shared HEADING ', cast(k % 8 as string)) when k % 10 = 9 then concat('shared heading ', cast(k % 8 as string), ' ') else concat('Heading of ', cast(k as string)) end as h1,
  case when k % 8 = 0 then null when k % 15 = 0 then concat('https://shop.test/p/', cast(k + 1 as string)) else concat(case when k % 17 = 0 then 'http' else 'https' end, '://shop.test/p/', cast(k as string)) end as canonical,
  case when k % 14 = 3 then 'NoIndex, follow' when k % 25 = 0 then null else 'index, follow' end as meta_robots,
  cast(case when k % 59 = 0 then null else k % 900 end as int) as word_count, cast(k % 9 as int) as crawl_depth, cast(case when k % 61 = 0 then null else k % 16 end as int) as inlinks, cast(k % 33 as int) as outlinks,
  case when k % 49 = 0 then concat(case when k % 17 = 0 then 'http' else 'https' end, '://shop.test/p/', cast(k as string)) when k % 14 = 0 then concat(case when (k + 280) % 17 = 0 then 'http' else 'https' end, '://shop.test/p/', cast(k + 280 as string)) when k % 7 = 0 then concat('https://shop.test/p/', cast(k + 40 as string)) end as redirect_url,
  cast(k % 1300 as int) as response_time_ms, cast(k % 10 as int) as images, cast(case when k % 10 > 6 then k % 3 else 0 end as int) as images_missing_alt,
  case when k % 30 = 0 then null else k % 4 <> 0 end as in_sitemap,
  case when k % 41 = 0 then 'Hreflang: no return link' when k % 63 = 0 then 'Structured data: type missing' when k % 67 = 0 then 'SCHEMA invalid' when k % 71 = 0 then 'Other' end as raw_issue
from (select o_orderkey as k from {src}) as o"""


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    # made from one narrow column: spread over the cores first, however few pieces the file has
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism)
    rows = spark.sql(FIXTURE_SQL, src=keys)
    return rows.withColumn("raw_issues", F.array_compact(F.array("raw_issue"))).drop("raw_issue")
