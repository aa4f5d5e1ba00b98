"""Queries of the audit engine: rules, scores, comparison, merging, exploring, roll-ups and reports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X
from crawlquarry.operators import compare, engine, explore, merge, persist, report, rollups
from crawlquarry.operators.rules import CATALOGUE, EVIDENCE, flagged
from crawlquarry.plans.fixture import FIXTURE_SQL, crawl
from crawlquarry.plans.sized import scratch
from crawlquarry.schema import COLUMNS, SEVERITIES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fixture(spark: SparkSession, d: str) -> DataFrame:
    return engine.records(crawl(spark, d))


def imported(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the manual imports, one record per page."""
    return engine.last_wins(engine.records(table(spark, d, "crawled_urls")))


def imports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audits").where("schedule_id is null")


# ---- SQL building blocks -------------------------------------------------------------------------------------------
TRIM = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{TRIM}+|{TRIM}+$', '', 'g')"


def has(c: str) -> str:
    return f"(coalesce({trim(c)}, '') <> '')"


def to_int(c: str) -> str:
    return f"try_cast(regexp_extract(regexp_replace({c}, '[^0-9-]', '', 'g'), '^-?[0-9]+') as int)"


FIXTURE_CTE = f"pages as (select * exclude (raw_issue, indexability), coalesce(indexability, 'UNKNOWN') as indexability, case when raw_issue is null then [] else [raw_issue] end as raw_issues from ({FIXTURE_SQL.format(src='orders')}))"
CRAWL_CTE = f"""pages as (select c.* exclude (ord, title_length, response_time_ms, indexability), min(ord) over (partition by audit_id, url) as ord, {to_int('title_length')} as title_length, {to_int('response_time_ms')} as response_time_ms,
  coalesce(indexability, 'UNKNOWN') as indexability, cast([] as varchar[]) as raw_issues from crawled_urls c where url is not null and url <> '' qualify row_number() over (partition by audit_id, url order by c.ord desc) = 1)"""

HTML = "(content_type is null or content_type = '' or regexp_matches(content_type, '(?i)html'))"
INDEXABLE = "(indexability = 'INDEXABLE')"
RULES_SQL: dict[str, str] = {
    "INDEXABLE_NOINDEX": "regexp_matches(meta_robots, '(?i)noindex') and status_code = 200",
    "NON_INDEXABLE_PAGES": "indexability = 'NON_INDEXABLE'",
    "ORPHAN_PAGES": f"{HTML} and {INDEXABLE} and coalesce(inlinks, 0) = 0",
    "DEEP_PAGES": "coalesce(crawl_depth, 0) > 5",
    "STATUS_5XX": "coalesce(status_code, 0) >= 500",
    "STATUS_4XX": "coalesce(status_code, 0) between 400 and 499",
    "BROKEN_INTERNAL_LINKS": "coalesce(status_code, 0) >= 400 and coalesce(inlinks, 0) > 0",
    "REDIRECT_3XX": "coalesce(status_code, 0) between 300 and 399",
    "REDIRECT_CHAIN": f"{has('redirect_url')} and (redirect_url = url or exists (select 1 from pages q where q.audit_id = p.audit_id and q.url = p.redirect_url and q.status_code between 300 and 399))",
    "CANONICAL_MISSING": f"{HTML} and {INDEXABLE} and not {has('canonical')}",
    "CANONICAL_NON_SELF": f"{has('canonical')} and canonical <> url and {HTML}",
    "META_TITLE_MISSING": f"{HTML} and {INDEXABLE} and not {has('title')}",
    "META_TITLE_LENGTH": f"{HTML} and {has('title')} and title_length is not null and title_length not between 30 and 60",
    "META_TITLE_DUPLICATE": f"{HTML} and {INDEXABLE} and {has('title')}",
    "META_DESC_MISSING": f"{HTML} and {INDEXABLE} and not {has('meta_description')}",
    "META_DESC_LENGTH": f"{has('meta_description')} and meta_description_length is not null and meta_description_length not between 70 and 160",
    "H1_MISSING": f"{HTML} and {INDEXABLE} and not {has('h1')}",
    "H1_DUPLICATE": f"{INDEXABLE} and {has('h1')}",
    "THIN_CONTENT": f"{HTML} and {INDEXABLE} and word_count < 200",
    "IMAGES_MISSING_ALT": "coalesce(images_missing_alt, 0) > 0",
    "HREFLANG_ERROR": "len(list_filter(raw_issues, lambda x: regexp_matches(x, '(?i)hreflang'))) > 0",
    "STRUCTURED_DATA_INVALID": "len(list_filter(raw_issues, lambda x: regexp_matches(x, '(?i)structured data|schema'))) > 0",
    "SLOW_RESPONSE": "coalesce(response_time_ms, 0) > 1000",
    "INDEXABLE_NOT_IN_SITEMAP": f"{HTML} and {INDEXABLE} and in_sitemap = false",
    "NON_HTTPS": "regexp_matches(url, '(?i)^http://')",
}


def evidence_sql(key: str) -> str:
    """A rule's evidence by its fixed format; a value that is missing makes it null, but for the target of a redirect."""
    pieces = [x for x in re.split(r"(\{\w+\})", EVIDENCE.get(key, "")) if x]
    one = lambda x: "coalesce(redirect_url, '?')" if x == "{redirect_url}" else f"cast({x[1:-1]} as varchar)" if x[0] == "{" else f"'{x}'"
    return " || ".join(map(one, pieces)) or "cast(null as varchar)"


GROUPS = {"META_TITLE_DUPLICATE": "title", "H1_DUPLICATE": "h1"}


def hits_sql(key: str) -> str:
    where, evidence = RULES_SQL[key], evidence_sql(key)
    if key in GROUPS:
        same = f"lower({trim(GROUPS[key])})"
        return f"select audit_id, '{key}' as rule_key, url, {evidence} as evidence, g as group_ord, ord from (select *, count(*) over w as n, min(ord) over w as g from pages p where {where} window w as (partition by audit_id, {same})) where n > 1"
    return f"select audit_id, '{key}' as rule_key, url, {evidence} as evidence, ord as group_ord, ord from pages p where {where}"


META_SQL = "meta(rule_key, rule_ord, category, severity, sev_rank, priority, effort) as (values " + ", ".join(
    f"('{r.key}', {n}, '{r.category}', '{r.severity}', {['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'].index(r.severity)}, '{r.priority}', '{r.effort}')" for n, r in enumerate(CATALOGUE)
) + ")"


def with_hits(pages: str, body: str) -> str:
    return f"with {pages}, hits as ({' union all '.join(map(hits_sql, RULES_SQL))}), {META_SQL}, totals as (select audit_id, count(*) as total from pages group by audit_id), " \
        "issues as (select h.audit_id, h.rule_key, category, severity, sev_rank, priority, effort, rule_ord, affected, total, floor(cast(affected as double) / total * 1000 + 0.5) / 10 as pct, " \
        "least(250, cast(floor(case severity when 'CRITICAL' then 30.0::double when 'HIGH' then 18.0::double when 'MEDIUM' then 9.0::double when 'LOW' then 3.0::double else 0.5::double end * (0.35::double + 0.65::double * least(1.0::double, sqrt(affected::double / greatest(total, 1)) * 1.3::double)) * 10 + 0.5) as bigint)) as tenths " \
        f"from (select audit_id, rule_key, count(*) as affected from hits group by 1, 2) h join totals using (audit_id) join meta using (rule_key)) {body}"


ISSUE_COLUMNS = ["audit_id", "rule_key", "category", "severity", "priority", "effort", "affected", "total", "pct", "place"]
ISSUES_BODY = "select audit_id, rule_key, category, severity, priority, effort, affected, total, pct, cast(row_number() over (partition by audit_id order by sev_rank, affected desc, rule_ord) as int) as place from issues"


# ---- rules ---------------------------------------------------------------------------------------------------------
def _rule(key: str) -> Query:
    def one(spark: SparkSession, d: str) -> DataFrame:
        return engine.matches(fixture(spark, d), [r for r in CATALOGUE if r.key == key]).select("audit_id", "url", "evidence")

    return one


for _n, _r in enumerate(CATALOGUE, 1):
    query(f"with {FIXTURE_CTE} select audit_id, url, evidence from ({hits_sql(_r.key)})", f"rule_r{_n:02}_{_r.key.lower()}")(_rule(_r.key))

HIT_COLUMNS = ["audit_id", "rule_key", "url", "evidence"]


@query(with_hits(FIXTURE_CTE, "select audit_id, rule_key, url, evidence from hits"))
def rule_matches_all(spark, d):
    return engine.matches(fixture(spark, d)).select(*HIT_COLUMNS)


@query(with_hits(CRAWL_CTE, "select audit_id, rule_key, url, evidence from hits"))
def crawl_rule_matches(spark, d):
    return engine.matches(imported(spark, d)).select(*HIT_COLUMNS)


def _issues(pages: DataFrame) -> DataFrame:
    return engine.summarized(pages)


@query(with_hits(FIXTURE_CTE, ISSUES_BODY))
def audit_issue_summary(spark, d):
    return engine.ordered(_issues(fixture(spark, d))).select(*ISSUE_COLUMNS)


@query(with_hits(CRAWL_CTE, ISSUES_BODY))
def crawl_issue_summary(spark, d):
    return engine.ordered(_issues(imported(spark, d))).select(*ISSUE_COLUMNS)


SCORES_BODY = "select a.audit_id, cast(least(100, greatest(0, floor(100 - coalesce(sum(tenths), 0) / 10.0::double + 0.5))) as int) as score, coalesce(sum(tenths), 0) / 10.0::double as total_penalty from {audits} a left join issues i on i.audit_id = a.audit_id group by a.audit_id"


@query(with_hits(FIXTURE_CTE, SCORES_BODY.format(audits="(select distinct audit_id from pages)")))
def audit_score(spark, d):
    pages = fixture(spark, d)
    return engine.scores(_issues(pages), pages)


@query(with_hits(CRAWL_CTE, SCORES_BODY.format(audits="(select distinct audit_id from audits)")))
def score_clean_audit(spark, d):
    """Scores of all audits: those without imported pages have no issues and 100."""
    return engine.scores(_issues(imported(spark, d)), table(spark, d, "audits"))


@query(with_hits(CRAWL_CTE, "select audit_id, rule_key, severity, affected, pct, tenths / 10.0::double as penalty, cast(row_number() over (partition by audit_id order by tenths desc, sev_rank, affected desc, rule_ord) as int) as place from issues"))
def score_breakdown(spark, d):
    return engine.breakdown(_issues(imported(spark, d)))


@query(with_hits(FIXTURE_CTE, "select audit_id, rule_key, url, cast(n as int) as place from (select *, row_number() over (partition by audit_id, rule_key order by group_ord, ord) as n from hits) where n <= 2000"))
def issue_links_capped(spark, d):
    return engine.links(engine.matches(fixture(spark, d))).select("audit_id", "rule_key", "url", "place")


@query(with_hits(CRAWL_CTE, "select audit_id, rule_key, url, cast(n as int) as place from (select *, row_number() over (partition by audit_id, rule_key order by group_ord, ord) as n from hits) where n <= 5"))
def issue_samples(spark, d):
    return report.samples(engine.matches(imported(spark, d)))


@query(f"with {CRAWL_CTE} select audit_id, lower({trim('title')}) as same, count(*) as n from pages where {HTML} and {INDEXABLE} and {has('title')} group by 1, 2 having count(*) > 1")
def title_duplicate_groups(spark, d):
    hits = flagged(imported(spark, d)).where([r for r in CATALOGUE if r.key == "META_TITLE_DUPLICATE"][0].when())
    return hits.groupBy("audit_id", F.lower(X.trimmed(F.col("title"))).alias("same")).agg(F.count("*").alias("n")).where("n > 1")


# ---- coercion and merging ------------------------------------------------------------------------------------------
@query(f"select ord, {to_int('title_length')} as title_length, {to_int('response_time_ms')} as response_time_ms from crawled_urls")
def coerce_int(spark, d):
    return table(spark, d, "crawled_urls").select("ord", X.to_int(F.col("title_length")).alias("title_length"), X.to_int(F.col("response_time_ms")).alias("response_time_ms"))


#: Spellings of booleans that orders are given in turn, each with what it means.
BOOLEANS = {"true": True, "TRUE": True, " yes ": True, "Yes": True, "1": True, "si": True, "SÌ": True, "sì": True, "no": False, "false": False, "0": False, "x": False, "yes!": False, "": None, "  ": None}


@query("select o_orderkey, word, flag from (select o_orderkey, o_orderkey % 16 as n from orders) left join (values " + ", ".join(f"({n}, '{w}', {str(v).lower() if v is not None else 'cast(null as boolean)'})" for n, (w, v) in enumerate(BOOLEANS.items())) + ") as t(n, word, flag) using (n)")
def coerce_bool(spark, d):
    """Accepted words are true, anything else that isn't blank is false; missing and blank are null."""
    word = F.get(F.array(*map(F.lit, BOOLEANS)), F.expr("cast(o_orderkey % 16 as int)"))
    return table(spark, d, "orders").select("o_orderkey", word.alias("word"), X.to_bool(word).alias("flag"))


@query(f"select ord, case when indexability_status is null then null when regexp_matches(lower({trim('indexability_status')}), 'non[-\\s]?index') then 'NON_INDEXABLE' when contains(lower({trim('indexability_status')}), 'index') then 'INDEXABLE' else 'UNKNOWN' end as from_status, case when indexability is null then null when regexp_matches(lower(replace(indexability, '_', '-')), 'non[-\\s]?index') then 'NON_INDEXABLE' when contains(lower(indexability), 'index') then 'INDEXABLE' else 'UNKNOWN' end as from_flag from crawled_urls")
def coerce_indexability(spark, d):
    return table(spark, d, "crawled_urls").select("ord", X.to_indexability(F.col("indexability_status")).alias("from_status"), X.to_indexability(F.replace("indexability", F.lit("_"), F.lit("-"))).alias("from_flag"))


#: The canonical columns of a page that crawled_urls has, in the order of the page's attributes: all but its key, and h2,
#: which the table lacks. Its lengths and response times are texts, as recorded.
CANONICAL = [c for c in COLUMNS if c not in ("url", "h2")]
_CANONICAL_TEXT = {c for c in CANONICAL if COLUMNS[c][0] in ("string", "indexability")} | {"title_length", "response_time_ms"}


@query(
    "select audit_id, u as url, min(ord) as ord, " + ", ".join(f"arg_min({c}, ord) filter (where {c} is not null{f' and {c} <> {chr(39) * 2}' if c in _CANONICAL_TEXT else ''}) as {c}" for c in CANONICAL)
    + f" from (select *, {trim('url')} as u from crawled_urls) where u is not null and u <> '' group by audit_id, u"
)
def merge_first_wins(spark, d):
    return merge.first_wins(table(spark, d, "crawled_urls").select("audit_id", "url", "ord", *CANONICAL))


@query("select audit_id, url, title, status_code, canonical, min_ord as ord from (select *, min(ord) over (partition by audit_id, url) as min_ord, row_number() over (partition by audit_id, url order by ord desc) as rn from compare_urls where url is not null and url <> '') where rn = 1")
def persist_last_wins(spark, d):
    return engine.last_wins(table(spark, d, "compare_urls").select("audit_id", "url", "title", "status_code", "canonical", "ord"))


@query(f"select count(*) as rows_total, count(*) filter (where u is null or u = '') as rows_skipped, count(*) filter (where u <> '') as rows_kept, count(distinct u) filter (where u <> '') as rows_imported, case when count(distinct u) filter (where u <> '') = 0 then 'FAILED' else 'IMPORTED' end as status from (select {trim('url')} as u from crawled_urls)")
def ingest_counters(spark, d):
    return merge.import_status(merge.counters(table(spark, d, "crawled_urls")), 0)


@query("select audit_id, url from compare_urls where url is not null group by audit_id, url union select c.audit_id, c.url from crawled_urls c")
def insert_ignore(spark, d):
    """Pages of both tables, each once: insert-ignore on the natural key."""
    stored = table(spark, d, "compare_urls").where("url is not null").select("audit_id", "url").distinct()
    return merge.insert_absent(stored, table(spark, d, "crawled_urls").select("audit_id", "url"), ["audit_id", "url"])


# ---- comparison ----------------------------------------------------------------------------------------------------
PAIRS_SQL = "pairs as (select project_id, max(case when n = 1 then audit_id end) as current_id, max(case when n = 2 then audit_id end) as base_id from (select project_id, audit_id, row_number() over (partition by project_id order by audit_date desc, audit_id) as n from audits where status = 'READY' and {which}) where n <= 2 group by project_id having max(case when n = 2 then audit_id end) is not null)"
SCHEDULED, MANUAL = PAIRS_SQL.format(which="schedule_id is not null"), PAIRS_SQL.format(which="schedule_id is null")
SIDES_SQL = "snap as (select * from compare_urls where url is not null and url <> '' qualify row_number() over (partition by audit_id, url order by ord desc) = 1), a as (select pairs.project_id, s.* exclude (project_id) from pairs join snap s on s.audit_id = base_id), b as (select pairs.project_id, s.* exclude (project_id) from pairs join snap s on s.audit_id = current_id)"


def _pairs(spark, d, scheduled: bool = True) -> DataFrame:
    a = table(spark, d, "audits").where("status = 'READY'")
    return compare.latest_pairs(a.where(F.col("schedule_id").isNotNull() if scheduled else F.col("schedule_id").isNull()))


def _diff(spark, d) -> DataFrame:
    cols = ["status_code", "title", "canonical", "indexability"]
    return compare.page_diff(engine.last_wins(table(spark, d, "compare_urls").select("audit_id", "url", "ord", *cols)), _pairs(spark, d))


@query(f"with {SCHEDULED} select project_id, current_id, base_id from pairs")
def latest_audit_pair(spark, d):
    return _pairs(spark, d)


@query(f"with {SCHEDULED}, {SIDES_SQL} select project_id, url from b anti join a using (project_id, url)")
def diff_new_urls(spark, d):
    return _diff(spark, d).where("kind = 'new'").select("project_id", "url")


@query(f"with {SCHEDULED}, {SIDES_SQL} select project_id, url from a anti join b using (project_id, url)")
def diff_removed_urls(spark, d):
    return _diff(spark, d).where("kind = 'removed'").select("project_id", "url")


def _field(column: str) -> Query:
    return lambda spark, d: _diff(spark, d).where(F.col("kind") == column).select("project_id", "url", "from_value", "to_value")


for _name, _col in (("diff_status", "status_code"), ("diff_title", "title"), ("diff_canonical", "canonical"), ("diff_indexability", "indexability")):
    _test = f"a.{_col} is distinct from b.{_col}" if _col == "status_code" else f"coalesce(a.{_col}, '') <> coalesce(b.{_col}, '')"
    query(f"with {SCHEDULED}, {SIDES_SQL} select project_id, url, cast(a.{_col} as varchar) as from_value, cast(b.{_col} as varchar) as to_value from a join b using (project_id, url) where {_test}", _name)(_field(_col))


@query(f"with {SCHEDULED}, {SIDES_SQL} select project_id, count(*) as n from a semi join b using (project_id, url) group by project_id")
def diff_kept_urls(spark, d):
    """Pages in both audits, per project: the intersection."""
    pages = engine.last_wins(table(spark, d, "compare_urls").select("audit_id", "url", "ord"))
    mine = pages.join(compare.sides(_pairs(spark, d)), "audit_id")
    both = mine.where("not current").select("project_id", "url").join(mine.where("current").select("project_id", "url"), ["project_id", "url"], "left_semi")
    return both.groupBy("project_id").agg(F.count("*").alias("n"))


@query(with_hits(f"{MANUAL}, {CRAWL_CTE}", "select coalesce(x.project_id, y.project_id) as project_id, coalesce(x.rule_key, y.rule_key) as rule_key, x.affected as from_count, y.affected as to_count, case when x.rule_key is null then 'new' when y.rule_key is null then 'resolved' else 'persistent' end as kind from (select p.project_id, i.rule_key, i.affected from pairs p join issues i on i.audit_id = p.base_id) x full join (select p.project_id, i.rule_key, i.affected from pairs p join issues i on i.audit_id = p.current_id) y on x.project_id = y.project_id and x.rule_key = y.rule_key"))
def diff_issues(spark, d):
    return compare.issue_diff(_issues(imported(spark, d)), _pairs(spark, d, False))


@query(f"with {SCHEDULED} select p.project_id, a.score as from_score, b.score as to_score, b.score - a.score as delta from pairs p join audits a on a.audit_id = base_id join audits b on b.audit_id = current_id")
def score_delta(spark, d):
    return compare.score_delta(table(spark, d, "audits"), _pairs(spark, d))


# ---- exploring -----------------------------------------------------------------------------------------------------
VIEW = ["url", "status_code", "indexability", "title", "meta_description", "h1", "word_count", "crawl_depth", "inlinks"]


@query("select ord, url from crawled_urls where " + " or ".join(f"contains(lower(coalesce(cast({c} as varchar), '')), 'tenda')" for c in VIEW))
def url_search(spark, d):
    return explore.search(table(spark, d, "crawled_urls"), "Tenda", explore.URL_COLUMNS).select("ord", "url")


@query("select ord, url from crawled_urls where coalesce(cast(status_code as varchar), '') = '301' and indexability = 'NON_INDEXABLE'")
def url_facets(spark, d):
    return explore.facets(table(spark, d, "crawled_urls"), {"status_code": "301", "indexability": "NON_INDEXABLE", "title": "", "missing": "x"}).select("ord", "url")


@query("select ord, url, word_count from crawled_urls order by word_count desc nulls last, ord limit 50 offset 100")
def url_page(spark, d):
    df = table(spark, d, "crawled_urls")
    return explore.page(df, [*explore.ordering(df, "word_count", True), F.asc("ord")], 2, 50).select("ord", "url", "word_count")


@query(f"with {FIXTURE_CTE} select ord, url, crawl_depth from pages order by crawl_depth asc nulls last, ord limit 5000")
def url_explorer_topk(spark, d):
    """The first 5000 pages by depth, a limit that the explorer has."""
    return rollups.top(fixture(spark, d).select("ord", "url", "crawl_depth"), [F.col("crawl_depth").asc_nulls_last(), F.asc("ord")], 5000)


@query("select ord, url, word_count from crawled_urls order by word_count desc nulls last, ord limit 50 offset (select (greatest(count(*), 1) - 1) // 50 * 50 from crawled_urls)")
def url_page_clamped(spark, d):
    """A page far beyond the last gives the last."""
    df = table(spark, d, "crawled_urls")
    return explore.page(df, [*explore.ordering(df, "word_count", True), F.asc("ord")], 10**6, 50).select("ord", "url", "word_count")


@query("select ord, url, title from crawled_urls order by coalesce(title, '') collate de, ord limit 200 offset 400")
def url_page_by_title(spark, d):
    """Texts in the order of a collation, not of code points: case and accents after letters, a missing title as ''."""
    df = table(spark, d, "crawled_urls")
    return explore.page(df, [*explore.ordering(df, "title"), F.asc("ord")], 2, 200).select("ord", "url", "title")


@query("select distinct cast(status_code as varchar) as value from crawled_urls where status_code is not null")
def distinct_status(spark, d):
    return explore.distinct_values(table(spark, d, "crawled_urls"), "status_code")


@query(f"select category as value from ({' union '.join(f'select {chr(39)}{c}{chr(39)} as category' for c in sorted({r.category for r in CATALOGUE}))})")
def distinct_categories(spark, d):
    return explore.distinct_values(_issues(fixture(spark, d)), "category")


# ---- roll-ups ------------------------------------------------------------------------------------------------------
@query("select client_id, count(*) as projects from projects where client_id is not null group by client_id")
def client_project_counts(spark, d):
    p = table(spark, d, "projects").where("client_id is not null")
    return rollups.child_counts(p, p, "client_id", "projects")


@query("select p.project_id, count(a.audit_id) as audits from projects p left join audits a using (project_id) group by p.project_id")
def project_audit_counts(spark, d):
    return rollups.child_counts(table(spark, d, "projects"), table(spark, d, "audits"), "project_id", "audits")


@query(with_hits(CRAWL_CTE, "select a.audit_id, coalesce(t.total, 0) as urls, coalesce(i.n, 0) as issues from (select distinct audit_id from audits) a left join totals t using (audit_id) left join (select audit_id, count(*) as n from issues group by audit_id) i using (audit_id)"))
def audit_child_counts(spark, d):
    pages, audits = imported(spark, d), table(spark, d, "audits")
    return rollups.child_counts(audits, pages, "audit_id", "urls").join(rollups.child_counts(audits, _issues(pages), "audit_id", "issues"), "audit_id")


@query("select project_id, audit_id, audit_date, score from audits qualify row_number() over (partition by project_id order by created_at desc, audit_id) = 1")
def project_latest_audit(spark, d):
    return rollups.latest_child(table(spark, d, "audits"), "project_id", "created_at", "audit_id", ["audit_id", "audit_date", "score"])


@query("select audit_id, project_id, label, created_at from audits order by created_at desc, audit_id limit 8")
def recent_audits(spark, d):
    return rollups.top(table(spark, d, "audits").select("audit_id", "project_id", "label", "created_at"), [F.desc("created_at"), F.asc("audit_id")], 8)


@query("select audit_id, status, created_at from audits where status in ('FAILED') order by created_at desc, audit_id limit 6")
def recent_failures(spark, d):
    return rollups.top(table(spark, d, "audits").where(F.col("status").isin("FAILED")).select("audit_id", "status", "created_at"), [F.desc("created_at"), F.asc("audit_id")], 6)


@query("select (select count(distinct client_id) from projects) as clients, (select count(*) from projects) as projects, (select count(*) from audits) as audits, (select count(*) from audits where status = 'FAILED') as failed, (select count(*) from audits where schedule_id is null) as imports")
def dashboard_counts(spark, d):
    p, a = table(spark, d, "projects"), table(spark, d, "audits")
    return rollups.scalars(clients=p.agg(F.count_distinct("client_id")), projects=p.agg(F.count("*")), audits=a.agg(F.count("*")), failed=a.agg(F.count_if(F.col("status") == "FAILED")), imports=a.agg(F.count_if(F.col("schedule_id").isNull())))


@query(with_hits(CRAWL_CTE, "select a.audit_id, s.severity, (select count(*) from issues i where i.audit_id = a.audit_id and i.severity = s.severity) as n from (select distinct audit_id from audits where schedule_id is null) a cross join (values ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity)"))
def severity_histogram(spark, d):
    return rollups.severity_histogram(_issues(imported(spark, d)), imports(spark, d))


@query(with_hits(CRAWL_CTE, "select audit_id, count(*) filter (where severity in ('CRITICAL', 'HIGH')) as n from issues group by audit_id"))
def high_priority_counts(spark, d):
    return rollups.high_priority(_issues(imported(spark, d)))


def _tasks(spark, d) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(s == "O", "TODO").when(s == "P", "IN_PROGRESS").otherwise("DONE").alias("status"), F.when(p < "2", "P0").when(p < "3", "P1").when(p < "4", "P2").otherwise("P3").alias("priority"))


STATUS_RANK = "case o_orderstatus when 'O' then 0 when 'P' then 1 else 3 end"
PRIORITY_RANK = "case when o_orderpriority < '2' then 0 when o_orderpriority < '3' then 1 when o_orderpriority < '4' then 2 else 3 end"


@query(f"select o_orderkey as task_id, case o_orderstatus when 'O' then 'TODO' when 'P' then 'IN_PROGRESS' else 'DONE' end as status, case when o_orderpriority < '2' then 'P0' when o_orderpriority < '3' then 'P1' when o_orderpriority < '4' then 'P2' else 'P3' end as priority, {STATUS_RANK} as status_rank, {PRIORITY_RANK} as priority_rank from orders order by status_rank, priority_rank, task_id")
def task_board(spark, d):
    """Every task in the order of the board. The ranks and the id give the order to readers of unordered rows."""
    tasks = _tasks(spark, d)
    status, priority = rollups.board(tasks)
    return tasks.withColumns({"status_rank": status, "priority_rank": priority}).orderBy("status_rank", "priority_rank", "task_id")


@query("select a.audit_id, a.label, p.name as project, coalesce(p.client_id, '—') as client from audits a left join projects p using (project_id)")
def audit_headers(spark, d):
    p = table(spark, d, "projects").select("project_id", F.col("name").alias("project"), "client_id")
    return table(spark, d, "audits").join(p, "project_id", "left").select("audit_id", "label", "project", F.coalesce("client_id", F.lit("—")).alias("client"))


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R'))")
def audit_users_semi(spark, d):
    """EXISTS through two levels, without repeating the outer row."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return table(spark, d, "customer").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select a.audit_id from audits a where exists (select 1 from projects p where p.project_id = a.project_id and p.client_id is not null)")
def tenant_filter(spark, d):
    return table(spark, d, "audits").join(table(spark, d, "projects").where("client_id is not null").select("project_id"), "project_id", "left_semi").select("audit_id")


# ---- report --------------------------------------------------------------------------------------------------------
@query(with_hits(CRAWL_CTE, "select audit_id, case when priority in ('P0', 'P1') then 30 when priority = 'P2' then 60 else 90 end as days, count(*) as n, cast(sum(affected) as bigint) as affected from issues group by 1, 2"))
def roadmap_buckets(spark, d):
    return _issues(imported(spark, d)).groupBy("audit_id", report.bucket(F.col("priority")).alias("days")).agg(F.count("*").alias("n"), F.sum("affected").alias("affected"))


@query("select audit_id, score, case when score >= 80 then 'good' when score >= 50 then 'fair' when score is not null then 'poor' end as band from audits")
def score_band(spark, d):
    return table(spark, d, "audits").select("audit_id", "score", report.band(F.col("score")).alias("band"))


@query(with_hits(CRAWL_CTE, f"select audit_id, rule_key, severity, place from ({ISSUES_BODY}) where severity in ('CRITICAL', 'HIGH') and place <= 8"))
def critical_shortlist(spark, d):
    return report.shortlist(engine.ordered(_issues(imported(spark, d)))).select("audit_id", "rule_key", "severity", "place")


#: The 24 attributes of a page; the table has no h2, which is then missing.
ATTRIBUTES = [c for c in COLUMNS if c != "url"]


@query(" union all ".join(f"select ord, '{c}' as label, " + ("'—'" if c == "h2" else f"case when coalesce(cast({c} as varchar), '') = '' then '—' else cast({c} as varchar) end") + " as value from crawled_urls" for c in ATTRIBUTES))
def url_attributes_unpivot(spark, d):
    return report.unpivoted(table(spark, d, "crawled_urls").withColumn("h2", F.lit(None).cast("string")), ATTRIBUTES, ("ord",))


@query(with_hits(CRAWL_CTE, f"select audit_id, rule_key, days, step from (select *, cast(row_number() over (partition by audit_id, days order by place) as int) as step from (select *, case when priority in ('P0', 'P1') then 30 when priority = 'P2' then 60 else 90 end as days from ({ISSUES_BODY}))) where step <= 6"))
def roadmap_first(spark, d):
    """The first six issues of each bucket of each audit's roadmap."""
    return report.roadmap(engine.ordered(_issues(imported(spark, d)))).select("audit_id", "rule_key", "days", "step")


@query(with_hits(CRAWL_CTE, "select t.audit_id, t.rule_key, t.url, p.status_code, p.title, cast(t.n as int) as place from (select *, row_number() over (partition by audit_id, rule_key order by group_ord, ord) as n from hits) t join pages p on p.audit_id = t.audit_id and p.url = t.url where t.n <= 200"))
def issue_pages(spark, d):
    """The first 200 pages of each issue, as stored."""
    pages = imported(spark, d)
    return report.issue_pages(engine.matches(pages), pages).select("audit_id", "rule_key", "url", "status_code", "title", "place")


@query(with_hits(CRAWL_CTE, "select h.audit_id, h.url, h.rule_key, i.severity, i.affected from hits h join issues i on i.audit_id = h.audit_id and i.rule_key = h.rule_key"))
def page_issues(spark, d):
    """Every page with each of its issues."""
    pages = imported(spark, d)
    return report.page_issues(engine.matches(pages), _issues(pages)).select("audit_id", "url", "rule_key", "severity", "affected")


def _stored(spark, d) -> persist.Store:
    """All imports stored, then those that failed or whose export has another notation stored again without pages."""
    store = persist.Store(spark, scratch(spark))
    rows, audits = table(spark, d, "crawled_urls"), imports(spark, d)
    store.replace(rows, audits)
    store.replace(rows.limit(0), audits.where("locale is not null or status = 'FAILED'"))
    return store


EMPTIED = f"{CRAWL_CTE.replace('pages as', 'whole as', 1)}, pages as (select * from whole where audit_id in (select audit_id from audits where schedule_id is null and not (locale is not null or status = 'FAILED')))"


@query(with_hits(EMPTIED, "select a.audit_id, 'READY' as status, cast(least(100, greatest(0, floor(100 - coalesce(sum(tenths), 0) / 10.0::double + 0.5))) as int) as score, coalesce(max(t.total), 0) as total_urls, count(i.rule_key) as issues from (select distinct audit_id from audits where schedule_id is null) a left join issues i on i.audit_id = a.audit_id left join totals t on t.audit_id = a.audit_id group by a.audit_id"))
def persisted_headers(spark, d):
    """Headers after a replacement that empties some audits."""
    return _stored(spark, d).read("header").select("audit_id", "status", "score", "total_urls", F.coalesce(F.size("breakdown"), F.lit(0)).cast("long").alias("issues"))


@query(with_hits(EMPTIED, "select audit_id, rule_key, url, evidence, cast(n as int) as place from (select *, row_number() over (partition by audit_id, rule_key order by group_ord, ord) as n from hits) where n <= 2000"))
def persisted_links(spark, d):
    """Links of issues after the same replacement."""
    return _stored(spark, d).read("links").select("audit_id", "rule_key", "url", "evidence", "place")


@query(with_hits(CRAWL_CTE, "select audit_id, rule_key, affected, cast(n as int) as place from (select *, row_number() over (partition by audit_id order by affected desc, rule_ord) as n from issues) where n <= 2"))
def top_issues(spark, d):
    """The two issues of each audit with most pages."""
    return rollups.latest_children(_issues(imported(spark, d)), "audit_id", [F.desc("affected"), F.asc("rule_ord")], 2).select("audit_id", "rule_key", "affected", "place")


@query(with_hits(CRAWL_CTE, "select audit_id, rule_key, severity, affected, cast(row_number() over (partition by audit_id order by list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity), affected desc, rule_key) as int) as place from issues"))
def issue_list(spark, d):
    """Issues of each audit in the order of the severities' enum, then by pages."""
    w = Window.partitionBy("audit_id").orderBy(rollups.rank(F.col("severity"), SEVERITIES), F.desc("affected"), "rule_key")
    return _issues(imported(spark, d)).select("audit_id", "rule_key", "severity", "affected", F.row_number().over(w).alias("place"))


@query("select project_id, audit_id, created_at, cast(n as int) as place from (select *, row_number() over (partition by project_id order by created_at desc, audit_id) as n from audits) where n <= 5")
def project_last_audits(spark, d):
    """The last five audits of each project."""
    return rollups.latest_children(table(spark, d, "audits"), "project_id", [F.desc("created_at"), F.asc("audit_id")], 5).select("project_id", "audit_id", "created_at", "place")


@query("select project_id, audit_id, audit_date, cast(row_number() over (partition by project_id order by audit_date desc, audit_id) as int) as place from audits")
def project_audits_by_date(spark, d):
    """All audits of each project, the newest first."""
    w = Window.partitionBy("project_id").orderBy(F.desc("audit_date"), "audit_id")
    return table(spark, d, "audits").select("project_id", "audit_id", "audit_date", F.row_number().over(w).alias("place"))


#: Stages of jobs that orders are given in turn; the first six are those that a dashboard follows.
JOB_STAGES = ["QUEUED", "RUNNING", "EXPORTING", "IMPORTING", "FAILED", "TIMEOUT", "COMPLETED", "CANCELLED"]


@query("select o_orderkey as job_id, (['" + "', '".join(JOB_STAGES) + "'])[o_orderkey * 7 % 8 + 1] as status, o_orderdate as updated_at from orders where o_orderkey * 7 % 8 < 6 order by o_orderdate desc, o_orderkey limit 6")
def recent_jobs(spark, d):
    """The six jobs in one of six states that changed last."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.get(F.array(*map(F.lit, JOB_STAGES)), F.expr("cast(o_orderkey * 7 % 8 as int)")).alias("status"), F.col("o_orderdate").alias("updated_at"))
    return rollups.top(jobs.where(F.col("status").isin(JOB_STAGES[:6])), [F.desc("updated_at"), F.asc("job_id")], 6)


@query("select project_id, name, created_at from projects order by created_at, project_id limit 1")
def oldest_project(spark, d):
    """The project that a default falls back to."""
    return rollups.top(table(spark, d, "projects").select("project_id", "name", "created_at"), [F.asc("created_at"), F.asc("project_id")], 1)


@query("select audit_id, project_id, label, status from audits where audit_id = (select min(audit_id) from audits)")
def audit_lookup(spark, d):
    """One audit by its id."""
    audits = table(spark, d, "audits")
    return audits.where(F.col("audit_id") == audits.agg(F.min("audit_id")).first()[0]).select("audit_id", "project_id", "label", "status")


@query("select o_orderkey as task_id, coalesce(nullif(case when c_custkey % 3 = 0 then null else c_name end, ''), case when c_custkey % 2 = 0 then null else lower(c_name) || '@x.test' end, '—') as assignee from orders left join (select * from customer where c_custkey % 5 <> 0) on c_custkey = o_custkey")
def task_assignees(spark, d):
    """Every task with its assignee's name, else address, else a dash; tasks without an assignee stay."""
    k, name = F.col("c_custkey"), F.col("c_name")
    people = table(spark, d, "customer").where(k % 5 != 0).select(k.alias("o_custkey"), F.when(k % 3 != 0, name).alias("name"), F.when(k % 2 != 0, F.concat(F.lower(name), F.lit("@x.test"))).alias("email"))
    return table(spark, d, "orders").join(people, "o_custkey", "left").select(F.col("o_orderkey").alias("task_id"), F.coalesce(F.nullif("name", F.lit("")), "email", F.lit("—")).alias("assignee"))


@query(with_hits(CRAWL_CTE, "select i.audit_id, i.rule_key, a.label, p.name as project, coalesce(p.client_id, '—') as client from issues i join audits a on a.audit_id = i.audit_id join projects p on p.project_id = a.project_id"))
def issue_headers(spark, d):
    """Issues with their audit, project and client."""
    p = table(spark, d, "projects").select("project_id", F.col("name").alias("project"), F.coalesce("client_id", F.lit("—")).alias("client"))
    return _issues(imported(spark, d)).select("audit_id", "rule_key").join(table(spark, d, "audits").select("audit_id", "project_id", "label"), "audit_id").join(p, "project_id").drop("project_id")


@query("select project_id, lower(regexp_replace(name, '[^A-Za-z0-9-]+', '-', 'g')) as slug, substr(cast(created_at as varchar), 1, 10) as created from projects")
def report_slugs(spark, d):
    return table(spark, d, "projects").select("project_id", report.slug(F.col("name")).alias("slug"), F.date_format("created_at", "yyyy-MM-dd").alias("created"))
