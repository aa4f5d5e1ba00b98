"""The report of an audit: bands, buckets, samples, and its renderings."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlquarry.operators.engine import links
from crawlquarry.plans.sized import small, written
from crawlquarry.schema import SEVERITIES


def band(score: Column) -> Column:
    """good from 80, fair from 50, else poor; null stays null."""
    return F.when(score >= 80, "good").when(score >= 50, "fair").when(score.isNotNull(), "poor")


def bucket(priority: Column) -> Column:
    """Days of the roadmap by priority."""
    return F.when(priority.isin("P0", "P1"), 30).when(priority == "P2", 60).when(priority == "P3", 90)


def samples(hits: DataFrame, n: int = 5) -> DataFrame:
    """(audit_id, rule_key, url, place): the first pages of each issue."""
    return links(hits, n).select("audit_id", "rule_key", "url", "place")


def shortlist(placed: DataFrame, n: int = 8) -> DataFrame:
    """The first CRITICAL and HIGH issues of each audit, by their place (see :func:`engine.ordered`)."""
    return placed.where(F.col("severity").isin("CRITICAL", "HIGH") & (F.col("place") <= n))  # these come first in that order


def roadmap(placed: DataFrame, n: int = 6) -> DataFrame:
    """The first ``n`` issues of each audit and bucket of days, with their ``step`` there."""
    w = Window.partitionBy("audit_id", "days").orderBy("place")
    return placed.withColumn("days", bucket(F.col("priority"))).withColumn("step", F.row_number().over(w)).where(F.col("step") <= n)


def issue_pages(hits: DataFrame, pages: DataFrame, n: int = 200) -> DataFrame:
    """From issues to pages: the first ``n`` pages of each issue with what is stored of them."""
    return links(hits, n).select("audit_id", "rule_key", "place", "url").join(pages.select("audit_id", "url", "status_code", "title"), ["audit_id", "url"])


def page_issues(hits: DataFrame, found: DataFrame) -> DataFrame:
    """From pages to issues: every page with each of its issues."""
    kinds = found.select("audit_id", "rule_key", "severity", "affected")
    return hits.select("audit_id", "url", "rule_key").join(small(written(kinds)), ["audit_id", "rule_key"])


def unpivoted(pages: DataFrame, columns: list[str], keys: tuple[str, ...] = ("audit_id", "url")) -> DataFrame:
    """(keys, label, value): one row per column, blanks as a dash."""
    text = lambda c: F.col(c).cast("string")
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.when(F.coalesce(text(c), F.lit("")) == "", "—").otherwise(text(c)).alias("value")) for c in columns])
    return pages.select(*keys, F.inline(pairs))


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "(?i)[^a-z0-9-]+", "-"))


#: The columns of the report's CSV, by their names there.
CSV_COLUMNS = {"ruleKey": "rule_key", "title": "title", "category": "category", "severity": "severity", "priority": "priority", "effort": "effort", "affectedCount": "affected", "seoImpact": "impact", "recommendation": "advice"}


def _quoted(v: object) -> str:
    return '"' + ("" if v is None else str(v)).replace('"', '""') + '"'


def to_csv(placed: DataFrame) -> str:
    """Issues of ONE audit (25 rows at most) as CSV: bare header, all values quoted, no final line end."""
    rows = placed.orderBy("place").limit(1000).collect()
    return "\n".join([",".join(CSV_COLUMNS), *[",".join(_quoted(r[c]) for c in CSV_COLUMNS.values()) for r in rows]])


def table_csv(rows: DataFrame, path: str) -> None:
    """Any table as quoted CSV with a header, written in parallel."""
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def to_html(head: dict, placed: DataFrame, sample: DataFrame) -> str:
    """A self-contained page for ONE audit: counts by severity, the shortlist, all issues with samples, the roadmap.
    ``head``: label, project, client, domain, date, score, pages."""
    e = lambda v: escape("" if v is None else str(v), quote=True)
    urls: dict[str, list[str]] = {}
    for r in sample.orderBy("rule_key", "place").limit(1000).collect():
        urls.setdefault(r["rule_key"], []).append(r["url"])
    score = head.get("score")
    tone = "good" if (score or 0) >= 80 else "fair" if (score or 0) >= 50 else "poor"
    rows = [r.asDict() for r in placed.withColumn("days", bucket(F.col("priority"))).orderBy("place").limit(1000).collect()]
    urgent = [r for r in rows if r["severity"] in ("CRITICAL", "HIGH")]
    counts = "".join(f"<li class='{s}'>{s}: {sum(r['severity'] == s for r in rows)}</li>" for s in SEVERITIES)
    short = "".join(f"<li><b>{e(r['title'])}</b> ({e(r['affected'])}) {e(r.get('impact'))}</li>" for r in urgent[:8]) or "<li>None.</li>"
    body = "".join(
        f"<section><h3>{e(r['title'])}</h3><p>{e(r['severity'])} · {e(r['priority'])} · {e(r['category'])} · {e(r['affected'])} ({e(r['pct'])} %)</p><p>{e(r['advice'])}</p><ul>{''.join(f'<li>{e(u)}</li>' for u in urls.get(r['rule_key'], []))}</ul></section>" for r in rows
    )
    plan = "".join(f"<h3>{days} days</h3><ul>{''.join(f'<li>{e(r["title"])} ({e(r["affected"])}, {e(r["effort"])})</li>' for r in rows if r['days'] == days) or '<li>Nothing.</li>'}</ul>" for days in (30, 60, 90))
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{e(head.get('label'))}</title></head><body><h1>{e(head.get('project'))} — {e(head.get('client'))}</h1>"
        f"<p>{e(head.get('domain'))} · {e(head.get('date'))} · {e(head.get('label'))} · {e(head.get('pages'))}</p><p class='{tone}'>{'—' if score is None else e(score)} / 100</p>"
        f"<h2>Summary</h2><p>{len(rows)} issues, {len(urgent)} urgent.</p><ul>{counts}</ul><h2>First</h2><ul>{short}</ul><h2>Issues</h2>{body or '<p>None.</p>'}<h2>Roadmap</h2>{plan}</body></html>"
    )
