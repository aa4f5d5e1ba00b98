"""The catalogue of 25 audit rules: metadata and predicates as column expressions.

A rule is ``row`` (a predicate on one page), ``redirect`` (looks up the page that a redirect leads to) or ``group`` (pages
of an audit that share a text). Rules are checked when they are registered, so that one that can't be analysed is left out
and never breaks the others; their expressions use only functions that can't fail on data.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquarry.functions import exprs as X

#: Thresholds of the rules.
TITLE_LENGTH, DESCRIPTION_LENGTH, THIN_WORDS, SLOW_MS, DEEP = (30, 60), (70, 160), 200, 1000, 5

#: What a hit shows of its page, by rule; ``n`` is the number of pages of a group.
EVIDENCE: dict[str, str] = {
    "INDEXABLE_NOINDEX": "{meta_robots}",
    "NON_INDEXABLE_PAGES": "{indexability_status}",
    "ORPHAN_PAGES": "0 inlinks",
    "DEEP_PAGES": "depth {crawl_depth}",
    "STATUS_5XX": "HTTP {status_code}",
    "STATUS_4XX": "HTTP {status_code}",
    "BROKEN_INTERNAL_LINKS": "HTTP {status_code}, {inlinks} inlinks",
    "REDIRECT_3XX": "→ {redirect_url}",
    "REDIRECT_CHAIN": "→ {redirect_url}",
    "CANONICAL_NON_SELF": "canonical → {canonical}",
    "META_TITLE_LENGTH": "{title_length} caratteri",
    "META_TITLE_DUPLICATE": "{n} occorrenze",
    "META_DESC_LENGTH": "{meta_description_length} caratteri",
    "H1_DUPLICATE": "{n} occorrenze",
    "THIN_CONTENT": "{word_count} parole",
    "IMAGES_MISSING_ALT": "{images_missing_alt} immagini",
    "SLOW_RESPONSE": "{response_time_ms} ms",
}
#: What a redirect without a target shows.
NO_TARGET = "?"

C = F.col


def shown(key: str) -> Column:
    """The evidence of a rule's hit, null where it has none or its value is missing."""
    if key not in EVIDENCE:
        return none()
    pieces = [p for p in re.split(r"(\{\w+\})", EVIDENCE[key]) if p]
    value = lambda name: F.coalesce(C(name), F.lit(NO_TARGET)) if name == "redirect_url" else C(name).cast("string")
    return F.concat(*[value(p[1:-1]) if p[0] == "{" else F.lit(p) for p in pieces])


def none() -> Column:
    return F.lit(None).cast("string")


def zero(name: str) -> Column:
    return F.coalesce(C(name), F.lit(0))


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def any_issue(pattern: str) -> Column:
    return F.coalesce(F.exists("raw_issues", lambda i: F.coalesce(i.rlike(pattern), F.lit(False))), F.lit(False))


#: Facts that several rules use, by column: worked out once a page.
FLAGS: dict[str, Callable[[], Column]] = {
    "_html": lambda: C("content_type").isNull() | (C("content_type") == "") | F.lower("content_type").contains("html"),
    "_indexable": lambda: F.coalesce(C("indexability") == "INDEXABLE", F.lit(False)),
    **{f"_has_{c}": lambda c=c: X.has(C(c)) for c in ("title", "meta_description", "h1", "canonical", "redirect_url")},
}


def flagged(pages: DataFrame) -> DataFrame:
    return pages.withColumns({name: f() for name, f in FLAGS.items()})


def is_html() -> Column:
    return C("_html")


def is_indexable() -> Column:
    return C("_indexable")


def page() -> Column:
    return C("_html") & C("_indexable")


def has(name: str) -> Column:
    return C(f"_has_{name}")


#: What issues of a category cost a site, in our own words.
IMPACT: dict[str, str] = {
    "CRAWLABILITY": "Pages that can't be crawled or indexed don't appear in results.",
    "INTERNAL_LINKING": "Pages that few links reach are found late and count for little.",
    "STATUS_CODE": "Errors waste crawling and lose visitors.",
    "REDIRECT": "Each hop costs time and some of a link's weight.",
    "CANONICAL": "Without a clear canonical address, signals are split between copies.",
    "METADATA": "Results show these texts; weak ones are clicked less.",
    "HEADING": "Headings tell what a page is about.",
    "CONTENT": "Thin pages seldom answer a question.",
    "IMAGES": "Images without a text can't be read by machines or screen readers.",
    "HREFLANG": "Visitors land on the wrong language.",
    "STRUCTURED_DATA": "Faulty markup earns no rich results.",
    "PERFORMANCE": "Slow pages are crawled less and left sooner.",
    "SITEMAP": "Crawlers hear of these pages late.",
    "SECURITY": "Browsers warn of pages without encryption.",
}


@dataclass(frozen=True)
class Rule:
    key: str
    category: str
    severity: str
    priority: str
    effort: str
    title: str
    advice: str
    when: Callable[[], Column]
    kind: str = "row"
    group: str | None = None

    def evidence(self) -> Column:
        return shown(self.key)


def outside(name: str, bounds: tuple[int, int]) -> Column:
    return C(name).isNotNull() & ~C(name).between(*bounds)


def status(low: int, high: int | None = None) -> Column:
    return zero("status_code") >= low if high is None else zero("status_code").between(low, high)


# fmt: off
CATALOGUE: list[Rule] = [
    Rule("INDEXABLE_NOINDEX", "CRAWLABILITY", "HIGH", "P1", "LOW", "Live pages that ask not to be indexed", "Drop noindex where the page should rank.",
         lambda: matches(C("meta_robots"), "(?i)noindex") & F.coalesce(C("status_code") == 200, F.lit(False))),
    Rule("NON_INDEXABLE_PAGES", "CRAWLABILITY", "MEDIUM", "P2", "MEDIUM", "Pages that can't be indexed", "Check that each is excluded on purpose.",
         lambda: F.coalesce(C("indexability") == "NON_INDEXABLE", F.lit(False))),
    Rule("ORPHAN_PAGES", "INTERNAL_LINKING", "MEDIUM", "P2", "MEDIUM", "Pages without internal links", "Link them from related pages.",
         lambda: page() & (zero("inlinks") == 0)),
    Rule("DEEP_PAGES", "INTERNAL_LINKING", "LOW", "P3", "MEDIUM", "Pages many clicks from the start", "Shorten the way to important pages.",
         lambda: zero("crawl_depth") > DEEP),
    Rule("STATUS_5XX", "STATUS_CODE", "CRITICAL", "P0", "HIGH", "Server errors", "Find the cause in the server's logs.",
         lambda: status(500)),
    Rule("STATUS_4XX", "STATUS_CODE", "HIGH", "P1", "MEDIUM", "Client errors", "Restore, redirect or unlink these addresses.",
         lambda: status(400, 499)),
    Rule("BROKEN_INTERNAL_LINKS", "INTERNAL_LINKING", "HIGH", "P1", "MEDIUM", "Linked pages that answer with an error", "Point the links to pages that exist.",
         lambda: status(400) & (zero("inlinks") > 0)),
    Rule("REDIRECT_3XX", "REDIRECT", "MEDIUM", "P2", "LOW", "Redirects", "Link to the final address.",
         lambda: status(300, 399)),
    Rule("REDIRECT_CHAIN", "REDIRECT", "HIGH", "P1", "MEDIUM", "Redirects to redirects", "Redirect straight to the final address.",
         lambda: has("redirect_url"), kind="redirect"),
    Rule("CANONICAL_MISSING", "CANONICAL", "MEDIUM", "P2", "LOW", "Pages without a canonical address", "Name one on every page.",
         lambda: page() & ~has("canonical")),
    Rule("CANONICAL_NON_SELF", "CANONICAL", "LOW", "P3", "LOW", "Pages that name another page as canonical", "Check that this is meant.",
         lambda: is_html() & has("canonical") & (C("canonical") != C("url"))),
    Rule("META_TITLE_MISSING", "METADATA", "HIGH", "P1", "LOW", "Pages without a title", "Write a title for each.",
         lambda: page() & ~has("title")),
    Rule("META_TITLE_LENGTH", "METADATA", "LOW", "P3", "LOW", "Titles too short or too long", "Aim at 30 to 60 characters.",
         lambda: is_html() & has("title") & outside("title_length", TITLE_LENGTH)),
    Rule("META_TITLE_DUPLICATE", "METADATA", "MEDIUM", "P2", "MEDIUM", "Titles that several pages share", "Tell the pages apart.",
         lambda: page() & has("title"), kind="group", group="title"),
    Rule("META_DESC_MISSING", "METADATA", "MEDIUM", "P2", "LOW", "Pages without a description", "Write a description for each.",
         lambda: page() & ~has("meta_description")),
    Rule("META_DESC_LENGTH", "METADATA", "LOW", "P3", "LOW", "Descriptions too short or too long", "Aim at 70 to 160 characters.",
         lambda: has("meta_description") & outside("meta_description_length", DESCRIPTION_LENGTH)),
    Rule("H1_MISSING", "HEADING", "MEDIUM", "P2", "LOW", "Pages without a main heading", "Give each one.",
         lambda: page() & ~has("h1")),
    Rule("H1_DUPLICATE", "HEADING", "LOW", "P3", "MEDIUM", "Main headings that several pages share", "Tell the pages apart.",
         lambda: is_indexable() & has("h1"), kind="group", group="h1"),
    Rule("THIN_CONTENT", "CONTENT", "MEDIUM", "P2", "HIGH", "Pages with few words", "Extend or merge them.",
         lambda: page() & F.coalesce(C("word_count") < THIN_WORDS, F.lit(False))),
    Rule("IMAGES_MISSING_ALT", "IMAGES", "LOW", "P3", "MEDIUM", "Images without alternative text", "Describe them.",
         lambda: zero("images_missing_alt") > 0),
    Rule("HREFLANG_ERROR", "HREFLANG", "MEDIUM", "P2", "MEDIUM", "Faulty language links", "Make them mutual and valid.",
         lambda: any_issue("(?i)hreflang")),
    Rule("STRUCTURED_DATA_INVALID", "STRUCTURED_DATA", "LOW", "P3", "MEDIUM", "Faulty structured data", "Validate the markup.",
         lambda: any_issue("(?i)structured data|schema")),
    Rule("SLOW_RESPONSE", "PERFORMANCE", "MEDIUM", "P2", "HIGH", "Slow pages", "Cache, or speed up the server.",
         lambda: zero("response_time_ms") > SLOW_MS),
    Rule("INDEXABLE_NOT_IN_SITEMAP", "SITEMAP", "LOW", "P3", "LOW", "Indexable pages missing in the sitemap", "Add them.",
         lambda: page() & F.coalesce(~C("in_sitemap"), F.lit(False))),
    Rule("NON_HTTPS", "SECURITY", "HIGH", "P1", "MEDIUM", "Pages without encryption", "Serve them by https.",
         lambda: matches(C("url"), "(?i)^http://")),
]
# fmt: on

RECORD = (
    "audit_id string, ord bigint, url string, content_type string, status_code int, indexability string, indexability_status string, title string, title_length int, "
    "meta_description string, meta_description_length int, h1 string, canonical string, meta_robots string, word_count int, crawl_depth int, inlinks int, outlinks int, "
    "redirect_url string, response_time_ms int, images int, images_missing_alt int, in_sitemap boolean, raw_issues array<string>"
)


def split_usable(spark: SparkSession, rules: list[Rule]) -> tuple[list[Rule], list[str]]:
    """The rules whose expressions can be analysed, and the keys of the others, which are skipped."""
    empty = flagged(spark.createDataFrame([], RECORD)).withColumn("n", F.lit(0))
    try:
        empty.select(*[c.alias(f"c{n}") for n, r in enumerate(rules) for c in (r.when(), r.evidence())])
        return rules, []
    except Exception:  # at least one fails: look at each
        pass
    out, dropped = [], []
    for r in rules:
        try:
            empty.select(r.when(), r.evidence())
            out.append(r)
        except Exception:
            dropped.append(r.key)
    return out, dropped


def usable(spark: SparkSession, rules: list[Rule]) -> list[Rule]:
    """The rules that can be analysed; a warning names the others."""
    out, dropped = split_usable(spark, rules)
    if dropped:
        warnings.warn(f"rules left out, as they can't be analysed: {', '.join(dropped)}", stacklevel=2)
    return out


def metadata(spark: SparkSession, rules: list[Rule] | None = None):
    """(rule_key, rule_ord, category, severity, sev_rank, priority, effort, title, advice, description, impact), one row per rule."""
    from crawlquarry.schema import SEVERITIES

    rows = [(r.key, n, r.category, r.severity, SEVERITIES.index(r.severity), r.priority, r.effort, r.title, r.advice, r.title + ".", IMPACT.get(r.category, "")) for n, r in enumerate(rules or CATALOGUE)]
    return spark.createDataFrame(rows, "rule_key string, rule_ord int, category string, severity string, sev_rank int, priority string, effort string, title string, advice string, description string, impact string")
