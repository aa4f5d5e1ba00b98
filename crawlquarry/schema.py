"""Fixed schema, header names and enum orders of the crawl tables."""

from __future__ import annotations

#: Canonical columns of a crawl row, their kind, and the headers that name them (compared trimmed, in
#: lower case, with inner white space as one space).
COLUMNS: dict[str, tuple[str, list[str]]] = {
    "url": ("string", ["address", "url"]),
    "content_type": ("string", ["content type", "content"]),
    "status_code": ("int", ["status code", "status_code", "http status code"]),
    "indexability": ("indexability", ["indexability"]),
    "indexability_status": ("string", ["indexability status"]),
    "title": ("string", ["title 1", "title", "page title 1"]),
    "title_length": ("int", ["title 1 length", "title length", "title 1 pixel width"]),
    "meta_description": ("string", ["meta description 1", "meta description"]),
    "meta_description_length": ("int", ["meta description 1 length", "meta description length"]),
    "h1": ("string", ["h1-1", "h1", "h1 1"]),
    "h2": ("string", ["h2-1", "h2", "h2 1"]),
    "canonical": ("string", ["canonical link element 1", "canonical", "canonical link element"]),
    "meta_robots": ("string", ["meta robots 1", "meta robots", "directives"]),
    "hreflang": ("string", ["hreflang 1", "hreflang", "href lang 1"]),
    "word_count": ("int", ["word count", "words"]),
    "crawl_depth": ("int", ["crawl depth", "depth"]),
    "inlinks": ("int", ["inlinks", "unique inlinks", "no. inlinks"]),
    "outlinks": ("int", ["outlinks", "unique outlinks", "no. outlinks"]),
    "redirect_url": ("string", ["redirect url", "redirect address"]),
    "response_time_ms": ("int", ["response time", "response time (ms)"]),
    "images": ("int", ["images", "no. images"]),
    "images_missing_alt": ("int", ["images missing alt text", "missing alt text", "no. images missing alt text"]),
    "structured_data": ("bool", ["structured data", "contains structured data"]),
    "structured_data_types": ("string", ["structured data types", "schema.org types"]),
    "in_sitemap": ("bool", ["in sitemap", "url in sitemap"]),
}

#: Header in its compared form -> canonical column.
HEADERS: dict[str, str] = {h: key for key, (_, names) in COLUMNS.items() for h in names}

#: Enum orders (the position is the rank).
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
TASK_STATUSES = ["TODO", "IN_PROGRESS", "BLOCKED", "DONE"]
PRIORITIES = ["P0", "P1", "P2", "P3"]

SQL_TYPES = {"string": "string", "int": "int", "bool": "boolean", "indexability": "string"}
