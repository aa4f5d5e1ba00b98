"""Ad-hoc queries of a table view: search, facets, sort, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL_COLUMNS = ["url", "status_code", "indexability", "title", "meta_description", "h1", "word_count", "crawl_depth", "inlinks"]


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which the text of any column holds the query, ignoring case. A blank query keeps all rows; otherwise it is
    taken as it is, outer spaces included."""
    if not query.strip():
        return df
    return df.where(reduce(Column.__or__, [F.instr(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(query.lower())) > 0 for c in columns]))


def facets(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """Rows whose columns have the chosen values as text; empty choices and unknown columns don't count."""
    for c, v in chosen.items():
        if v != "" and c in df.columns:
            df = df.where(F.coalesce(F.col(c).cast("string"), F.lit("")) == v)
    return df


def ordering(df: DataFrame, column: str, descending: bool = False) -> list[Column]:
    """Numbers by value, texts by Unicode collation with null as ''; nulls of numbers first when ascending."""
    kind = dict(df.dtypes)[column]
    c = F.collate(F.coalesce(F.col(column), F.lit("")), "UNICODE") if kind == "string" else F.col(column)
    return [c.desc_nulls_last() if descending else c.asc_nulls_first()]


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """Page ``number`` (from 0) in a total order; a number beyond the last page gives the last page."""
    rows = df.count()
    last = max(0, (rows + size - 1) // size - 1)
    return df.orderBy(*order).offset(min(max(0, number), last) * size).limit(size)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a facet, blanks left out."""
    text = F.col(column).cast("string")
    return df.where(text.isNotNull() & (text != "")).select(text.alias("value")).distinct()
