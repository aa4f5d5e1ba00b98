"""Queries of the general data-processing problems (p1 to p5) over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquarry.operators import bad_records, drift, packed, snapshots, units
from crawlquarry.plans.sized import scratch, written
from crawlquarry.schema import COLUMNS
from crawlquarry.sources import csv_files

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.faulty(table(spark, d, "internal_all")).select("file_id", F.col("line_no").cast("int").alias("line_no"), "reason")


def p1_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Faults with the byte at which the quoting breaks."""
    return bad_records.faulty(table(spark, d, "internal_all")).withColumn("line_no", F.col("line_no").cast("int"))


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """All other records, loaded as typed rows; cells under other headers as text."""
    return _flat(bad_records.typed(table(spark, d, "internal_all")).withColumn("line_no", F.col("line_no").cast("int")), "extra")


def _flat(rows: DataFrame, *maps: str) -> DataFrame:
    """Maps as text, their entries in order."""
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return rows.withColumns({m: F.coalesce(text(m), F.lit("")) for m in maps})


FILES = "internal_all"


def files_rows(spark: SparkSession, d: str) -> DataFrame:
    """The exports written as files and read again: what can be loaded, by file and address. Lost quotation marks in the
    midst of files cost their line alone."""
    ingest = csv_files.Ingest(spark, _export(spark, d), header_within=None)
    names = ingest.raw.select("file_id", "file_name").distinct()
    return ingest.rows().join(names, "file_id").select("file_name", "url", "status_code", "title", "word_count", "inlinks", "in_sitemap")


PAGE_COLUMNS = ["status_code", "indexability", "title", "word_count", "inlinks", "in_sitemap"]


def files_pages(spark: SparkSession, d: str) -> DataFrame:
    """The same files merged by page: the first value of each column, the last of each unknown one."""
    return _flat(csv_files.Ingest(spark, _export(spark, d), header_within=None).pages().select("url", *PAGE_COLUMNS, "extra"), "extra")


def unknown_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of all exports that name no canonical column."""
    return csv_files.unknown(drift.timeline(table(spark, d, "export_files")))


def files_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of an import in which some paths can't be read, beside the warnings of none of the others."""
    folder = scratch(spark)
    return csv_files.Ingest(spark, [*_export(spark, d), f"{folder}/lost.csv", f"{d}/orders.parquet"]).warnings


def files_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Number and size of the files of an import."""
    size = csv_files.sizes(_export(spark, d))
    return spark.createDataFrame([(len(size), sum(size.values()))], "files long, bytes long")


def _export(spark: SparkSession, d: str) -> list[str]:
    lines = table(spark, d, FILES).where("raw_line is not null and line_no is not null and file_id is not null").groupBy("file_id", "line_no").agg(F.max(F.struct("loaded_at", "raw_line")).alias("r"))
    return csv_files.export(lines.select("file_id", F.col("file_id").cast("string").alias("name"), "line_no", "r.raw_line"), scratch(spark))


def _drift(spark: SparkSession, d: str) -> drift.Drift:
    return drift.Drift(table(spark, d, "export_files"), table(spark, d, "export_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).changes().select("file_id", "change_kind", "column_name")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes with the older header, both kinds and the alternatives that appear."""
    return _drift(spark, d).changes().withColumn("appeared", F.array_join("appeared", ","))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """All exports in one table of constant columns and types; what is unread and what is beside them as text."""
    return _flat(_drift(spark, d).table(), "unread", "extra")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.changes(table(spark, d, "compare_urls"), table(spark, d, "audits")).select("schedule_id", "audit_id", "url", "change_kind")


def p3_changed_columns(spark: SparkSession, d: str) -> DataFrame:
    """How often each column changed, by audit."""
    found = snapshots.changes(table(spark, d, "compare_urls"), table(spark, d, "audits"), ("status_code", "title", "canonical", "indexability"))
    return found.select("audit_id", F.explode("changed").alias("column_name")).groupBy("audit_id", "column_name").agg(F.count("*").alias("n_changed"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the last snapshot of each schedule, merged into the kept one before it."""
    pages, audits = table(spark, d, "compare_urls"), table(spark, d, "audits")
    line = written(snapshots.timeline(audits))
    kept = snapshots.Kept(spark, scratch(spark))
    ending = line.join(line.where("next_audit_id is null").select("schedule_id", F.col("seq").alias("last")), "schedule_id")
    kept.advance(pages, ending.where("seq = last - 1"))
    kept.advance(pages, ending.where("seq = last"))
    return kept.changes().select("schedule_id", "audit_id", "url", "change_kind")


def _units(spark: SparkSession, d: str) -> units.Units:
    return units.Units(table(spark, d, "crawled_urls"), table(spark, d, "audits"), table(spark, d, "unit_scale"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).converted()


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Every cell in common units, null where nothing was measured."""
    return _units(spark, d).values().select("ord", "field_name", "unit", "common_value")


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    """The unit of each audit's plain numbers and the kind of link that gave it."""
    return _units(spark, d).sources


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.values(table(spark, d, "crawled_urls"), least=2)


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of every cell, also of those with a single value."""
    return packed.values(table(spark, d, "crawled_urls"), least=1)


QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_offsets, p1_rows, files_rows, files_pages, files_warnings, unknown_headers, files_bytes, p2_found, p2_changes, p2_table, p3_found, p3_changed_columns, p3_kept, p4_found, p4_values, p4_sources, p5_found, p5_values)}

#: Fixed to the definitions of the problems; independent of the operators (regular expressions and joins).
SQL: dict[str, str] = {
    "p1_found": r"""
with r as (select distinct file_id, line_no, ltrim(raw_line, chr(65279)) as l from internal_all where raw_line is not null and trim(raw_line, chr(32) || chr(9) || chr(10) || chr(13)) <> ''),
h as (select file_id, line_no as hl, l as hdr, case when s = mc then ',' when s = ms then ';' when s = mt then chr(9) else '|' end as sep, s + 1 as n
      from (select *, greatest(mc, ms, mt, mp) as s from (select *, length(l) - length(replace(l, ',', '')) as mc, length(l) - length(replace(l, ';', '')) as ms, length(l) - length(replace(l, chr(9), '')) as mt, length(l) - length(replace(l, '|', '')) as mp
            from r where regexp_matches(l, '(?i)(?:^|[,;\t|])"?\s*(?:address|url)\s*"?(?:$|[,;\t|])')))
      qualify row_number() over (partition by file_id order by line_no) = 1),
c as (select file_id, hl, sep, n, list_transform(string_split(hdr, sep), lambda x: lower(trim(trim(trim(x), '"')))) as names from h),
i as (select *, coalesce(list_position(names, 'address'), list_position(names, 'url')) as ia,
      coalesce(list_position(names, 'status code'), list_position(names, 'status_code'), list_position(names, 'http status code')) as ist, coalesce(list_position(names, 'word count'), list_position(names, 'words')) as iw from c),
j as (select r.file_id, r.line_no, r.l, i.n, i.ia, i.ist, i.iw, case i.sep when ',' then ',' when ';' then ';' when '|' then '\|' else '\t' end as s, i.sep from r join i on r.file_id = i.file_id and r.line_no > i.hl),
t as (select *, regexp_full_match(l, '(?s)(?:"(?:[^"]|"")*"|[^"' || s || ']*)(?:' || s || '(?:"(?:[^"]|"")*"|[^"' || s || ']*))*') as ok,
      list_transform(regexp_extract_all(sep || l, '(?s)' || s || '("(?:[^"]|"")*"|[^"' || s || ']*)', 1), lambda x: trim(case when x like '"%' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end, chr(32) || chr(9) || chr(10) || chr(13))) as f from j),
v as (select *, case when not ok then 'quoting' when len(f) <> n then 'column_count'
      when not regexp_full_match(f[ia], '(?i)https?://[^\s/?#:]\S*') or not (coalesce(f[ist], '') = '' or regexp_full_match(f[ist], '0+|0*[1-5][0-9][0-9]')) or not (coalesce(f[iw], '') = '' or regexp_full_match(f[iw], '[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+')) then 'invalid_value' end as reason from t)
select file_id, line_no, min(reason) as reason from v where reason is not null group by file_id, line_no""",
    "p3_found": """
with a as (select audit_id, schedule_id, row_number() over (partition by schedule_id order by audit_date, audit_id) as seq from audits where status = 'READY' and schedule_id is not null),
p as (select schedule_id, seq, trim(url) as url, status_code, coalesce(title, '') as title, coalesce(canonical, '') as canonical from compare_urls join a using (audit_id) where url is not null
      qualify row_number() over (partition by audit_id, trim(url) order by ord desc) = 1),
j as (select coalesce(n.schedule_id, o.schedule_id) as schedule_id, coalesce(n.seq, o.seq + 1) as seq, coalesce(n.url, o.url) as url,
      case when o.url is null then 'added' when n.url is null then 'removed' when n.status_code is distinct from o.status_code or n.title <> o.title or n.canonical <> o.canonical then 'changed' end as change_kind
      from p n full join p o on n.schedule_id = o.schedule_id and n.url = o.url and n.seq = o.seq + 1)
select schedule_id, a.audit_id, url, change_kind from j join a using (schedule_id, seq) where change_kind is not null and seq > 1""",
    "p3_changed_columns": """
with a as (select audit_id, schedule_id, row_number() over (partition by schedule_id order by audit_date, audit_id) as seq from audits where status = 'READY' and schedule_id is not null),
p as (select schedule_id, seq, audit_id, trim(url) as url, status_code, coalesce(title, '') as title, coalesce(canonical, '') as canonical, coalesce(indexability, '') as indexability from compare_urls join a using (audit_id) where url is not null
      qualify row_number() over (partition by audit_id, trim(url) order by ord desc) = 1),
c as (select n.audit_id, unnest([case when n.status_code is distinct from o.status_code then 'status_code' end, case when n.title <> o.title then 'title' end, case when n.canonical <> o.canonical then 'canonical' end, case when n.indexability <> o.indexability then 'indexability' end]) as column_name
      from p n join p o on n.schedule_id = o.schedule_id and n.url = o.url and n.seq = o.seq + 1)
select audit_id, column_name, count(*) as n_changed from c where column_name is not null group by audit_id, column_name""",
}

SQL["p2_found"] = r"""
with f as (select file_id, series_id, row_number() over (partition by series_id order by exported_at, file_id) as seq, list_transform(coalesce(headers, []), lambda h: lower(regexp_replace(trim(replace(coalesce(h, ''), chr(65279), ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '\s+', ' ', 'g'))) as names from export_files),
p as (select n.file_id, o.file_id as prev_id from f n join f o on n.series_id = o.series_id and n.seq = o.seq + 1),
h as (select file_id, unnest(names) as name, generate_subscripts(names, 1) as pos from f),
x as (select file_id, row_no, unnest(cells) as cell, generate_subscripts(cells, 1) as pos from export_rows),
t as (select file_id, row_no, pos, trim(coalesce(cell, ''), chr(32) || chr(9) || chr(10) || chr(13)) as cell from x),
k as (select file_id, pos, case when bool_or(cell <> '' and not regexp_full_match(cell, '[+-]?[0-9]+(\.[0-9]+)?')) then 'text' when bool_or(regexp_full_match(cell, '[+-]?[0-9]+\.[0-9]+')) then 'decimal' when bool_or(cell <> '') then 'integer' end as kind from t group by file_id, pos),
gone as (select p.file_id, p.prev_id, h.name, h.pos from p join h on h.file_id = p.prev_id where not exists (select 1 from h g where g.file_id = p.file_id and g.name = h.name)),
fresh as (select p.file_id, p.prev_id, h.name, h.pos from p join h on h.file_id = p.file_id where not exists (select 1 from h g where g.file_id = p.prev_id and g.name = h.name)),
a as (select h.file_id, t.row_no, t.cell as address from h join t using (file_id, pos) where h.name in ('address', 'url') and t.cell <> ''),
c as (select *, lower(regexp_replace(cell, '\s+', ' ', 'g')) as low from t where cell <> ''),
v as (select file_id, row_no, pos, coalesce(cast(try_cast(replace(nullif(regexp_extract(low, '^(?:[a-z]+/)?([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)(?:[?+%]|\s+[a-z][a-z ]*)?$', 1), ''), ',', '') as double) as varchar), low) as v from c),
old as (select distinct g.file_id, g.name, a.address, v.v from gone g join v on v.file_id = g.prev_id and v.pos = g.pos join a on a.file_id = v.file_id and a.row_no = v.row_no where a.address in (select b.address from a b where b.file_id = g.file_id)),
new as (select distinct g.file_id, g.name, a.address, v.v from fresh g join v on v.file_id = g.file_id and v.pos = g.pos join a on a.file_id = v.file_id and a.row_no = v.row_no where a.address in (select b.address from a b where b.file_id = g.prev_id)),
hits as (select o.file_id, o.name as old_name, n.name as new_name, count(distinct o.address) as hits from old o join new n on o.file_id = n.file_id and o.address = n.address and o.v = n.v group by 1, 2, 3),
r as (select hits.file_id, old_name, new_name, hits / greatest((select count(distinct address) from old where old.file_id = hits.file_id and old.name = old_name), (select count(distinct address) from new where new.file_id = hits.file_id and new.name = new_name))::double as share from hits),
ren as (select file_id, old_name, new_name from (select *, row_number() over (partition by file_id, old_name order by share desc, new_name) as i, row_number() over (partition by file_id, new_name order by share desc, old_name) as j from r where share > 0.5) where i = 1 and j = 1),
kept as (select p.file_id, p.prev_id, h.name, h.pos, coalesce(ren.old_name, h.name) as before from p join h on h.file_id = p.file_id left join ren on ren.file_id = p.file_id and ren.new_name = h.name)
select file_id, 'added' as change_kind, name as column_name from fresh where not exists (select 1 from ren where ren.file_id = fresh.file_id and new_name = name)
union all select file_id, 'removed', name from gone where not exists (select 1 from ren where ren.file_id = gone.file_id and old_name = name)
union all select file_id, 'renamed', new_name from ren
union all select kept.file_id, 'type_changed', kept.name from kept join h o on o.file_id = kept.prev_id and o.name = kept.before join k kn on kn.file_id = kept.file_id and kn.pos = kept.pos join k ko on ko.file_id = o.file_id and ko.pos = o.pos where kn.kind <> ko.kind"""


# ---- all of p3: the last delivery alone ---------------------------------------------------------------------------
SQL["p3_kept"] = SQL["p3_found"] + " and a.seq = (select max(seq) from a b where b.schedule_id = a.schedule_id)"


# ---- all of p1: offsets of faults and typed rows -------------------------------------------------------------------
_P1 = SQL["p1_found"]
_TOKENS = _P1[: _P1.index("\nselect file_id")]
SQL["p1_offsets"] = _TOKENS + r""",
o as (select *, regexp_extract(l, '(?s)^(?:(?:"(?:[^"]|"")*"|[^"' || s || ']*)' || s || ')*') as pre from v where reason is not null),
e as (select file_id, line_no, reason, case when reason = 'quoting' then strlen(pre) + strlen(regexp_extract(substr(l, length(pre) + 1), '(?s)^(?:"(?:[^"]|"")*"|[^"]*)')) end as error_offset from o)
select file_id, line_no, reason, error_offset from e qualify row_number() over (partition by file_id, line_no order by reason, error_offset nulls first) = 1"""


def _typed_sql(final: str, keep: str) -> str:
    """Typed rows from the tokens of p1: of each record the latest delivery, each column by its first header."""
    names = "list_transform(string_split(hdr, sep), lambda x: lower(regexp_replace(trim(trim(trim(x), '\"')), '\\s+', ' ', 'g')))"
    raw = "list_transform(string_split(hdr, sep), lambda x: case when x like '\"%' then replace(substr(x, 2, length(x) - 2), '\"\"', '\"') else x end)"
    latest = _TOKENS.replace("select distinct file_id, line_no, ltrim(raw_line, chr(65279)) as l from internal_all", "select file_id, line_no, ltrim(raw_line, chr(65279)) as l from internal_all").replace(" <> ''),\nh as", " <> '' qualify row_number() over (partition by file_id, line_no order by loaded_at desc, raw_line desc) = 1),\nh as", 1)
    latest = latest.replace("r.l, i.n, i.ia, i.ist, i.iw,", "r.l, i.n, i.ia, i.ist, i.iw, i.hdr,").replace("c as (select file_id, hl, sep, n,", "c as (select file_id, hl, sep, n, hdr,")
    own = {k: f"list_filter(ns, lambda x: x in ({', '.join(repr(h) for h in heads)}))[1]" for k, (_, heads) in COLUMNS.items()}
    at = {k: f"case when {o} is not null then len(ns) - list_position(list_reverse(ns), {o}) + 1 end" for k, o in own.items()}
    int_ = lambda c: f"try_cast(regexp_extract(regexp_replace({c}, '[^0-9-]', '', 'g'), '^-?[0-9]+') as int)"
    space = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    trim = lambda c: f"regexp_replace({c}, '^{space}+|{space}+$', '', 'g')"
    kinds = {
        "string": lambda c: f"nullif({trim(c)}, '')", "int": int_, "bool": lambda c: f"case when coalesce({trim(c)}, '') = '' then null else regexp_full_match(lower({trim(c)}), 'true|yes|1|si|sì') end",
        "indexability": lambda c: f"case when {c} is null then null when regexp_matches(lower({c}), 'non[-\\s]?index') then 'NON_INDEXABLE' when contains(lower({c}), 'index') then 'INDEXABLE' else 'UNKNOWN' end",
    }
    cell = "list_transform(regexp_extract_all(sep || l, '(?s)' || s || '(\"(?:[^\"]|\"\")*\"|[^\"' || s || ']*)', 1), lambda x: case when x like '\"%' then replace(substr(x, 2, length(x) - 2), '\"\"', '\"') else x end)"
    columns = ", ".join(f"{kinds[kind](f'g[at_{k}]')} as {k}" for k, (kind, _) in COLUMNS.items())
    rest = f"list_filter(list_transform(range(1, len(rn) + 1), lambda i: case when i in ({', '.join(f'coalesce(at_{k}, 0)' for k in COLUMNS)}) or coalesce(trim(g[i]), '') = '' then null else rn[i] || case when list_position(rn, rn[i]) <> i then '#' || (i - 1) else '' end || '=' || g[i] end), lambda x: x is not null)"
    pairs = rest.replace("end || '=' || g[i] end", "end || chr(1) || g[i] end")
    return (
        latest + f", m as (select file_id, line_no, l, s, sep, {names} as ns, {raw} as rn, {cell} as g from v where reason is null), "
        + f"b as (select *, {', '.join(f'{a} as at_{k}' for k, a in at.items())} from m), "
        + f"z as (select file_id, line_no, {columns}, {pairs} as pairs, array_to_string(list_sort({rest}), '|') as extra from b) select {keep} from z {final}"
    )


SQL["p1_rows"] = _typed_sql("", "* exclude (pairs)")
SQL["files_rows"] = _typed_sql("where url is not null", "cast(file_id as varchar) || '.csv' as file_name, url, status_code, title, word_count, inlinks, in_sitemap")
SQL["files_pages"] = (
    "with y as (select *, row_number() over (order by cast(file_id as varchar), line_no) as o from (" + _typed_sql("where url is not null", "*") + ")), "
    "k as (select url, split_part(pair, chr(1), 1) as key, arg_max(split_part(pair, chr(1), 2), o) as value from (select url, o, unnest(pairs) as pair from y) group by 1, 2), "
    "e as (select url, array_to_string(list_sort(list(key || '=' || value)), '|') as extra from k group by url) "
    "select y.url, " + ", ".join(f"arg_min({c}, o) filter (where {c} is not null) as {c}" for c in PAGE_COLUMNS) + ", coalesce(any_value(e.extra), '') as extra from y left join e on e.url = y.url group by y.url"
)
SQL["files_warnings"] = "select * from (values ('lost.csv', 'no such file'), ('orders.parquet', 'neither .csv nor .zip')) as t(file_name, warning)"
SQL["unknown_headers"] = SQL["p2_found"][: SQL["p2_found"].index(",\np as")] + " select distinct name from (select unnest(names) as name from f) where trim(name) <> '' and name not in (" + ", ".join(repr(h) for _, heads in COLUMNS.values() for h in heads) + ")"
SQL["files_bytes"] = "select count(distinct file_id) as files, cast(sum(strlen(l) + 1) as bigint) as bytes from (select file_id, raw_line as l from internal_all where raw_line is not null and line_no is not null and file_id is not null qualify row_number() over (partition by file_id, line_no order by loaded_at desc, raw_line desc) = 1)"

# ---- all of p2: changes with their kinds, and the common table -----------------------------------------------------
_P2 = SQL["p2_found"][: SQL["p2_found"].index("\nselect file_id, 'added'")]
_BRANCHES = r""",
g as (select file_id, pos, bool_or(regexp_full_match(cell, '[+-]?[0-9]+')) as i, bool_or(regexp_full_match(cell, '[+-]?[0-9]+\.[0-9]+')) as d, bool_or(cell <> '' and not regexp_full_match(cell, '[+-]?[0-9]+(\.[0-9]+)?')) as x from t group by file_id, pos),
u as (select h.file_id, h.name, k.kind, coalesce(g.i, false) as i, coalesce(g.d, false) as d, coalesce(g.x, false) as x from (select file_id, name, min(pos) as pos from h group by 1, 2) h left join k using (file_id, pos) left join g using (file_id, pos)),
w as (select p.file_id, n.name as column_name, coalesce(ren.old_name, n.name) as old_name, ren.old_name is not null as moved, o.name is not null as was, o.kind as old_kind, n.kind as new_kind,
      array_to_string(list_filter([case when n.i and not coalesce(o.i, false) then 'integer' end, case when n.d and not coalesce(o.d, false) then 'decimal' end, case when n.x and not coalesce(o.x, false) then 'text' end], lambda y: y is not null), ',') as appeared
      from p join u n on n.file_id = p.file_id left join ren on ren.file_id = p.file_id and ren.new_name = n.name left join u o on o.file_id = p.prev_id and o.name = coalesce(ren.old_name, n.name))
"""
SQL["p2_changes"] = _P2 + _BRANCHES + r"""select file_id, 'added' as change_kind, column_name, null as old_name, old_kind, new_kind, appeared from w where not was
union all select file_id, 'renamed', column_name, old_name, old_kind, new_kind, appeared from w where moved
union all select file_id, 'type_changed', column_name, old_name, old_kind, new_kind, appeared from w where was and old_kind <> new_kind
union all select p.file_id, 'removed', o.name, o.name, o.kind, null, '' from p join u o on o.file_id = p.prev_id where not exists (select 1 from h where h.file_id = p.file_id and h.name = o.name) and not exists (select 1 from ren where ren.file_id = p.file_id and ren.old_name = o.name)"""


def _table_sql() -> str:
    known = " ".join(f"when name in ({', '.join(map(repr, heads))}) then '{k}'" for k, (_, heads) in COLUMNS.items())
    constant = drift.CONSTANT
    low = lambda c: f"lower(regexp_replace({c}, '\\s+', ' ', 'g'))"
    number = lambda c: f"replace(nullif(regexp_extract({low(c)}, '^(?:[a-z]+/)?([+-]?[0-9][0-9,]*(?:\\.[0-9]+)?)(?:[?+%]|\\s+[a-z][a-z ]*)?$', 1), ''), ',', '')"
    out, unread = [], []
    for k in constant:
        kind, c = COLUMNS[k][0], f"c_{k}"
        tag = f"case when regexp_full_match({c}, '[+-]?[0-9]+') then 'integer' when regexp_full_match({c}, '[+-]?[0-9]+\\.[0-9]+') then 'decimal' when {c} is not null then 'text' end"
        value = c
        if kind == "int":
            value = f"case when regexp_full_match({number(c)}, '[+-]?[0-9]+(\\.0+)?') then try_cast(regexp_extract({number(c)}, '^[+-]?[0-9]+') as bigint) end"
            out += [f"case when {tag} = 'integer' then try_cast({c} as bigint) end as {k}_integer", f"case when {tag} = 'decimal' then try_cast({c} as double) end as {k}_decimal", f"case when {tag} = 'text' then {c} end as {k}_text"]
        elif kind == "bool":
            value = f"case when {low(c)} in ('true', 't', 'yes', 'y', 'si', 'sì') or try_cast({number(c)} as double) = 1 then true when {low(c)} in ('false', 'f', 'no', 'n') or try_cast({number(c)} as double) = 0 then false end"
        elif kind == "indexability":
            value = f"case when {c} is null then null when regexp_matches(lower({c}), 'non[-\\s]?index') then 'NON_INDEXABLE' when contains(lower({c}), 'index') then 'INDEXABLE' else 'UNKNOWN' end"
        out += [f"{value} as {k}", f"{tag} as {k}_as"]
        unread.append(f"case when {c} is not null and ({value}) is null then '{k}=' || {c} end")
    cells = ", ".join(f"max(case when field = '{k}' and n = 1 then cell end) as c_{k}" for k in constant)
    rest = f"list_sort(list(case when n > 1 then field || '#' || n else field end || '=' || cell) filter (where cell is not null and (n > 1 or field not in ({', '.join(map(repr, constant))}))))"
    return _P2.replace("with f as", "with recursive f as", 1) + f""",
nm as (select f.series_id, h.name, min(f.seq) as since, case {known} end as known from h join f using (file_id) group by 1, 2, 4),
lk as (select f.series_id, ren.old_name as a, ren.new_name as b from ren join f using (file_id) union select f.series_id, ren.new_name, ren.old_name from ren join f using (file_id)),
reach as (select series_id, name, name as other from nm union select reach.series_id, reach.name, lk.b from reach join lk on lk.series_id = reach.series_id and lk.a = reach.other),
fld as (select reach.series_id, reach.name, arg_min(coalesce(nm.known, nm.name), (nm.known is null)::int * 1000000000 + nm.since) as field from reach join nm on nm.series_id = reach.series_id and nm.name = reach.other group by 1, 2),
col as (select m.file_id, f.series_id, m.pos, fld.field, row_number() over (partition by m.file_id, fld.field order by m.pos) as n from (select file_id, name, min(pos) as pos from h group by 1, 2) m join f using (file_id) join fld on fld.series_id = f.series_id and fld.name = m.name),
rows as (select file_id, row_no, cells, row_number() over () as rid from export_rows),
q as (select rows.rid, rows.file_id, rows.row_no, col.series_id, col.field, col.n, nullif(trim(rows.cells[col.pos], chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '') as cell from rows join col using (file_id)),
a1 as (select rid, file_id, row_no, series_id, {cells}, coalesce(array_to_string({rest}, '|'), '') as extra from q group by 1, 2, 3, 4)
select file_id, series_id, row_no, {', '.join(out)}, array_to_string(list_sort(list_filter([{', '.join(unread)}], lambda y: y is not null)), '|') as unread, extra from a1"""


SQL["p2_table"] = _table_sql()
