"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, licenses, linededup, packing, quality, records, simhash, urls
from ._shared import table


#: The day from which list entries and captures of pages are counted.
URL_DAY = "2024-01-01"
#: What stands before the host of a mirrored page.
MIRROR = "a.b.c.mirror."


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).drop("spans")


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_records(records.write_records(table(spark, sf_dir, "documents")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries over all hosts of pages: about a third is blocked for some time, by digits of the host's MD5.

    Some come back, some have their first path segment allowed, some registered domains are blocked whole, and
    some mirrors are, whose hosts have up to eight labels and whose paths three segments, starred keys among them.
    """
    host = urls.host_of(F.col("url"))
    hosts = table(spark, sf_dir, "pages").select(host.alias("host")).where("host != ''").distinct()
    digits = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    base = hosts.select("host", digits.alias("d"), F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".").alias("domain"))
    day = lambda n: F.lit(URL_DAY).cast("timestamp") + F.make_dt_interval(n)
    start = (F.col("d") % 200).cast("int")
    rows = [
        base.where("d % 3 = 0").select(F.col("host").alias("key"), F.lit("block").alias("action"), day(start).alias("at")),
        base.where("d % 6 = 0").select(F.col("host").alias("key"), F.lit("drop").alias("action"), day(start + 90).alias("at")),
        base.where("d % 12 = 0").select(F.col("host").alias("key"), F.lit("block").alias("action"), day(start + 150).alias("at")),
        base.where("d % 9 = 0").select(F.concat("host", F.lit("/en")).alias("key"), F.lit("allow").alias("action"), day(start + 30).alias("at")),
        base.where("d % 10 = 0").select(F.concat(F.lit(MIRROR), "host").alias("key"), F.lit("block").alias("action"), day(start + 10).alias("at")),
        base.where("d % 15 = 0").select(F.concat(F.lit(MIRROR), "host", F.lit("/web/2024/de")).alias("key"), F.lit("allow").alias("action"), day(start + 60).alias("at")),
        base.where("d % 8 = 0").select(F.concat(F.lit("*."), "host", F.lit("/web/2024/en")).alias("key"), F.lit("block").alias("action"), day(start + 20).alias("at")),
        base.groupBy("domain").agg(F.min("d").alias("d")).where("d % 2 = 0").select(F.col("domain").alias("key"), F.lit("block").alias("action"), day((F.col("d") % 100).cast("int") + 250).alias("at")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures: one is fetched every 37 minutes of a year, over and over; one in seven from a mirror as well."""
    at = F.lit(URL_DAY).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("page_id") * 37) % 525600).cast("int"))
    pages = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    mirrored = pages.where("page_id % 7 = 0 and url is not null").select(F.struct("page_id", F.lit(True).alias("mirror")).alias("capture_id"), F.concat(F.lit(f"https://{MIRROR}"), urls.host_of(F.col("url")), F.lit("/web/2024"), rest).alias("url"), at.alias("fetched_at"))
    return pages.select(F.struct("page_id", F.lit(False).alias("mirror")).alias("capture_id"), "url", at.alias("fetched_at")).unionByName(mirrored)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.evaluate(captures(spark, sf_dir), url_list(spark, sf_dir))
    return out.select("capture_id.page_id", "capture_id.mirror", "url", "host", "matched_key", "action", "blocked")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op6_url_filters": OP6_SQL, "op10_chat_formatting": OP10_SQL}


OP1_SQL = r"""
with parts as (select doc_id, coalesce(source, '') as site, text, string_split(text, chr(10)) as lines from documents),
lines as (
  select doc_id, site, unnest(range(len(lines))) as pos, unnest(lines) as line from parts
),
marked as (
  select doc_id, site, pos, line, regexp_replace(trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')), '', '') as k,
         regexp_matches(line, '[^ \t\n\x0b\x0c\r]') as wordy from lines
),
bad as (
  select k, min(struct_pack(d := doc_id, p := pos)) as first from marked where wordy group by k having count(distinct site) >= 5
),
judged as (
  select m.doc_id, m.pos, m.line, b.k is not null and not (b.first.d = m.doc_id and b.first.p = m.pos) as gone
  from marked m left join bad b on m.k = b.k and m.wordy
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_removed,
       coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text
from judged group by doc_id
"""

OP6_SQL = r"""
with plain as (
  select page_id, url, lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', '')) as host,
         timestamp '2024-01-01' + to_minutes((page_id * 37) % 525600) as at_,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)', 1) as path from pages
),
hosts_of as (
  select page_id, false as mirror, url, host, at_, path from plain
  union all
  select page_id, true, 'https://a.b.c.mirror.' || host || '/web/2024' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*((?s:.*))$', 1), 'a.b.c.mirror.' || host, at_, 'web/2024/' || path
  from plain where page_id % 7 = 0 and url is not null
),
base as (
  select host, cast('0x' || substr(md5(host), 1, 6) as bigint) as d, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain
  from (select distinct host from plain where host <> '')
),
entries as (
  select host as key, 'block' as action, timestamp '2024-01-01' + to_days(cast(d % 200 as integer)) as at_ from base where d % 3 = 0
  union all select host, 'drop', timestamp '2024-01-01' + to_days(cast(d % 200 + 90 as integer)) from base where d % 6 = 0
  union all select host, 'block', timestamp '2024-01-01' + to_days(cast(d % 200 + 150 as integer)) from base where d % 12 = 0
  union all select host || '/en', 'allow', timestamp '2024-01-01' + to_days(cast(d % 200 + 30 as integer)) from base where d % 9 = 0
  union all select 'a.b.c.mirror.' || host, 'block', timestamp '2024-01-01' + to_days(cast(d % 200 + 10 as integer)) from base where d % 10 = 0
  union all select 'a.b.c.mirror.' || host || '/web/2024/de', 'allow', timestamp '2024-01-01' + to_days(cast(d % 200 + 60 as integer)) from base where d % 15 = 0
  union all select '*.' || host || '/web/2024/en', 'block', timestamp '2024-01-01' + to_days(cast(d % 200 + 20 as integer)) from base where d % 8 = 0
  union all select domain, 'block', timestamp '2024-01-01' + to_days(cast(d % 100 + 250 as integer)) from (select domain, min(d) as d from base group by domain) where d % 2 = 0
),
ranked as (
  select key, at_, min(case action when 'block' then 0 when 'allow' then 1 else 2 end) as r from entries group by key, at_
),
spans as (
  select * from (select key, r, at_ as since, lead(at_) over (partition by key order by at_) as until from ranked) where r < 2
),
segments as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts, string_split(host, '.') as labels from hosts_of where host <> ''),
suffixes as (
  select page_id, mirror, at_, parts, k = 0 as whole, len(labels) - k as n, array_to_string(list_slice(labels, k + 1, len(labels)), '.') as suffix
  from segments, unnest(range(len(labels))) t(k) where k = 0 or len(labels) - k >= 2
),
asked as (
  select page_id, mirror, at_, n, 0 as s, 1 as plain, suffix as key from suffixes
  union all select page_id, mirror, at_, n, s, 1, suffix || '/' || array_to_string(list_slice(parts, 1, s), '/') from suffixes, unnest(range(1, len(parts) + 1)) t(s) where whole
  union all select page_id, mirror, at_, n, s, 0, '*.' || suffix || '/' || array_to_string(list_slice(parts, 1, s), '/') from suffixes, unnest(range(1, len(parts) + 1)) t(s)
),
met as (
  select a.page_id, a.mirror, max(struct_pack(n := a.n, s := a.s, plain := a.plain, key := a.key, r := -s.r)) as w from asked a
  join spans s on a.key = s.key and a.at_ >= s.since and (s.until is null or a.at_ < s.until) group by a.page_id, a.mirror
)
select h.page_id, h.mirror, h.url, h.host, m.w.key as matched_key, case when m.w.r = -1 or m.w is null then 'allow' else 'block' end as action,
       m.w is not null and m.w.r = 0 as blocked
from hosts_of h left join met m using (page_id, mirror)
"""

OP10_SQL = r"""
with clean as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from clean),
prefixes as (
  select conv_id, n, count(*) over (partition by conv_id) as size,
         md5(string_agg(md5(role) || md5(text), '') over (partition by conv_id order by n rows unbounded preceding)) as h
  from placed
),
kept as (
  select min(w.conv_id) as conv_id from (select * from prefixes where n = size) w
  where not exists (select 1 from prefixes p where p.n = w.n and p.h = w.h and p.size > p.n) group by w.n, w.h
)
select conv_id, cast(count(*) as bigint) as n_turns, string_agg(
  '<|im_start|>' || case when lower(trim(role)) in ('system', 'user', 'assistant', 'tool') then lower(trim(role)) else 'user' end || chr(10)
  || replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' order by n) as text
from placed where conv_id in (select conv_id from kept) group by conv_id
"""
