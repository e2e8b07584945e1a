"""Labels, dates, cells, text and JSON: scalar operators over text made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.plans import base as b
from tidemark.plans.catalogue import query

_LABEL = {
    0: ("cast(y as varchar) || ' Q' || q", lambda y, q: F.concat_ws("", y, F.lit(" Q"), q)),
    1: ("'Q' || q || ' ' || y", lambda y, q: F.concat_ws("", F.lit("Q"), q, F.lit(" "), y)),
    2: ("y || ' - q' || q", lambda y, q: F.concat_ws(" - q", y, q)),
    3: ("'quarter  ' || q || ' ' || y", lambda y, q: F.concat_ws("", F.lit("quarter  "), q, F.lit(" "), y)),
    4: ("y || ' Q5'", lambda y, q: F.concat_ws("", y, F.lit(" Q5"))),
}


@query("""select o_orderkey, case when o_orderkey % 5 = 4 then null else year(o_orderdate)*4 + quarter(o_orderdate) - 1 end q from orders""")
def parse_quarter(spark, d):
    """Five spellings of the order's quarter, one of them not a quarter, read back."""
    o = b.read(spark, d, "orders")
    y, q = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    text = F.coalesce(*(F.when(F.col("o_orderkey") % 5 == k, f(y, q)) for k, (_, f) in _LABEL.items()))
    return o.select("o_orderkey", lb.parse_quarter(text).cast("long").alias("q"))


@query("select o_orderkey, year(o_orderdate) || ' Q' || quarter(o_orderdate) as label, last_day(make_date(year(o_orderdate)::int, (quarter(o_orderdate)*3)::int, 1))::varchar as quarter_end, (year(l.s)*12 + month(l.s)) - (year(o_orderdate)*12 + month(o_orderdate)) as months from orders join (select l_orderkey k, max(l_shipdate) s from lineitem group by 1) l on l.k = o_orderkey")
def quarter_arithmetic(spark, d):
    s = b.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("s"))
    j = b.read(spark, d, "orders").join(s, F.col("k") == F.col("o_orderkey"))
    q = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1
    month = lambda x: (F.year(x) * 12 + F.month(x) - 1).cast("long")
    return j.select("o_orderkey", lb.quarter_label(q).alias("label"), lb.quarter_end(q).cast("string").alias("quarter_end"), lb.months_between_index(month("s"), month("o_orderdate")).alias("months"))


@query("select o_orderkey, case when o_orderkey % 7 = 0 then null else year(o_orderdate)*12 + month(o_orderdate) - 1 end m from orders")
def parse_release_month(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, F.lit("published 2020 and 2021 in May")).when(k % 7 == 1, F.date_format("o_orderdate", "MMM yyyy")).when(k % 7 == 2, F.date_format("o_orderdate", "d MMMM yyyy"))
    text = F.coalesce(text, F.concat(F.date_format("o_orderdate", "d"), F.lit("th of "), F.date_format("o_orderdate", "MMMM, yyyy")))
    return b.read(spark, d, "orders").select("o_orderkey", lb.parse_release_month(text).cast("long").alias("m"))


@query("select o_orderkey, case when o_orderkey % 4 = 3 then null else year(o_orderdate)*12 + month(o_orderdate) - 1 end v from orders")
def read_vintage_label(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.date_format("o_orderdate", "MMM-yy"), F.when(k % 4 == 1, F.lit(" [1990 prices]")).when(k % 4 == 2, F.lit(" [1990 prices] KP5")).when(k % 4 == 3, F.lit(" ?")).otherwise(""))
    return b.read(spark, d, "orders").select("o_orderkey", lb.read_vintage_label(text).cast("long").alias("v"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date)::varchar end as day, case when o_orderkey % 5 = 0 then null else (o_orderkey % 24)*60 + o_orderkey % 60 end as minute from orders")
def parse_day(spark, d):
    k = F.col("o_orderkey")
    day = F.when(k % 5 == 0, F.lit("31 February 2020")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    hour = F.when((k % 24) % 12 == 0, 12).otherwise((k % 24) % 12)
    time = F.when(k % 5 == 0, F.lit("13:00am")).otherwise(F.concat(hour.cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 24 < 12, "am").otherwise("pm")))
    return b.read(spark, d, "orders").select("o_orderkey", lb.parse_day(day).cast("string").alias("day"), lb.parse_time_of_day(time).cast("long").alias("minute"))


@query("select o_orderkey, case when o_orderkey % 200 in (0, 60) then null else (date '1899-12-31' + cast(o_orderkey % 200 - case when o_orderkey % 200 > 60 then 1 else 0 end as int))::date::varchar end d1900, (date '1904-01-01' + cast(o_orderkey % 200 as int))::date::varchar d1904 from orders")
def serial_to_date(spark, d):
    s = F.col("o_orderkey") % 200
    return b.read(spark, d, "orders").select("o_orderkey", lb.serial_to_date(s).cast("string").alias("d1900"), lb.serial_to_date(s, True).cast("string").alias("d1904"))


@query("""with f(k, c) as (values (0, 'dd/mm/yyyy'), (1, '0.00'), (2, 'General'), (3, '"day" 0'), (4, '[Red]0.0'), (5, 'mmm-yy'), (6, 'h:mm'), (7, '\\d0'), (8, '#,##0')) select n_nationkey, c as code, k in (0, 5, 6) is_date from nation join f on k = n_nationkey % 9""")
def is_date_format(spark, d):
    codes = F.array(*(F.lit(x) for x in ("dd/mm/yyyy", "0.00", "General", '"day" 0', "[Red]0.0", "mmm-yy", "h:mm", "\\d0", "#,##0")))
    n = b.read(spark, d, "nation").select("n_nationkey", F.element_at(codes, F.col("n_nationkey") % 9 + 1).alias("code"))
    return n.select("n_nationkey", "code", lb.is_date_format(F.col("code")).alias("is_date"))


@query("""with c as (select event_id, ['number', 'text', 'text', 'boolean', 'empty', 'date', 'text', 'text'][1 + event_id % 8] kind, case event_id % 8 when 1 then '  ' when 2 then event_type when 6 then '..' when 7 then 'n' || event_id end t from events)
select event_id, case when kind = 'number' then 'numeric' when kind = 'empty' or (kind = 'text' and (t is null or trim(t) = '')) then 'empty' when kind in ('boolean', 'error', 'date') or regexp_matches(coalesce(t, ''), '[0-9]') then 'other' else 'marker' end as cell from c""")
def kind_of(spark, d):
    k = F.col("event_id") % 8
    kinds = F.array(*(F.lit(x) for x in ("number", "text", "text", "boolean", "empty", "date", "text", "text")))
    text = F.when(k == 1, "  ").when(k == 2, F.col("event_type")).when(k == 6, "..").when(k == 7, F.concat(F.lit("n"), F.col("event_id").cast("string")))
    e = b.read(spark, d, "events").select("event_id", F.element_at(kinds, (k + 1).cast("int")).alias("kind"), text.alias("t"))
    return e.select("event_id", lb.kind_of(F.col("kind"), F.col("t")).alias("cell"))


@query("select event_id, regexp_replace(props, '[0-9]', '#', 'g') masked from events")
def mask_digits(spark, d):
    return b.read(spark, d, "events").select("event_id", lb.mask_digits(F.col("props")).alias("masked"))


_HIDE = [  # without look-around: the thousands rule takes its neighbours and is run twice
    (r"(?:[£$€]|\b(?:GBP|USD|EUR)\s?)\s?[-+−]?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:bn|billion|m|million|k|thousand)\b)?", "[num]", "gi"),
    (r"[-+−]?[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:%|per\s?cent\b|percentage\s+points?\b|pp\b)", "[num]", "gi"),
    *[(r"(^|[^0-9.,])[-+−]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?($|[^0-9])", r"\1[num]\2", "g")] * 2,
    (r"[-+−]?[0-9]*\.[0-9]+", "[num]", "g"), (r"[0-9]{5,}", "[num]", "g"),
]
_BLANKED = "coalesce(text, '')"
for _pattern, _to, _flags in _HIDE:
    _BLANKED = f"regexp_replace({_BLANKED}, '{_pattern}', '{_to}', '{_flags}')"
for _from, _to in lb.ASCII.items():
    _BLANKED = "replace({}, '{}', '{}')".format(_BLANKED, _from, _to.replace("'", "''"))


@query(f"select doc_id, md5({_BLANKED}) redacted from documents")
def blank_numbers(spark, d):
    return b.read(spark, d, "documents").select("doc_id", F.md5(lb.blank_numbers(F.col("text"))).alias("redacted"))


@query("""with n as (select o_orderkey k, 1 + o_orderkey % 18000 i from orders) select k, i as idx,
 (case when i > 702 then chr(cast(65 + (i - 703)//676 as int)) else '' end) || (case when i > 26 then chr(cast(65 + ((i - 27)//26) % 26 as int)) else '' end) || chr(cast(65 + (i - 1) % 26 as int)) letters, i col, k + 1 as row from n""")
def xlsx_refs(spark, d):
    i = 1 + F.col("o_orderkey") % 18000
    o = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), i.alias("idx")).withColumn("letters", lb.column_letters(F.col("idx")))
    ref = lb.split_ref(F.concat(F.col("letters"), (F.col("k") + 1).cast("string")))
    return o.select("k", "idx", "letters", ref["col"].cast("long").alias("col"), ref["row"].cast("long").alias("row"))


@query("select o_orderkey, sign(o_totalprice - 150000)::int as sign, printf('%.2f', o_totalprice) shown from orders", name="sign")
def sign_(spark, d):
    return b.read(spark, d, "orders").select("o_orderkey", F.signum(F.col("o_totalprice") - 150000).cast("int").alias("sign"), F.format_string("%.2f", "o_totalprice").alias("shown"))


@query("select page_id, lower(regexp_replace(trim(url), '\\s+', ' ', 'g')) folded, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) path from pages")
def text_folding(spark, d):
    u = F.col("url")
    return b.read(spark, d, "pages").select("page_id", F.lower(F.regexp_replace(F.trim(u), r"\s+", " ")).alias("folded"), F.parse_url(u, F.lit("HOST")).alias("host"), F.parse_url(u, F.lit("PATH")).alias("path"))


@query("select page_id, url from pages where regexp_matches(url, '^https://([a-z0-9-]+\\.)*example\\.(net|org)/') and not contains(url, '..')")
def guarded_fetch(spark, d):
    """The allow-list as a predicate over urls; fetching itself is outside a query engine."""
    return b.read(spark, d, "pages").where(F.col("url").rlike(r"^https://([a-z0-9-]+\.)*example\.(net|org)/") & ~F.contains("url", F.lit(".."))).select("page_id", "url")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def json_scalar(spark, d):
    return b.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id, strftime(ts - interval 1 hour, '%Y-%m-%d %H:%M:%S') back, strftime(ts, '%Y-%m-%d') as day from events where month(ts) = 1")
def london_time(spark, d):
    """UTC instants moved by an hour, and their days, shown in London (winter: the same; summer: an hour on), as text."""
    shown = lambda t: F.from_utc_timestamp(t, "Europe/London")
    back = F.date_format(shown(F.col("ts") - F.expr("interval 1 hour")), "yyyy-MM-dd HH:mm:ss")
    return b.read(spark, d, "events").select("event_id", back.alias("back"), F.date_format(shown("ts"), "yyyy-MM-dd").alias("day"))


@query("select doc_id, sha256(text) sha from documents")
def text_hash(spark, d):
    return b.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("select max(case when regexp_matches(label, '^[0-9]{4} Q[1-4]$') then 1 else 0 end) has_quarters, count(*) n from (select case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y %b') else year(o_orderdate) || ' Q' || quarter(o_orderdate) end label from orders)")
def unemployment_rule(spark, d):
    """Quarterly rows anywhere in the span decide for quarters; the choice needs labels only."""
    o = b.read(spark, d, "orders")
    label = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy MMM")).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit(" Q"), F.quarter("o_orderdate").cast("string")))
    return o.select(label.alias("label")).agg(F.max(F.col("label").rlike(r"^\d{4} Q[1-4]$").cast("int")).alias("has_quarters"), F.count("*").alias("n"))
